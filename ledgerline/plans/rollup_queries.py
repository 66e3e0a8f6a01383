"""Roll-ups over the relational tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import rollups as R
from ledgerline.plans import adapter as A

WITH = f"WITH {A.SQL_MISSIONS}, {A.SQL_LEGS}"
OPEN = "status IN ('accepted', 'in_progress')"
PCT = "CAST(floor({a} / {b} * 100 + 0.5) AS BIGINT)"


def _both(spark, d):
    return A.missions(spark, d), A.legs(spark, d)


def _ledgers(spark, d):
    return R.deduped(A.ledger(spark, d, "purchase")), R.deduped(A.ledger(spark, d, "error"))


def partial_payouts(spark, d):
    m, legs = _both(spark, d)
    drops = legs.filter("kind = 'dropoff'").groupBy("mission_id").agg(
        F.sum("scu_total").cast("long").alias("total"), F.sum(F.when(F.col("completed"), F.col("scu_total")).otherwise(F.col("scu_delivered"))).cast("long").alias("delivered")
    )
    ratio = F.when(F.col("total") > 0, F.col("delivered") / F.col("total")).otherwise(1.0)
    return m.join(drops, m["id"] == drops["mission_id"]).select(
        "id", "total", "delivered", S.payout_factor(ratio).alias("factor"), S.partial_payout(F.col("reward"), F.col("delivered"), F.col("total")).alias("payout_now"),
        S.next_bracket(ratio).alias("next_share"),
    )


def capacity(spark, d):
    t = R.mission_totals(*_both(spark, d))
    hold = F.lit(96)
    return t.withColumn("c", S.capacity_status(F.col("scu_total"), hold)).select("mission_id", "scu_total", F.round("c.used", 6).alias("used"), "c.overflow", "c.trips", "c.tier")


def leg_key_dedupe(spark, d):
    legs = A.legs(spark, d).select("mission_id", F.col("objective_id").cast("int").alias("pos"), "kind", "commodity", F.col("scu_total").alias("scu"), "location")
    return R.deduped_pickups(legs)


def history(spark, d):
    return R.history(A.missions(spark, d)).select("id", "status", "completed_at", "created_seq", "payout")


def ordered_destinations(spark, d):
    n = A.table(spark, d, "nation")
    return n.select(F.col("n_name").alias("name"), (F.col("n_regionkey") == 2).alias("is_cargo_center")).transform(R.ordered_destinations)


def payout_labels(spark, d):
    m = A.missions(spark, d)
    return m.select("id", S.payout_display(F.col("payout"), F.col("payout_confidence")).alias("payout_label"), S.labelled(F.col("variant"), S.VARIANT_LABELS).alias("variant_label"))


def location_matches(spark, d):
    """The nations whose names are contained, or contain, the place a probe stands for."""
    nation = A.table(spark, d, "nation").select(F.col("n_name").alias("name"))
    probes = A.table(spark, d, "nation").select(F.concat(F.lit("port "), F.lower("n_name"), F.lit(" dock")).alias("current"))
    return probes.join(nation, S.confident_location(F.col("current"), F.col("name")))


def first_last_events(spark, d):
    """First non-empty property and last one by arrival, and live promotion, a row a user."""
    e = A.table(spark, d, "events").withColumn("source", F.when(F.col("event_id") % 4 == 0, "live").otherwise("historical"))
    return e.groupBy("user_id").agg(
        F.when(F.max((F.col("source") == "live").cast("int")) == 1, "live").otherwise("historical").alias("session"),
        F.min_by(F.when(F.col("event_type") == "signup", F.col("props")), F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("first_accept"),
        F.max_by(F.when(F.col("event_type") == "view", F.col("props")), F.when(F.col("event_type") == "view", F.col("event_id"))).alias("last_marker"),
        F.min("event_id").alias("first_seq"),
    )


QUERIES = {
    "dropoff_groups_view": lambda s, d: R.ordered_stops(R.stop_groups(*_both(s, d))),
    "pickup_groups": lambda s, d: R.stop_groups(*_both(s, d), kind="pickup"),
    "dropoff_groups_store": lambda s, d: R.dropoffs_store(*_both(s, d)),
    "group_summary": lambda s, d: R.group_summary(R.stop_groups(*_both(s, d))),
    "mission_totals": lambda s, d: R.mission_totals(*_both(s, d)),
    "status_counts": lambda s, d: R.status_counts(A.missions(s, d)),
    "totals_store": lambda s, d: R.totals_store(*_both(s, d), *_ledgers(s, d)),
    "lifetime_totals": lambda s, d: R.lifetime_totals(*_both(s, d)),
    "earnings_dedupe": lambda s, d: _ledgers(s, d)[0],
    "history": history,
    "active_missions": lambda s, d: R.active_missions(A.missions(s, d)).select("id", "status", "session", "created_seq"),
    "incomplete_missions": lambda s, d: R.incomplete_missions(*_both(s, d)).select("id", "status"),
    "status_rollup": lambda s, d: R.status_rollup(*_both(s, d)),
    "leg_key_dedupe": leg_key_dedupe,
    "commodity_summary": lambda s, d: R.commodity_summary(A.legs(s, d)),
    "partial_payout": partial_payouts,
    "capacity_status": capacity,
    "ordered_destinations": ordered_destinations,
    "payout_labels": payout_labels,
    "location_match_join": location_matches,
    "session_promotion": first_last_events,
}


def _stops(kind: str, unknown: str) -> str:
    return f"""{WITH}, rows AS (
        SELECT coalesce(location, '{unknown}') AS location, commodity, CASE WHEN completed THEN 'delivered' ELSE 'todo' END AS state,
               CASE WHEN completed THEN 0 ELSE greatest(0, scu_total - scu_delivered) END AS rem, CASE WHEN completed THEN scu_total ELSE scu_delivered END AS done
        FROM legs JOIN missions ON id = mission_id WHERE kind = '{kind}' AND {OPEN}),
      g AS (SELECT location, CAST(sum(rem) AS BIGINT) AS group_remaining, CAST(sum(done) AS BIGINT) AS gd, max(CAST(state = 'todo' AS INT)) AS todo FROM rows GROUP BY location),
      c AS (SELECT location, commodity, state, CAST(sum(CASE WHEN state = 'todo' THEN rem ELSE done END) AS BIGINT) AS scu, count(*) AS legs FROM rows GROUP BY ALL)
    SELECT location, commodity, state, scu, legs, group_remaining, group_remaining + gd AS group_total,
           CASE WHEN group_remaining + gd <> 0 THEN {PCT.format(a='gd', b='(group_remaining + gd)')} ELSE 0 END AS pct_delivered, todo = 0 AS all_done, location = '{unknown}' AS needs_location
    FROM c JOIN g USING (location) WHERE location <> '{unknown}' OR todo = 1"""


ORACLE_SQL = {
    "dropoff_groups_view": _stops("dropoff", "Unknown destination"),
    "pickup_groups": _stops("pickup", "Unknown pickup"),
    "dropoff_groups_store": f"""{WITH}, r AS (
        SELECT location, CASE WHEN coalesce(commodity, '') = '' THEN '(unknown)' ELSE commodity END AS commodity, scu_total, completed, CASE WHEN completed THEN scu_total ELSE scu_delivered END AS del
        FROM legs JOIN missions ON id = mission_id WHERE kind = 'dropoff' AND location IS NOT NULL AND session = 'live' AND {OPEN}),
      c AS (SELECT location, commodity, CAST(sum(greatest(0, scu_total - del)) AS BIGINT) AS scu_remaining, CAST(sum(del) AS BIGINT) AS scu_delivered, CAST(sum(CASE WHEN completed THEN 0 ELSE 1 END) AS BIGINT) AS o, count(*) AS legs FROM r GROUP BY ALL),
      g AS (SELECT location, CAST(sum(scu_remaining) AS BIGINT) AS group_remaining, CAST(sum(scu_remaining + scu_delivered) AS BIGINT) AS group_total, sum(o) AS go FROM c GROUP BY location)
    SELECT location, commodity, CASE WHEN scu_remaining > 0 OR o > 0 THEN 'todo' ELSE 'delivered' END AS state, scu_remaining, scu_delivered, legs, group_remaining, group_total,
           CASE WHEN group_total > 0 THEN {PCT.format(a='(group_total - group_remaining)', b='group_total')} ELSE 0 END AS pct_delivered, group_remaining = 0 AND go = 0 AS all_done
    FROM c JOIN g USING (location)""",
    "mission_totals": f"""{WITH} SELECT id AS mission_id, coalesce(r, 0) AS scu_remaining, coalesce(t, 0) AS scu_total, coalesce(d, 0) AS legs_done, coalesce(n, 0) AS legs_total,
           CASE WHEN n > 0 THEN {PCT.format(a='d', b='n')} ELSE 0 END AS pct_delivered
    FROM missions LEFT JOIN (SELECT mission_id, CAST(sum(CASE WHEN completed THEN 0 ELSE greatest(0, scu_total - scu_delivered) END) AS BIGINT) AS r, CAST(sum(scu_total) AS BIGINT) AS t,
           CAST(sum(CASE WHEN completed THEN 1 ELSE 0 END) AS BIGINT) AS d, count(*) AS n FROM legs WHERE kind = 'dropoff' GROUP BY mission_id) ON id = mission_id""",
    "status_counts": f"WITH {A.SQL_MISSIONS} SELECT status, count(*) AS missions FROM missions GROUP BY status",
    "totals_store": f"""{WITH}, {A.sql_ledger('e', 'purchase')}, {A.sql_ledger('f', 'error')}
    SELECT (SELECT count(*) FROM missions WHERE status = 'complete') AS missions_completed,
           (SELECT CAST(sum(CASE WHEN completed THEN scu_total ELSE scu_delivered END) AS BIGINT) FROM legs JOIN missions ON id = mission_id WHERE status = 'complete') AS scu_hauled,
           (SELECT CAST(sum(amount) AS BIGINT) FROM e) AS credits_earned, (SELECT CAST(sum(amount) AS BIGINT) FROM f) AS fines_total""",
    "lifetime_totals": f"""{WITH} SELECT (SELECT count(*) FROM missions WHERE status = 'complete') AS missions_completed,
           (SELECT CAST(sum(scu_total) AS BIGINT) FROM legs JOIN missions ON id = mission_id WHERE status = 'complete' AND kind = 'dropoff') AS scu_hauled,
           (SELECT CAST(sum(payout) AS BIGINT) FROM missions WHERE status = 'complete') AS credits_earned, CAST(0 AS BIGINT) AS fines_total""",
    "earnings_dedupe": f"WITH {A.sql_ledger('e', 'purchase')} SELECT amount, ts FROM e",
    "history": f"WITH {A.SQL_MISSIONS} SELECT id, status, completed_at, created_seq, payout FROM missions WHERE NOT ({OPEN})",
    "active_missions": f"WITH {A.SQL_MISSIONS} SELECT id, status, session, created_seq FROM missions WHERE session = 'live' AND {OPEN}",
    "incomplete_missions": f"{WITH} SELECT id, status FROM missions WHERE id IN (SELECT mission_id FROM legs WHERE kind = 'dropoff' AND (location IS NULL OR scu_total = 0))",
    "status_rollup": f"""{WITH} SELECT id, CASE WHEN terminal_source IS NOT NULL AND NOT ({OPEN}) THEN status WHEN n > 0 AND d = n THEN 'complete' WHEN d > 0 THEN 'in_progress' ELSE 'accepted' END AS status
    FROM missions LEFT JOIN (SELECT mission_id, count(*) AS n, sum(CASE WHEN completed THEN 1 ELSE 0 END) AS d FROM legs GROUP BY mission_id) ON id = mission_id""",
    "leg_key_dedupe": f"""WITH {A.SQL_LEGS}, p AS (SELECT mission_id, CAST(objective_id AS INT) AS pos, kind, commodity, scu_total AS scu, location,
           lower(trim(coalesce(commodity, ''))) || '|' || lower(trim(coalesce(location, ''))) AS k FROM legs)
    SELECT mission_id, min(pos) AS pos, kind, arg_min(commodity, pos) AS commodity, CAST(sum(scu) AS BIGINT) AS scu, arg_min(location, pos) AS location FROM p WHERE kind = 'pickup' GROUP BY mission_id, kind, k
    UNION ALL SELECT mission_id, pos, kind, commodity, scu, location FROM p WHERE kind <> 'pickup'""",
    "commodity_summary": f"""WITH {A.SQL_LEGS}, f AS (SELECT mission_id, commodity, min(objective_id) AS first_at FROM legs WHERE kind = 'dropoff' GROUP BY ALL),
      l AS (SELECT mission_id, list(commodity ORDER BY first_at, commodity) AS n FROM f GROUP BY mission_id)
    SELECT mission_id, array_to_string(n[1:2], ', ') || CASE WHEN len(n) > 2 THEN ' +' || CAST(len(n) - 2 AS VARCHAR) ELSE '' END AS summary FROM l""",
    "partial_payout": f"""{WITH}, d AS (SELECT mission_id, CAST(sum(scu_total) AS BIGINT) AS total, CAST(sum(CASE WHEN completed THEN scu_total ELSE scu_delivered END) AS BIGINT) AS delivered FROM legs WHERE kind = 'dropoff' GROUP BY mission_id),
      r AS (SELECT *, CASE WHEN total > 0 THEN delivered / total ELSE 1.0 END AS q FROM missions JOIN d ON id = mission_id),
      f AS (SELECT *, CAST(CASE WHEN q >= 1 THEN 1.0 WHEN q > 0.75 THEN 0.76 WHEN q > 0.5 THEN 0.45 WHEN q > 0.25 THEN 0.15 ELSE 0.0 END AS DOUBLE) AS factor FROM r)
    SELECT id, total, delivered, factor, CAST(floor((CASE WHEN total <= 0 THEN reward ELSE reward * factor END) / 250 + 0.5) * 250 AS BIGINT) AS payout_now,
           CAST(CASE WHEN q >= 1 THEN NULL WHEN q <= 0.25 THEN 0.25 WHEN q <= 0.5 THEN 0.5 WHEN q <= 0.75 THEN 0.75 ELSE 1.0 END AS DOUBLE) AS next_share FROM f""",
    "capacity_status": f"""{WITH}, t AS (SELECT id AS mission_id, coalesce(t, 0) AS scu_total FROM missions LEFT JOIN (SELECT mission_id, CAST(sum(scu_total) AS BIGINT) AS t FROM legs WHERE kind = 'dropoff' GROUP BY mission_id) ON id = mission_id)
    SELECT mission_id, scu_total, round(least(1.0, CAST(scu_total AS DOUBLE) / 96), 6) AS used, greatest(0, scu_total - 96) AS overflow, CAST(ceil(scu_total / 96) AS BIGINT) AS trips,
           CASE WHEN scu_total > 96 THEN 'over' WHEN scu_total / 96 >= 0.8 THEN 'warn' ELSE 'ok' END AS tier FROM t""",
    "ordered_destinations": "SELECT n_name AS name, n_regionkey = 2 AS is_cargo_center FROM nation",
    "payout_labels": f"""WITH {A.SQL_MISSIONS} SELECT id, CASE WHEN payout IS NULL THEN '—' ELSE CASE WHEN payout_confidence = 'approximate' THEN '~' ELSE '' END || format('{{:,}}', payout) || ' aUEC' END AS payout_label,
           CASE variant WHEN 'A_TO_B' THEN 'A → B' WHEN 'SINGLE_TO_MULTI' THEN 'Single → Multi' WHEN 'MULTI_TO_SINGLE' THEN 'Multi → Single' ELSE 'Manual Entry' END AS variant_label FROM missions""",
    "location_match_join": """SELECT 'port ' || lower(a.n_name) || ' dock' AS "current", b.n_name AS name FROM nation a JOIN nation b ON contains('port ' || lower(a.n_name) || ' dock', lower(b.n_name))""",
    "session_promotion": """SELECT user_id, CASE WHEN bool_or(event_id % 4 = 0) THEN 'live' ELSE 'historical' END AS session,
           arg_min(props, event_id) FILTER (WHERE event_type = 'signup') AS first_accept, arg_max(props, event_id) FILTER (WHERE event_type = 'view') AS last_marker, min(event_id) AS first_seq FROM events GROUP BY user_id""",
}
ORACLE_SQL["group_summary"] = f"""WITH v AS ({ORACLE_SQL['dropoff_groups_view']}), g AS (SELECT DISTINCT location, group_remaining, all_done FROM v)
    SELECT CAST(coalesce(sum(CASE WHEN NOT all_done THEN group_remaining END), 0) AS BIGINT) AS grand_total_remaining, count(CASE WHEN NOT all_done THEN 1 END) AS active_stops FROM g"""
