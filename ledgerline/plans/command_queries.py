"""Commands, lists and lookups over the relational tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import correlate as C, mutate as M, rollups as R, salvage as V
from ledgerline.plans import adapter as A
from ledgerline.plans.graph_queries import _EDGES
from ledgerline.plans.rollup_queries import OPEN, WITH

#: The time of all commands here.
AT = 900_000_000_000
TWO_PLACES = ["NATION_1", "NATION_2"]
_LEG = ["mission_id", "objective_id", "completed", "scu_delivered"]


def _every(missions, n, rest=0):
    return missions.filter(F.col("created_seq") % n == rest)


def abandoned(spark, d):
    m = A.missions(spark, d)
    return M.abandoned(m, _every(m, 7), AT).select("id", "status", "completed_at", "terminal_source")


def paid(spark, d):
    m = A.missions(spark, d)
    payouts = _every(m, 7, 1).select("id", (F.col("created_seq") * 10).alias("payout"))
    return M.paid(m, payouts, AT).select("id", "payout", "payout_confidence", "status")


def toggled(spark, d):
    legs = A.legs(spark, d)
    return M.toggled(legs, legs.filter("scu_total % 5 = 0"), AT).select(*_LEG)


def resized(spark, d):
    """New sizes, and delivered amounts for some."""
    legs = A.legs(spark, d)
    patches = legs.filter("scu_total % 4 = 0").select(
        "mission_id", "objective_id", F.lit(AT).alias("at"), (F.col("scu_total") + 1).alias("scu_total"), F.when(F.col("scu_total") % 8 == 0, 2).alias("scu_delivered")
    )
    return M.patched_legs(legs, patches).select(*_LEG, "scu_total", "manual_override")


def checked_off(spark, d):
    m, legs = A.missions(spark, d), A.legs(spark, d)
    lines = legs.filter((F.col("kind") == "dropoff") & F.col("location").isin(TWO_PLACES)).select("kind", "location", "commodity").distinct()
    return M.check_off(m, legs, lines, AT).select(*_LEG)


def with_legs(spark, d):
    added = _every(A.missions(spark, d), 11).select(F.col("id").alias("mission_id"), F.lit("pickup").alias("kind"), F.lit("Waste").alias("commodity"), F.lit(3).alias("scu_total"), F.lit("Depot").alias("location"), F.lit(5).cast("long").alias("at"))
    return M.with_legs(A.legs(spark, d), added).select("mission_id", "objective_id", "scu_total", "location")


def nested(spark, d):
    n = R.nested_missions(A.missions(spark, d), A.legs(spark, d))
    return n.select("id", F.array_join(F.transform("legs", lambda x: x["objective_id"]), ",").alias("leg_ids"))


def references(spark, d):
    legs = A.legs(spark, d)
    refs = legs.select(F.when(F.col("scu_total") % 3 == 0, "gone").otherwise(F.col("mission_id")).alias("mission_id"), F.when(F.col("scu_total") % 3 == 1, "gone").otherwise(F.col("objective_id")).alias("objective_id"))
    return R.live_references(refs, A.missions(spark, d), legs, A.table(spark, d, "lineitem").count())


def ships(spark, d):
    known = A.table(spark, d, "part").select(F.concat(F.lit("ship-"), F.col("p_partkey").cast("string")).alias("slug"), F.col("p_name").alias("name"), "p_size")
    wanted = A.table(spark, d, "supplier").select(F.concat(F.lit("ship-"), (F.col("s_suppkey") * 37).cast("string")).alias("slug"))
    return V.ships_by_slug(wanted, known).select("slug", "name")


def _edges(spark, d):
    return C.route_edges(A.missions(spark, d), A.legs(spark, d))


def incoming(spark, d):
    return R.incoming(_edges(spark, d)).select("node", F.size("edges").alias("n"), F.col("edges")[0]["edge_id"].alias("first_edge"))


QUERIES = {
    "command_abandon": abandoned, "command_set_payout": paid, "command_toggle_leg": toggled, "command_patch_legs": resized, "command_check_off": checked_off, "command_add_legs": with_legs,
    "command_recompute": lambda s, d: M.recomputed(A.missions(s, d), A.legs(s, d), AT).select("id", "status", "completed_at"),
    "command_clear_active": lambda s, d: M.cleared_active(A.missions(s, d), A.legs(s, d))[0].select("id", "status"),
    "command_delete": lambda s, d: M.deleted(A.missions(s, d), A.legs(s, d), _every(A.missions(s, d), 13))[1].select("mission_id", "objective_id"),
    "nested_missions": nested, "leg_references": references, "ship_by_slug": ships, "incoming_edges": incoming, "map_layout": lambda s, d: R.map_layout(_edges(s, d)),
    "history_view": lambda s, d: R.history_view(A.missions(s, d)).select("id", "shown_at"),
    "giver_choices": lambda s, d: R.choices(A.missions(s, d), "giver"),
    "last_created": lambda s, d: R.first_few(R.in_created_order(A.missions(s, d)), 6, F.desc("created_seq")).select("id", "created_seq"),
}
_HIT = "kind = 'dropoff' AND location IN ('NATION_1', 'NATION_2') AND mission_id IN (SELECT id FROM missions WHERE status IN ('accepted', 'in_progress'))"
ORACLE_SQL = {
    "command_abandon": f"""{WITH} SELECT id, CASE WHEN created_seq % 7 = 0 THEN 'abandoned' ELSE status END AS status, CASE WHEN created_seq % 7 = 0 THEN coalesce(completed_at, {AT}) ELSE completed_at END AS completed_at,
        CASE WHEN created_seq % 7 = 0 THEN 'manual' ELSE terminal_source END AS terminal_source FROM missions""",
    "command_set_payout": f"""{WITH} SELECT id, CASE WHEN created_seq % 7 = 1 THEN created_seq * 10 ELSE payout END AS payout, CASE WHEN created_seq % 7 = 1 THEN 'confirmed' ELSE payout_confidence END AS payout_confidence, status FROM missions""",
    "command_toggle_leg": f"""{WITH} SELECT mission_id, objective_id, CASE WHEN scu_total % 5 = 0 THEN NOT completed ELSE completed END AS completed,
        CASE WHEN scu_total % 5 <> 0 THEN scu_delivered WHEN completed THEN 0 ELSE scu_total END AS scu_delivered FROM legs""",
    "command_patch_legs": f"""{WITH} SELECT mission_id, objective_id, completed, CASE WHEN scu_total % 4 = 0 THEN scu_total + 1 ELSE scu_total END AS scu_total, CASE WHEN scu_total % 4 = 0 THEN {AT} END AS manual_override,
        CASE WHEN scu_total % 8 = 0 THEN 2 WHEN scu_total % 4 = 0 AND completed THEN scu_total + 1 ELSE scu_delivered END AS scu_delivered FROM legs""",
    "command_check_off": f"""{WITH}, hit AS (SELECT mission_id, objective_id, NOT bool_and(completed) OVER (PARTITION BY location, commodity) AS now FROM legs WHERE {_HIT})
        SELECT mission_id, objective_id, coalesce(now, completed) AS completed, CASE WHEN now IS NULL THEN scu_delivered WHEN now THEN scu_total ELSE 0 END AS scu_delivered FROM legs LEFT JOIN hit USING (mission_id, objective_id)""",
    "command_add_legs": f"""{WITH} SELECT mission_id, objective_id, scu_total, location FROM legs UNION ALL SELECT id, 'manual_pickup_5_0', 3, 'Depot' FROM missions WHERE created_seq % 11 = 0""",
    "command_recompute": f"""{WITH}, c AS (SELECT mission_id, count(*) AS n, count(*) FILTER (WHERE completed) AS done FROM legs GROUP BY 1),
        s AS (SELECT id, completed_at, terminal_source IS NOT NULL AND NOT {OPEN} AS ended, status AS old, CASE WHEN n > 0 AND done = n THEN 'complete' WHEN done > 0 THEN 'in_progress' ELSE 'accepted' END AS new FROM missions LEFT JOIN c ON mission_id = id)
        SELECT id, CASE WHEN ended THEN old ELSE new END AS status, CASE WHEN ended THEN completed_at WHEN new = 'complete' THEN coalesce(completed_at, {AT}) END AS completed_at FROM s""",
    "command_clear_active": f"{WITH} SELECT id, status FROM missions WHERE NOT (session = 'live' AND {OPEN})",
    "command_delete": f"{WITH} SELECT mission_id, objective_id FROM legs WHERE mission_id NOT IN (SELECT id FROM missions WHERE created_seq % 13 = 0)",
    "nested_missions": f"{WITH} SELECT id, string_agg(objective_id, ',' ORDER BY kind <> 'pickup', objective_id) AS leg_ids FROM missions LEFT JOIN legs ON mission_id = id GROUP BY id",
    "leg_references": f"{WITH} SELECT mission_id, objective_id FROM legs WHERE scu_total % 3 = 2",
    "ship_by_slug": "SELECT 'ship-' || (s_suppkey * 37) AS slug, p_name AS name FROM supplier LEFT JOIN part ON p_partkey = s_suppkey * 37",
    "incoming_edges": f"WITH RECURSIVE {_EDGES} SELECT to_location AS node, CAST(count(*) AS INTEGER) AS n, min(edge_id) AS first_edge FROM edges GROUP BY to_location",
    "map_layout": f"""WITH RECURSIVE {_EDGES}, n AS (SELECT node, bool_or(o) AS o, bool_or(NOT o) AS i, count(*) FILTER (WHERE NOT o) AS lines FROM (SELECT from_location AS node, true AS o FROM edges UNION ALL SELECT to_location, false FROM edges) GROUP BY node),
        h AS (SELECT node, CASE WHEN o AND i THEN 'both' WHEN o THEN 'source' ELSE 'sink' END AS role, CAST(CASE WHEN lines > 0 THEN 44 + 15 * lines + 8 ELSE 48 END AS BIGINT) AS height FROM n)
        SELECT *, CAST(coalesce(sum(height + 16) OVER (PARTITION BY role ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top FROM h""",
    "history_view": f"{WITH} SELECT id, coalesce(completed_at, accepted_at, 0) AS shown_at FROM missions WHERE NOT {OPEN}",
    "giver_choices": f"{WITH} SELECT DISTINCT giver FROM missions WHERE trim(giver) <> ''",
    "last_created": f"{WITH} SELECT id, created_seq FROM missions ORDER BY created_seq DESC LIMIT 6",
}
