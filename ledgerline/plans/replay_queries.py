"""Events replayed onto stored tables. Two thirds of the orders are stored; some lines were edited, some were added by
hand; lines and orders tell the events: declared, closed, ended, accepted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import replay
from ledgerline.plans import adapter as A
from ledgerline.sources.scratch import FILE_ROWS, written

NAMES = lambda schema: [c.split(" ", 1) for c in schema.split(", ")]


def _stored(orders, lines):
    """missions, legs."""
    m = orders.filter(F.col("id").cast("long") % 3 != 0)
    m = m.select(*[(F.col(c) if c in m.columns else F.lit(None)).cast(k).alias(c) for c, k in NAMES(schemas.MISSIONS)])
    key, n = F.col("mission_id").cast("long"), F.col("objective_id").cast("int")
    l = lines.filter((key % 3 != 0) & ((key % 5 != 0) | (n % 2 == 1)))
    l = l.withColumn("manual_override", F.when((key + n) % 4 == 0, key))
    l = l.withColumn("objective_id", F.when((key % 7 == 0) & (n % 3 == 0), F.concat(F.lit("manual_"), "objective_id")).otherwise(F.col("objective_id")))
    return m, l.select(*[(F.col(c) if c in l.columns else F.lit(None)).cast(k).alias(c) for c, k in NAMES(schemas.LEGS)])


def _events(orders, lines):
    """Of every second order, in its lines' order: its acceptance, each line declared (a third with another size), some
    lines closed, and its end, if it is one of the finished."""
    legs = lines.filter(F.col("mission_id").cast("long") % 2 == 0)
    key, n = F.col("mission_id").cast("long"), F.col("objective_id").cast("int")
    source = F.when(key % 4 == 0, "live").otherwise("historical")
    base = key * 1000
    wide = lambda df, **columns: df.select(*[(columns[c] if c in columns else F.lit(None)).cast(k).alias(c) for c, k in NAMES(schemas.EVENTS)])
    common = {"mission_id": F.col("mission_id"), "source": source}
    declared = wide(legs, **common, type=F.lit("objectiveDeclared"), seq=base + n * 2, ts=base + n, objective_id=F.col("objective_id"), kind=F.col("kind"), commodity=F.col("commodity"), scu_total=F.col("scu_total") + F.when(n % 3 == 0, 5).otherwise(0), location=F.col("location"))
    closed = wide(legs.filter((n % 2 == 0) | (key % 8 == 0)), **common, type=F.lit("objectiveCompleted"), seq=base + 500 + n, ts=base + 500 + n, objective_id=F.col("objective_id"))
    m = orders.filter(F.col("id").cast("long") % 2 == 0).withColumnRenamed("id", "mission_id")
    opened = wide(m, **common, type=F.lit("missionAccepted"), seq=base + 1, ts=base, title=F.concat(F.lit("Told "), F.col("mission_id")))
    ended = wide(m.filter((F.col("status") == "complete") & (key % 6 != 0)), **common, type=F.lit("missionEnded"), seq=base + 900, ts=base + 900, completion_type=F.when(key % 10 == 0, "abandon").otherwise("complete"))
    return declared.unionByName(closed).unionByName(opened).unionByName(ended)


def _replayed(spark, d):
    lines, orders = written(A.legs(spark, d), "replay-lines", FILE_ROWS), written(A.missions(spark, d), "replay-orders", FILE_ROWS)  # each read three times
    return replay.replayed(*_stored(orders, lines), _events(orders, lines))


def replayed_missions(spark, d):
    out = _replayed(spark, d).missions
    return out.select("id", "title", "giver", "variant", "status", "payout", "source", "accepted_at", "completed_at", "session", "terminal_source", "created_seq")


def replayed_legs(spark, d):
    return _replayed(spark, d).legs.drop("pos_x", "pos_y", "pos_z")


def replay_decisions(spark, d):
    return replay.decision_counts(_replayed(spark, d).decisions)


QUERIES = {"replayed_missions": replayed_missions, "replayed_legs": replayed_legs, "replay_decisions": replay_decisions}

_CLEAN = lambda kind, c, l: f"concat_ws('|', {kind}, lower(trim(coalesce({c}, ''))), lower(trim(coalesce({l}, ''))))"
_TABLES = f"""{A.SQL_MISSIONS}, {A.SQL_LEGS},
    lk AS (SELECT *, CAST(mission_id AS BIGINT) AS k, CAST(objective_id AS INTEGER) AS n FROM legs),
    sm AS (SELECT * FROM missions WHERE CAST(id AS BIGINT) % 3 <> 0),
    sl AS (SELECT mission_id, CASE WHEN k % 7 = 0 AND n % 3 = 0 THEN 'manual_' || objective_id ELSE objective_id END AS objective_id, kind, commodity, scu_total, scu_delivered, location, completed, CASE WHEN (k + n) % 4 = 0 THEN k END AS manual_override
           FROM lk WHERE k % 3 <> 0 AND (k % 5 <> 0 OR n % 2 = 1)),
    dc AS (SELECT *, k * 1000 + n * 2 AS seq, CASE WHEN n % 3 = 0 THEN scu_total + 5 ELSE scu_total END AS size, CASE WHEN k % 4 = 0 THEN 'live' ELSE 'historical' END AS source FROM lk WHERE k % 2 = 0),
    cl AS (SELECT *, k * 1000 + 500 + n AS sq FROM dc WHERE n % 2 = 0 OR k % 8 = 0),
    en AS (SELECT id AS mission_id, CAST(id AS BIGINT) * 1000 + 900 AS ts, CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN 'abandoned' ELSE 'complete' END AS ending FROM missions WHERE CAST(id AS BIGINT) % 2 = 0 AND status = 'complete' AND CAST(id AS BIGINT) % 6 <> 0),
    fresh AS (SELECT d.*, {_CLEAN('d.kind', 'd.commodity', 'd.location')} AS key FROM dc d LEFT JOIN sl ON sl.mission_id = d.mission_id AND sl.objective_id = d.objective_id WHERE sl.mission_id IS NULL),
    nw AS (SELECT *, row_number() OVER (PARTITION BY mission_id, key ORDER BY seq) AS place FROM fresh),
    hand AS (SELECT mission_id, objective_id AS synthetic, key, row_number() OVER (PARTITION BY mission_id, key ORDER BY objective_id) AS place FROM (SELECT *, {_CLEAN('kind', 'commodity', 'location')} AS key FROM sl WHERE objective_id LIKE 'manual\\_%' ESCAPE '\\')),
    ad AS (SELECT nw.mission_id, nw.objective_id, synthetic FROM nw JOIN hand USING (mission_id, key, place)),
    own AS (SELECT sl.mission_id, coalesce(ad.objective_id, sl.objective_id) AS objective_id, kind, commodity, scu_total, scu_delivered, location, completed, manual_override FROM sl LEFT JOIN ad ON ad.mission_id = sl.mission_id AND ad.synthetic = sl.objective_id),
    bt AS (SELECT coalesce(o.mission_id, d.mission_id) AS mission_id, coalesce(o.objective_id, d.objective_id) AS objective_id, o.mission_id IS NOT NULL AS stored, d.mission_id IS NOT NULL AS told, d.source = 'historical' AND o.manual_override IS NOT NULL AS guarded,
                  o.kind AS kind0, o.commodity AS commodity0, o.scu_total AS total0, o.scu_delivered AS delivered0, o.location AS location0, o.completed AS completed0, o.manual_override, d.kind AS kind1, d.commodity AS commodity1, d.size, d.location AS location1, d.seq AS first_seq
           FROM own o FULL JOIN dc d ON o.mission_id = d.mission_id AND o.objective_id = d.objective_id),
    fl AS (SELECT bt.*, cl.sq AS closed_at, CASE WHEN NOT coalesce(guarded, false) THEN cl.sq END AS done_seq, en.ts AS end_seq FROM bt LEFT JOIN cl ON cl.mission_id = bt.mission_id AND cl.objective_id = bt.objective_id LEFT JOIN en ON en.mission_id = bt.mission_id AND ending = 'complete'),
    al AS (SELECT mission_id, objective_id, coalesce(kind1, kind0) AS kind, coalesce(CASE WHEN NOT guarded THEN nullif(commodity1, '') END, CASE WHEN guarded IS NULL THEN nullif(commodity1, '') END, nullif(commodity0, ''), '') AS commodity,
                  CASE WHEN told AND NOT coalesce(guarded, false) THEN size ELSE total0 END AS scu_total,
                  CASE WHEN done_seq IS NULL AND end_seq IS NULL THEN coalesce(delivered0, 0) WHEN told AND NOT coalesce(guarded, false) THEN size ELSE total0 END AS scu_delivered,
                  CASE WHEN told AND NOT coalesce(guarded, false) THEN coalesce(location1, location0) ELSE location0 END AS location,
                  coalesce(completed0, false) OR done_seq IS NOT NULL OR end_seq IS NOT NULL AS completed, manual_override, stored, told, coalesce(guarded, false) AS guarded, kind0, commodity0, total0, delivered0, location0, completed0, done_seq, closed_at, first_seq FROM fl),
    rs AS (SELECT c.mission_id, c.sq, count(*) FILTER (WHERE l.stored OR l.first_seq <= c.sq) AS n, count(*) FILTER (WHERE coalesce(l.completed0, false) OR l.done_seq <= c.sq) AS ok FROM cl c JOIN al l ON l.mission_id = c.mission_id GROUP BY ALL),
    br AS (SELECT mission_id, max(sq) FILTER (WHERE ok < n) AS broken, arg_max(ok = n, sq) AS last, arg_max(ok, sq) AS closed FROM rs GROUP BY mission_id),
    rn AS (SELECT br.*, (SELECT min(sq) FROM rs WHERE rs.mission_id = br.mission_id AND ok = n AND sq > coalesce(broken, -1)) AS since, CASE WHEN last THEN 'complete' WHEN closed > 0 THEN 'in_progress' ELSE 'accepted' END AS running FROM br),
    ids AS (SELECT id FROM sm UNION SELECT id FROM missions WHERE CAST(id AS BIGINT) % 2 = 0),
    am AS (SELECT ids.id, coalesce(sm.title, 'Told ' || ids.id) AS title, sm.giver, coalesce(sm.variant, 'MANUAL') AS variant,
                  CASE WHEN en.mission_id IS NOT NULL THEN ending WHEN sm.terminal_source IS NOT NULL OR rn.mission_id IS NULL THEN coalesce(sm.status, 'accepted') ELSE running END AS status,
                  sm.payout, 'log' AS source, CASE WHEN sm.id IS NOT NULL THEN sm.accepted_at ELSE CAST(ids.id AS BIGINT) * 1000 END AS accepted_at,
                  CASE WHEN en.mission_id IS NOT NULL THEN en.ts WHEN sm.terminal_source IS NOT NULL OR rn.mission_id IS NULL THEN sm.completed_at WHEN running <> 'complete' THEN NULL
                       WHEN sm.status = 'complete' AND broken IS NULL THEN sm.completed_at WHEN broken IS NOT NULL THEN since ELSE coalesce(sm.completed_at, since) END AS completed_at,
                  CASE WHEN sm.session = 'live' OR CAST(ids.id AS BIGINT) % 4 = 0 THEN 'live' ELSE 'historical' END AS session, CASE WHEN en.mission_id IS NOT NULL THEN 'game' ELSE sm.terminal_source END AS terminal_source,
                  coalesce(sm.created_seq, (SELECT max(created_seq) FROM sm) + 1 + CAST(ids.id AS BIGINT) * 1000 + 1) AS created_seq, sm.id IS NOT NULL AS stored
           FROM ids LEFT JOIN sm ON sm.id = ids.id LEFT JOIN en ON en.mission_id = ids.id LEFT JOIN rn ON rn.mission_id = ids.id)"""
ORACLE_SQL = {
    "replayed_missions": f"WITH {_TABLES} SELECT * EXCLUDE (stored) FROM am",
    "replayed_legs": f"WITH {_TABLES} SELECT mission_id, objective_id, kind, commodity, scu_total, scu_delivered, location, completed, manual_override FROM al",
    "replay_decisions": f"""WITH {_TABLES}, x AS (SELECT 'added' AS kind, 'mission' AS what, CAST(NULL AS VARCHAR) AS reason, 1 AS n FROM am WHERE NOT stored
        UNION ALL SELECT 'skipped', 'mission', 'already stored', 1 FROM am WHERE stored AND CAST(id AS BIGINT) % 2 = 0
        UNION ALL SELECT 'added', 'leg', NULL, 1 FROM al WHERE NOT stored
        UNION ALL SELECT 'updated', 'leg', NULL, 1 FROM al WHERE stored AND (kind, commodity, scu_total, scu_delivered, coalesce(location, ''), completed) IS DISTINCT FROM (kind0, commodity0, total0, delivered0, coalesce(location0, ''), completed0)
        UNION ALL SELECT 'skipped', 'leg', 'edited by the user', CASE WHEN closed_at IS NULL THEN 1 ELSE 2 END FROM al WHERE guarded)
        SELECT kind, what, reason, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY ALL""",
}
