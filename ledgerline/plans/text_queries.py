"""Parsing, redaction and fuzzy matching over the test tables, with their SQL.

Log lines and contract sentences are written from `events` and `orders`, so the SQL side is the values from before they
were written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import fuzzy, logparse as P, noisytext as O, redact as D
from ledgerline.operators import claims, reduce as E
from ledgerline.plans import adapter as A

#: A fixed dictionary for matching: name, place in the dictionary.
NAMES = ["Aluminum", "Titanium", "Hydrogen", "Processed Food", "Pressurized Ice", "Quartz", "Waste", "Iron", "Stims", "Agricium", "Seraphim Station", "Baijini Point"]


def log_lines(spark, d):
    """One line an event; the kind of event, and for clicks its number, says which line. Missions are users and numbers."""
    e = A.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    said, leg = k.cast("string"), (k % 10).cast("string")
    uid = F.concat(F.col("user_id").cast("string"), F.lit("_"), (k % 5).cast("string"))
    ids = F.concat(F.lit("MissionId: [m"), uid, F.lit("]"))
    note = lambda text, rest="": F.concat(F.lit('<SHUDEvent_OnNotification> Added notification "'), text, F.lit('" [7] to queue. New queue size: 1, '), ids, F.lit(rest))
    done = lambda objective: F.concat(F.lit("<ObjectiveComplete> mission_id m"), uid, F.lit(" objective_id "), objective, F.lit(" state MISSION_OBJECTIVE_STATE_COMPLETED"))
    kind = F.col("event_type")
    click = (
        F.when(k < 40, done(F.concat(F.lit("pickup_"), leg, F.lit("_0")))).when(k < 60, done(F.lit("dropoff_1_0")))
        .when(k < 70, F.concat(F.lit("<EndMission> "), ids, F.when(k < 65, " CompletionType[Complete]").otherwise(" CompletionType[Abandon]"), F.lit(" Reason[over]")))
        .when(k < 80, note(F.concat(F.lit("Fined "), said, F.lit(" UEC: late"))))
        .when(k < 90, F.concat(F.lit("<RequestLocationInventory> Player asks at Location[Stanton_Depot_"), leg, F.lit("]")))
        .when(k < 95, F.concat(F.lit("<MissionEnded> noise for mission_id m"), uid)).otherwise(F.concat(F.lit("<Spawn> nothing about "), uid))
    )
    body = (
        F.when(kind == "signup", note(F.concat(F.lit("Contract Accepted: <EM4>[BP]*</EM4> Haul "), said, F.lit(" | Depot "), said, F.lit(" > Port : ")), ", ObjectiveId: []"))
        .when(kind == "view", F.concat(F.lit("<CLocalMissionPhaseMarker::CreateMarker> Creating marker: missionId [m"), uid, F.lit("], generator name [Covalex_Hauling], contract [HaulCargo_AToB_Waste_PressIce_Stanton1_SupplyGrade], contractDefinitionId [d"), said, F.lit("], objectiveId [pickup_"), leg, F.lit("_0], position [x: 1.5, y: -2.0, z: "), said, F.lit(".25]")))
        .when(kind == "purchase", note(F.concat(F.lit("Awarded "), F.floor("paid").cast("string"), F.lit(" aUEC: done"))))
        .when(kind == "error", note(F.concat(F.lit("New Objective: Deliver 0/"), said, F.lit(" SCU of Waste to Everus Harbor:")), ", ObjectiveId: [dropoff_1_0]"))
        .otherwise(click)
    )
    rows = e.select(
        "event_id", F.when(F.col("event_id") % 4 == 0, "live").otherwise("historical").alias("source"), F.lit(0).alias("file_rank"), F.col("event_id").cast("int").alias("line_no"),
        "ts", "props", "event_type", "user_id", "value",
    ).withColumnRenamed("value", "paid")
    body = F.concat(F.lit("<"), stamp, F.lit("Z> [Notice] "), body)
    return P.fenced(rows, value=body).select("event_id", "source", "file_rank", "line_no", "value")


def parse_log_lines(spark, d):
    e = P.parse_lines(log_lines(spark, d).drop("event_id"))
    return e.select(
        "seq", "source", "type", "ts", "mission_id", "objective_id", "kind", "title", "title_pickup", "title_dropoff", "giver", "contract_definition_id", F.col("position.z").alias("z"), "commodity",
        "scu_total", "location", "completion_type", "reason", "amount", "location_id",
    )


PARSED_SQL = """SELECT seq, source, type, ts, CASE WHEN type NOT IN ('payoutAwarded', 'fined', 'locationInventory') THEN 'm' || user_id || '_' || (k % 5) END AS mission_id,
       CASE WHEN type = 'missionMarker' OR (type = 'objectiveCompleted' AND k < 40) THEN 'pickup_' || (k % 10) || '_0' WHEN type IN ('objectiveDeclared', 'objectiveCompleted') THEN 'dropoff_1_0' END AS objective_id,
       CASE type WHEN 'missionMarker' THEN 'pickup' WHEN 'objectiveDeclared' THEN 'dropoff' END AS kind,
       CASE WHEN type = 'missionAccepted' THEN 'Haul ' || k || ' | Depot ' || k || ' > Port' END AS title, CASE WHEN type = 'missionAccepted' THEN 'Depot ' || k END AS title_pickup, CASE WHEN type = 'missionAccepted' THEN 'Port' END AS title_dropoff,
       CASE WHEN type = 'missionMarker' THEN 'Covalex_Hauling' END AS giver, CASE WHEN type = 'missionMarker' THEN 'd' || k END AS contract_definition_id, CASE WHEN type = 'missionMarker' THEN CAST(k AS DOUBLE) + 0.25 END AS z,
       CASE WHEN type = 'objectiveDeclared' THEN 'Waste' END AS commodity, CASE WHEN type = 'objectiveDeclared' THEN k END AS scu_total, CASE WHEN type = 'objectiveDeclared' THEN 'Everus Harbor' END AS location,
       CASE WHEN type = 'missionEnded' THEN CASE WHEN k < 65 THEN 'complete' ELSE 'abandon' END END AS completion_type, CASE WHEN type = 'missionEnded' THEN 'over' END AS reason,
       CASE type WHEN 'payoutAwarded' THEN CAST(floor(value) AS BIGINT) WHEN 'fined' THEN k END AS amount, CASE WHEN type = 'locationInventory' THEN 'Stanton_Depot_' || (k % 10) END AS location_id
FROM (SELECT *, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'live' ELSE 'historical' END AS source, epoch_us(ts0) // 1000 AS ts,
             CASE event_type WHEN 'signup' THEN 'missionAccepted' WHEN 'view' THEN 'missionMarker' WHEN 'purchase' THEN 'payoutAwarded' WHEN 'error' THEN 'objectiveDeclared'
                  ELSE CASE WHEN k < 60 THEN 'objectiveCompleted' WHEN k < 70 THEN 'missionEnded' WHEN k < 80 THEN 'fined' WHEN k < 90 THEN 'locationInventory' END END AS type
      FROM (SELECT * EXCLUDE (ts), ts AS ts0, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)) WHERE type IS NOT NULL"""


def reduced_missions(spark, d):
    m, _, _, _ = E.reduce_events(P.parse_lines(log_lines(spark, d).drop("event_id")))
    return m.select("id", "title", "giver", "variant", "grade", "status", "accepted_at", "completed_at", "terminal_source", "session", "created_seq", "title_pickup", "contract_definition_id")


#: Legs with the first and last completion and the game's last word on the mission; the state of a mission at each completion.
STATES_SQL = f"""p AS ({PARSED_SQL}), f AS (SELECT * FROM p WHERE mission_id IS NOT NULL),
ends AS (SELECT mission_id, arg_max(completion_type, seq) AS completion_type, arg_max(ts, seq) AS end_ts, max(seq) FILTER (WHERE completion_type = 'complete') AS end_seq FROM f WHERE type = 'missionEnded' GROUP BY mission_id),
l AS (SELECT mission_id, objective_id, min(seq) AS first_seq, min(seq) FILTER (WHERE type = 'objectiveCompleted') AS done_seq, max(seq) FILTER (WHERE type = 'objectiveCompleted') AS redone_seq,
             coalesce(arg_max(kind, seq) FILTER (WHERE kind IS NOT NULL), 'dropoff') AS kind, bool_or(type = 'missionMarker') AS marked FROM f WHERE objective_id IS NOT NULL GROUP BY mission_id, objective_id),
looks AS (SELECT e.mission_id, e.seq, e.ts, count(*) FILTER (WHERE l.first_seq <= e.seq) AS legs, count(*) FILTER (WHERE l.done_seq <= e.seq) AS closed
          FROM f e JOIN l ON l.mission_id = e.mission_id WHERE e.type = 'objectiveCompleted' GROUP BY e.mission_id, e.seq, e.ts),
state AS (SELECT mission_id, arg_max(legs > 0 AND legs = closed, seq) AS whole, arg_max(closed, seq) AS closed, coalesce(max(seq) FILTER (WHERE legs <> closed), -1) AS broken FROM looks GROUP BY mission_id),
since AS (SELECT k.mission_id, arg_min(k.ts, k.seq) AS since FROM looks k JOIN state s ON s.mission_id = k.mission_id WHERE k.legs > 0 AND k.legs = k.closed AND k.seq > s.broken GROUP BY k.mission_id)"""
REDUCED_SQL = f"""WITH {STATES_SQL}, m AS (
SELECT mission_id AS id, coalesce(arg_min(title, seq) FILTER (WHERE type = 'missionAccepted'), '') AS title, arg_max(giver, seq) FILTER (WHERE type = 'missionMarker') AS giver,
       CASE WHEN bool_or(type = 'missionMarker') THEN 'A_TO_B' ELSE 'MANUAL' END AS variant, CASE WHEN bool_or(type = 'missionMarker') THEN 'SUPPLY' ELSE 'UNKNOWN' END AS grade,
       coalesce(CASE WHEN arg_min(type, seq) IN ('missionMarker', 'missionAccepted') THEN arg_min(ts, seq) END, arg_min(ts, seq) FILTER (WHERE type = 'missionAccepted')) AS accepted_at,
       CASE WHEN bool_or(source = 'live') THEN 'live' ELSE 'historical' END AS session, min(seq) AS created_seq, arg_min(title_pickup, seq) FILTER (WHERE type = 'missionAccepted') AS title_pickup,
       arg_max(contract_definition_id, seq) FILTER (WHERE type = 'missionMarker') AS contract_definition_id FROM f GROUP BY mission_id)
SELECT m.*, CASE WHEN ends.completion_type = 'complete' THEN 'complete' WHEN ends.completion_type IS NOT NULL THEN 'abandoned' WHEN state.whole THEN 'complete' WHEN state.closed > 0 THEN 'in_progress' ELSE 'accepted' END AS status,
       CASE WHEN ends.completion_type IS NOT NULL THEN end_ts ELSE since END AS completed_at, CASE WHEN ends.completion_type IS NOT NULL THEN 'game' END AS terminal_source
FROM m LEFT JOIN ends ON ends.mission_id = id LEFT JOIN state ON state.mission_id = id LEFT JOIN since ON since.mission_id = id"""


def settled_missions(spark, d):
    """The missions of the parsed log with the payouts that its awards bring them; the window is an hour, as the test
    events are far apart."""
    missions = claims.settled_log(P.parse_lines(log_lines(spark, d).drop("event_id")), 3_600_000)[0]
    return missions.select("id", "payout", "payout_confidence")


SETTLED_SQL = f"""WITH RECURSIVE red AS ({REDUCED_SQL}), pp AS ({PARSED_SQL}), ed AS (SELECT mission_id, max(seq) AS end_seq FROM pp WHERE type = 'missionEnded' GROUP BY mission_id),
    w AS (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM (SELECT amount, ts, min(seq) AS seq FROM pp WHERE type = 'payoutAwarded' GROUP BY ALL)),
    c AS (SELECT list({{'id': id, 't': completed_at, 's': end_seq}} ORDER BY completed_at, end_seq) AS unpaid FROM red JOIN ed ON mission_id = id WHERE status = 'complete' AND terminal_source = 'game' AND giver = 'Covalex_Hauling'),
    s AS (SELECT 0 AS r, unpaid, list_transform(unpaid[1:0], lambda x: x.id) AS near, CAST(0 AS BIGINT) AS amount FROM c
          UNION ALL SELECT r, list_filter(unpaid, lambda x: len(near) = 0 OR x.id <> near[1]), near, amount FROM (
              SELECT w.r, unpaid, w.amount, list_transform(list_filter(unpaid, lambda x: x.t >= w.ts - 3600000 AND x.t <= w.ts AND x.s < w.seq), lambda x: x.id) AS near FROM s JOIN w ON w.r = s.r + 1)),
    n AS (SELECT unnest(near) AS mission_id, generate_subscripts(near, 1) AS place, len(near) AS n, amount FROM s),
    y AS (SELECT mission_id, max(amount) FILTER (WHERE place = 1) AS payout, CASE WHEN max(n) FILTER (WHERE place = 1) = 1 THEN 'confirmed' ELSE 'approximate' END AS sure FROM n GROUP BY mission_id)
    SELECT id, payout, sure AS payout_confidence FROM red LEFT JOIN y ON mission_id = id"""


def reduced_legs(spark, d):
    _, legs, _, _ = E.reduce_events(P.parse_lines(log_lines(spark, d).drop("event_id")))
    return legs.select("mission_id", "objective_id", "kind", "commodity", "scu_total", "scu_delivered", "location", "completed", "pos_z")


REDUCED_LEGS_SQL = f"""WITH {STATES_SQL}, t AS (
SELECT l.*, greatest(redone_seq, CASE WHEN first_seq < end_seq THEN end_seq END) AS gone FROM l LEFT JOIN ends ON ends.mission_id = l.mission_id),
v AS (SELECT f.mission_id, f.objective_id, arg_max(location, seq) FILTER (WHERE type = 'objectiveDeclared') AS location, arg_max(scu_total, seq) FILTER (WHERE type = 'objectiveDeclared') AS scu_total,
             arg_max(scu_total, seq) FILTER (WHERE type = 'objectiveDeclared' AND seq < gone) AS moved, arg_max(z, seq) FILTER (WHERE type = 'missionMarker') AS pos_z
      FROM f JOIN t ON t.mission_id = f.mission_id AND t.objective_id = f.objective_id GROUP BY f.mission_id, f.objective_id),
n AS (SELECT mission_id, kind, count(*) AS n FROM l GROUP BY mission_id, kind),
a AS (SELECT mission_id, arg_min(title_pickup, seq) FILTER (WHERE type = 'missionAccepted') AS title_pickup, arg_min(title_dropoff, seq) FILTER (WHERE type = 'missionAccepted') AS title_dropoff FROM f GROUP BY mission_id HAVING bool_or(type = 'missionMarker'))
SELECT t.mission_id, t.objective_id, t.kind, CASE WHEN v.scu_total IS NOT NULL THEN 'Waste' WHEN t.marked THEN 'Pressurized Ice' ELSE '' END AS commodity, coalesce(v.scu_total, 0) AS scu_total, coalesce(v.moved, 0) AS scu_delivered,
       CASE WHEN v.location IS NULL AND n.n = 1 THEN CASE t.kind WHEN 'pickup' THEN a.title_pickup ELSE a.title_dropoff END ELSE v.location END AS location, t.gone IS NOT NULL AS completed, v.pos_z
FROM t JOIN v ON v.mission_id = t.mission_id AND v.objective_id = t.objective_id JOIN n ON n.mission_id = t.mission_id AND n.kind = t.kind LEFT JOIN a ON a.mission_id = t.mission_id"""


def template_parse(spark, d):
    e = A.table(spark, d, "events").select("event_id", "user_id")
    u = F.col("user_id")
    t = F.when(u % 3 == 0, F.concat(F.lit("HaulCargo_SingleToMulti3_Processed_Mixed_RefinedOre_Stanton"), (u % 4).cast("string"), F.lit("_SupplyGrade"))).when(u % 3 == 1, F.lit("Redwind_Pyro_SmallGrade_Multi2ToSingle_cmat")).otherwise("Other_AToB_BulkGrade")
    return e.withColumn("t", P.template(t)).select("event_id", "t.variant", "t.grade", "t.commodity_token", "t.commodity", P.stored_variant(t).alias("stored_variant"), P.stored_grade(t).alias("stored_grade"))


def title_route(spark, d):
    e = A.table(spark, d, "events").select("event_id", "user_id")
    u = F.col("user_id").cast("string")
    title = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("Rank | <EM3>Stop "), u, F.lit(" [VAR]* > Bay "), u, F.lit(" : </EM3>"))).otherwise(F.concat(F.lit("Big Haul | from Stop "), u, F.lit(" [BP]*")))
    return e.withColumn("r", P.title_route(title)).select("event_id", "r.pickup", "r.dropoff")


#: Internal ids of places and what people write; {n} is a number.
PLACE_IDS = [
    ("Stanton1_DistributionCentre_Hurston_farnes{n}", "HDPC-Farnes{n}"), ("RR_HUR_LEO", "RR-HUR-LEO"), ("Pyro2_big_LAGOON_{n}", "Big Lagoon {n}"), ("stanton_port_tressler", "Port Tressler"), (" Stanton4_NewBabbage_{n} ", "Newbabbage {n}"),
    ("pyro_ABCD_x", "ABCD X"), ("___", "___"), ("Stanton2_distributioncentre_crusader_AB", "CDPC-AB"), ("A1", "A1"), ("ORBITAL_hub  {n}", "Orbital Hub {n}"), ("", ""), ("STANTON_RR_{n}", "RR-{n}"),
]


def humanize(spark, d):
    c = A.table(spark, d, "customer")
    key = F.col("c_custkey")
    raw = F.element_at(F.array(*[F.lit(x) for x, _ in PLACE_IDS]), (key % len(PLACE_IDS) + 1).cast("int"))
    return c.select("c_custkey", P.humanize_location(F.replace(raw, F.lit("{n}"), (key % 900).cast("string"))).alias("place"))


def ocr_objectives(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    n = (F.col("o_custkey") % 600 + 20).cast("string")
    text = F.concat(F.lit("Reward "), (F.col("o_orderkey") * 7 + 12500).cast("string"), F.lit(" aUEC\nHauling from Depot | x\nMax Box Size: 8 SCU\nCollect "), n, F.lit(" SCU of Titanium from Baijini Point.\nDeliver 0/"), n, F.lit(" SCU of Waste to Everus Station above Hurston"))
    c = o.withColumn("c", O.contract(text))
    return c.select(
        "o_orderkey", "c.reward", "c.box_size", F.size("c.objectives").alias("n"), F.col("c.objectives")[0]["scu"].alias("scu"), F.col("c.objectives")[0]["location"].alias("pickup_at"), F.col("c.objectives")[1]["kind"].alias("second"), F.col("c.objectives")[1]["location"].alias("dropoff_at"), "c.title",
    )


#: What is read on after a place, and whether it belongs to it.
ENDINGS = [
    (" to Lorville", False), (" to", True), (" from Bay", False), (" we need it", False), (" we", True), (" is late", False), (" is-7", True), (" are lookingly", False), (" they x", False), (" the refinery", False), (" todayish", True), (" today", False),
    (" Reward 5", False), (" max  box size 8", False), (". More", False), (" above X", False), (" hey you", False), (" good morning", False), (" j", False), (" containers here", False), (" Containerized", True), (" at Hurston's L2", False), (" Lagrange point", False), ("", True),
]


def place_endings(spark, d):
    c = A.table(spark, d, "customer")
    n = F.col("c_custkey")
    read = F.concat(F.lit("* Place "), (n % 90 + 10).cast("string"), F.element_at(F.array(*[F.lit(e) for e, _ in ENDINGS]), (n % len(ENDINGS) + 1).cast("int")))
    return c.select("c_custkey", O.trim_destination(read).alias("place"))


def ocr_numbers(spark, d):
    e = A.table(spark, d, "events")
    return e.select("event_id", O.ocr_number(F.translate(F.concat(F.lit("x"), F.col("event_id").cast("string")), "018", "OlB")).alias("n"))


def redact_documents(spark, d):
    e = A.table(spark, d, "events")
    line = F.concat(F.lit("Player[name"), F.col("user_id").cast("string"), F.lit("] PlayerId[2"), F.col("user_id").cast("string"), F.lit("] at C:\\Users\\me"), F.col("user_id").cast("string"), F.lit("\\log saw name"), F.col("user_id").cast("string"), F.lit("[2"), F.col("user_id").cast("string"), F.lit("] JOE"))
    lines = e.select(F.col("user_id").alias("log"), F.col("event_id").alias("seq"), line.alias("value"))
    return D.redacted_lines(lines, ["log"], user="joe").select("seq", "value")


def mission_lines(spark, d):
    return P.last_lines(log_lines(spark, d).drop("event_id")).select("line_no", "source")


def location_changes(spark, d):
    e = A.table(spark, d, "events")
    events = e.select("user_id", F.col("event_id").alias("seq"), F.lit("locationInventory").alias("type"), F.when(F.col("event_id") % 4 == 0, "live").otherwise("historical").alias("source"), F.concat(F.lit("Stanton1_"), F.col("event_type")).alias("location_id"))
    return P.location_changes(events, ["user_id"])


def _dictionary(spark):
    return spark.createDataFrame(list(enumerate(NAMES)), "idx int, value string")


def _noisy(spark, d):
    p = A.table(spark, d, "part").select("p_partkey")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % len(NAMES)).cast("int") + 1)
    return p.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.regexp_replace(F.translate(name, "iol", "10I"), "m\\z", "rn")).when(F.col("p_partkey") % 5 == 1, F.substring(name, 1, 6)).otherwise(name).alias("input"))


def fuzzy_confusable(spark, d):
    return fuzzy.fuzzy_match(_noisy(spark, d), _dictionary(spark)).select("p_partkey", "input", "match", F.round("score", 6).alias("score"))


def title_margin(spark, d):
    return fuzzy.title_match(_noisy(spark, d), _dictionary(spark)).select("p_partkey", F.round("score", 6).alias("score"), "confident")


QUERIES = {
    "parse_log_lines": parse_log_lines, "reduced_missions": reduced_missions, "settled_missions": settled_missions, "reduced_legs": reduced_legs, "template_parse": template_parse, "title_route": title_route, "humanize_location": humanize,
    "ocr_objectives": ocr_objectives, "place_endings": place_endings, "ocr_number": ocr_numbers, "redact_documents": redact_documents, "mission_lines": mission_lines, "current_location_changes": location_changes,
    "fuzzy_match_confusable": fuzzy_confusable, "title_match_margin": title_margin,
}
_N = "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"
_DICT = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES)) + ") AS t(idx, value)"
ORACLE_SQL = {
    "parse_log_lines": PARSED_SQL, "reduced_missions": REDUCED_SQL, "settled_missions": SETTLED_SQL, "reduced_legs": REDUCED_LEGS_SQL,
    "mission_lines": """SELECT CAST(event_id AS INTEGER) AS line_no, CASE WHEN event_id % 4 = 0 THEN 'live' ELSE 'historical' END AS source FROM events
        WHERE event_type <> 'click' OR CAST(json_extract_string(props, '$.k') AS BIGINT) < 95 ORDER BY event_id DESC LIMIT 2000""",
    "template_parse": """SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'SINGLE_TO_MULTI' WHEN 1 THEN 'MULTI_TO_SINGLE' ELSE 'A_TO_B' END AS variant, CASE user_id % 3 WHEN 0 THEN 'SUPPLY' WHEN 1 THEN 'SMALL' ELSE 'BULK' END AS grade,
        CASE user_id % 3 WHEN 0 THEN 'RefinedOre' WHEN 1 THEN 'cmat' ELSE '' END AS commodity_token, CASE user_id % 3 WHEN 0 THEN 'Refined Ore' WHEN 1 THEN 'Construction Materials' ELSE '' END AS commodity,
        CASE user_id % 3 WHEN 0 THEN 'SINGLE_TO_MULTI' WHEN 1 THEN 'MULTI_TO_SINGLE' ELSE 'A_TO_B' END AS stored_variant, CASE user_id % 3 WHEN 0 THEN 'SUPPLY' WHEN 1 THEN 'SMALL' ELSE 'BULK' END AS stored_grade FROM events""",
    "title_route": "SELECT event_id, 'Stop ' || user_id AS pickup, CASE WHEN user_id % 2 = 0 THEN 'Bay ' || user_id END AS dropoff FROM events",
    "humanize_location": "SELECT c_custkey, replace([" + ", ".join(f"'{x}'" for _, x in PLACE_IDS) + f"][c_custkey % {len(PLACE_IDS)} + 1], '{{n}}', CAST(c_custkey % 900 AS VARCHAR)) AS place FROM customer",
    "ocr_objectives": """SELECT o_orderkey, o_orderkey * 7 + 12500 AS reward, CAST(8 AS BIGINT) AS box_size, 2 AS n, o_custkey % 600 + 20 AS scu, 'Baijini Point' AS pickup_at, 'dropoff' AS second, 'Everus Station' AS dropoff_at, 'Hauling from Depot | x' AS title FROM orders""",
    "place_endings": "SELECT c_custkey, 'Place ' || (c_custkey % 90 + 10) || [" + ", ".join("'" + (e if kept else "") + "'" for e, kept in ENDINGS) + f"][c_custkey % {len(ENDINGS)} + 1] AS place FROM customer",
    "ocr_number": "SELECT event_id, event_id AS n FROM events",
    "redact_documents": r"SELECT event_id AS seq, 'Player[<PLAYER>] PlayerId[<PLAYERID>] at C:\Users\<USER>\log saw <PLAYER>[<PLAYERID>] <USER>' AS value FROM events",
    "current_location_changes": """SELECT user_id, event_id AS seq, upper(event_type[1]) || event_type[2:] AS location, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS changed FROM events WHERE event_id % 4 = 0""",
    "fuzzy_match_confusable": f"""WITH RECURSIVE i AS (SELECT p_partkey, {_N} AS name FROM part),
        n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN regexp_replace(translate(name, 'iol', '10I'), 'm$', 'rn') WHEN 1 THEN name[1:6] ELSE name END AS input FROM i),
        k AS (SELECT DISTINCT regexp_replace(lower(input), '[^a-z0-9]', '', 'g') AS a FROM n), c AS (SELECT idx, value, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') AS b FROM {_DICT}),
        t AS (SELECT a, b, idx, value, 0 AS s, CAST([] AS DOUBLE[]) AS d FROM k, c
              UNION ALL SELECT a, b, idx, value, s + 1, list_append(d, CASE WHEN i = 0 THEN CAST(j AS DOUBLE) WHEN j = 0 THEN CAST(i AS DOUBLE) ELSE least(
                  d[s - w + 1] + 1, d[s] + 1,
                  d[s - w] + CASE WHEN a[i] = b[j] THEN 0 WHEN len(list_filter(['il1', 'o0', 's5', 'b8', 'g9q'], lambda g: contains(g, a[i]) AND contains(g, b[j]))) > 0 THEN 0.4 ELSE 1 END,
                  CASE WHEN i > 1 AND a[i - 1:i] = 'rn' AND b[j] = 'm' THEN d[s - 2 * w] + 0.4 ELSE 1e9 END, CASE WHEN j > 1 AND b[j - 1:j] = 'rn' AND a[i] = 'm' THEN d[s - w - 1] + 0.4 ELSE 1e9 END) END)
              FROM (SELECT *, length(b) + 1 AS w, s // (length(b) + 1) AS i, s % (length(b) + 1) AS j FROM t) WHERE s < (length(a) + 1) * w),
        e AS (SELECT a, idx, value, greatest(greatest(0, 1 - d[-1] / greatest(length(a), length(b))), CASE WHEN least(length(a), length(b)) >= 3 AND (contains(a, b) OR contains(b, a)) THEN 0.5 + 0.5 * least(length(a), length(b)) / greatest(length(a), length(b)) ELSE 0 END) AS score
              FROM t WHERE s = (length(a) + 1) * (length(b) + 1)),
        m AS (SELECT a, arg_min(value, (-score, idx)) AS value, max(score) AS score FROM e GROUP BY a)
        SELECT p_partkey, input, CASE WHEN score >= 0.6 THEN value END AS match, round(score, 6) AS score FROM n JOIN m ON a = regexp_replace(lower(input), '[^a-z0-9]', '', 'g')""",
    "title_match_margin": f"""WITH i AS (SELECT p_partkey, {_N} AS name FROM part),
        n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN regexp_replace(translate(name, 'iol', '10I'), 'm$', 'rn') WHEN 1 THEN name[1:6] ELSE name END AS input FROM i),
        k AS (SELECT p_partkey, regexp_replace(lower(input), '[^a-z0-9]', '', 'g') AS key FROM n), c AS (SELECT idx, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') AS e FROM {_DICT}),
        s AS (SELECT p_partkey, idx, 1 - levenshtein(key, e) / CAST(greatest(length(key), length(e)) AS DOUBLE) AS score FROM k, c),
        r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY p_partkey ORDER BY score DESC, idx))
        SELECT p_partkey, round(score, 6) AS score, score >= 0.6 AND (nxt IS NULL OR score - nxt >= 0.08) AS confident FROM r WHERE place = 1""",
}
