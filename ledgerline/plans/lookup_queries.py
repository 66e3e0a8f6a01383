"""Dimension tables, lookups, manual entries and checks of routes over the relational tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import fuzzy, scalars as S
from ledgerline.operators import capture, mining as M, mutate, reports, route as R, salvage as V
from ledgerline.plans import adapter as A, graph_queries as G
from ledgerline.sources import reference, worksheets as W
from ledgerline.sources.scratch import written
from ledgerline.sources.sizes import spread

HOUR = 3_600_000
KINDS = ["station", "city", "terminal", "nothing"]
_pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
_sql_pick = lambda values, n: f"[{', '.join(repr(v) for v in values)}][({n}) % {len(values)} + 1]"


def rock_values(spark, d):
    return M.rock_values(G._rocks(spark, d), " An ", None, G._deposits(spark, d), M.regions_of("Crusader")).select("name", "rank")


def searched_rocks(spark, d):
    return M.search_rocks(G._rocks(spark, d), "1, 500").select("name", "tier", "delta")


def rocks_of_table(spark, d):
    n = F.col("p_partkey")
    t = A.table(spark, d, "part").select(F.concat(F.lit("  "), "p_name", F.lit(" "), n.cast("string")).alias("RockName"), F.concat(F.lit(" "), _pick(["Common", "Rare"], n)).alias("Rarity"), *[(n * i).cast("string").alias(str(i)) for i in range(1, 7)])
    return reference.rocks_of(t).select("name", "rarity", F.array_join(F.transform("scan_values", lambda x: x.cast("long").cast("string")), ",").alias("scan"))


def deposits_of_table(spark, d):
    n = F.col("p_partkey")
    t = A.table(spark, d, "part").select(F.when(n % 13 == 0, " ").otherwise(F.concat("p_name", F.lit(" "), n.cast("string"))).alias("Name"), F.concat("p_type", F.lit(" ")).alias("Type"), F.when(n % 4 > 0, F.concat(F.lit("Daymar, ,"), F.lit(" L"), (n % 5).cast("string"))).alias("FoundAt"))
    return reference.deposits_of(t).select("name", "type", F.array_join("found_at", "|").alias("places"))


def terminals(spark, d):
    n = F.col("s_suppkey")
    t = A.table(spark, d, "supplier").select(
        F.when(n % 11 > 0, F.col("s_name")).alias("name"), F.when(n % 2 == 0, F.col("s_name")).alias("displayname"), F.lit(None).cast("string").alias("nickname"), _pick(["1", "0", "true", "no"], n).alias("is_cargo_center"),
        _pick(["32", "x", "8.0"], n).alias("max_container_size"), _pick(KINDS, n).alias("type"),
    )
    return reference.terminals_of(t)


def ships(spark, d):
    n = F.col("p_partkey")
    return reference.ships_of(A.table(spark, d, "part").select(F.concat(F.lit("ship"), n.cast("string")).alias("name"), F.when(n % 3 > 0, (n % 50 - 5).cast("string")).otherwise("many").alias("scu")))


def venues(spark, d):
    n = F.col("c_custkey")
    name = F.concat(F.lit("Shop "), n.cast("string"), _pick([" - North Spaceport - Area 1", " - Hall - Area 1", " - Port Two", " -  - Landing Zone - City", " S1DC0 depot", " Cargo Center"], n))
    return A.table(spark, d, "customer").select("c_custkey", reference.venue_of(name).alias("venue"), reference.is_distribution_point(name).alias("distribution"))


def merged_locations(spark, d):
    """Suppliers' names in two sources, the second one in capitals."""
    n = F.col("s_suppkey")
    row = lambda name, at: A.table(spark, d, "supplier").select(name.alias("name"), (n % 2 == at).alias("is_cargo_center"), _pick(["terminal", "city", "station"], n + at).alias("type"), F.when((n + at) % 3 == 0, n.cast("int")).alias("max_container_size"), (n * 2 + at).alias("at"))
    return reference.merged_locations(row(F.concat(F.lit("Place "), (n % 40).cast("string")), 0), row(F.concat(F.lit("PLACE "), (n % 40).cast("string")), 1))


def worksheet_ships(spark, d):
    """A book a nation, its suppliers dealt to two blocks of ships, and for each fifth nation one that stands apart."""
    return W.ships(_cells(spark, d)).select("book", "name", "cost_tier", "claim_cost_org", "cmat", "cargo_scu", "shield", F.array_join("weapons", ",").alias("weapons"))


def _cells(spark, d):
    from pyspark.sql.window import Window

    s = A.table(spark, d, "supplier").withColumn("half", F.col("s_suppkey") % 2)
    key = F.col("s_suppkey")
    s = s.withColumn("col", (F.row_number().over(Window.partitionBy("s_nationkey", "half").orderBy("s_suppkey")) + 1).cast("int"))
    cell = lambda row, text=None, number=None, col=None: F.struct(F.lit(row).alias("row"), (F.col("col") if col is None else col if hasattr(col, "alias") else F.lit(col)).alias("col"), F.lit(text).cast("string").alias("text") if not hasattr(text, "alias") else text.alias("text"), (number if number is not None else F.lit(None)).cast("double").alias("number"))
    body = [cell(3, F.col("s_name")), cell(4, None, F.when(key % 3 > 0, key % 50)), cell(5, F.when(key % 4 == 0, "soon"), F.when(key % 4 > 0, key % 9)), cell(6, F.concat(F.lit("gun "), key.cast("string"))), cell(7, F.when(key % 2 == 1, "laser")), cell(8, None, key % 7), cell(10, F.lit("lost"))]
    cells = s.select(F.col("s_nationkey").cast("string").alias("book"), "half", F.inline(F.array(*body)))
    heads = s.select(F.col("s_nationkey").cast("string").alias("book"), "half").distinct()
    labels = [(1, None), (3, "Ship"), (4, "Cargo SCU"), (5, "CMAT"), (6, "Weapon"), (8, "Shield"), (9, "Notes")]
    first = heads.select("book", "half", F.inline(F.array(*[cell(r, F.when(F.col("half") == 0, "Cost : 1,300 (150)").otherwise("Cost : 600 (300)") if x is None else x, col=1) for r, x in labels])))
    beyond = s.groupBy(F.col("s_nationkey").cast("string").alias("book")).agg((F.max("col") + 1).alias("edge"))  # right of all ships, however many
    label, value = F.col("edge") + 1, F.col("edge") + 2
    box = [cell(2, "Ship", col=label), cell(2, F.concat(F.lit("raft "), "book"), col=value), cell(3, "CMAT", col=label), cell(3, None, F.lit(4.5), col=value), cell(4, "Weapon", col=label), cell(4, "bow", col=value)]
    apart = heads.filter("half = 0 AND cast(book AS int) % 5 = 0").join(beyond, "book").select("book", "half", F.inline(F.array(*box)))
    both = cells.unionByName(first).unionByName(apart)
    return both.select("book", F.lit(W.TRACKING).alias("sheet"), (F.col("row") + 20 * F.col("half")).cast("int").alias("row"), F.col("col").cast("int").alias("col"), "text", "number")


def route_stops(spark, d):
    legs = A.legs(spark, d).select("*", *[F.lit(0.0).alias(f"pos_{c}") for c in "xyz"])
    return R.stops(A.missions(spark, d), legs).select("stop_id", "kind", "location", "scu", "mission_id")


def route_start(spark, d):
    """The ship stands at a place whose name is written otherwise."""
    return R.start_position(G._visits(spark, d), F.lit(" PLACE3 ")).select("problem_id", *[F.round(f"start.{c}", 6).alias(c) for c in "xyz"])


def route_checks(spark, d):
    """Whether the given order of a problem's stops fits a ship of 120 and its precedences."""
    v = G._visits(spark, d)
    p, q = v.filter("kind = 'pickup'"), v.filter("kind = 'dropoff'")
    pairs = q.select("problem_id", "mission_id", F.col("stop_id").alias("dropoff")).join(p.select("problem_id", "mission_id", F.col("stop_id").alias("pickup")), ["problem_id", "mission_id"])
    fits = R.capacity_ok(v, 120).withColumnRenamed("ok", "fits")
    return fits.join(R.precedence_ok(v, pairs).withColumnRenamed("ok", "follows"), "problem_id")


def manual_missions(spark, d):
    c = A.table(spark, d, "customer")
    n = F.col("c_custkey")
    legs = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit("Waste").alias("commodity"), (n % 9 + i).alias("scu_total"), F.lit("Depot").alias("location")) for i, k in enumerate(("pickup", "dropoff"))])
    drafts = c.filter(n % 3 == 0).select(F.concat(F.lit("x"), n.cast("string")).alias("id"), "c_name", F.lit("me").alias("giver"), n.alias("at"), (n + 10_000_000).alias("created_seq"), legs.alias("legs")).withColumnRenamed("c_name", "title")
    m, l = mutate.with_manual_missions(A.missions(spark, d), A.legs(spark, d), drafts)
    new = l.filter(F.col("objective_id").startswith("manual_leg_")).groupBy(F.col("mission_id").alias("id")).agg(F.sum("scu_total").alias("scu"), F.count(F.lit(1)).alias("legs"))
    return m.join(new, "id", "left").select("id", "title", "source", "status", "created_seq", "scu", "legs")


def manual_drafts(spark, d):
    t = A.table(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 == 0, "  ").when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), "c_name")).alias("title"))
    return reports.manual_drafts(t).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


def updated_runs(spark, d):
    runs = G._runs(spark, d).withColumn("completed_at", F.when(F.col("id") % 2 == 0, F.lit(5).cast("long")))
    n = F.col("id")
    patches = runs.filter(n % 3 == 0).select("id", n.alias("at"), _pick(["sold", "active", "odd"], n / 3).alias("status"), F.when(n % 2 == 0, n % 4 - 2).alias("crew_size"), F.when(n % 5 == 0, n.cast("double")).alias("rmc_scu"))
    return V.updated_runs(runs, patches).select("id", "status", "crew_size", "rmc_scu", "completed_at")


def begun_runs(spark, d):
    """Runs begun by customers beside those that there are, by crew and state."""
    n = F.col("c_custkey")
    drafts = A.table(spark, d, "customer").select((n + 50_000_000).alias("id"), n.alias("at"), n.alias("created_seq"), F.when(n % 3 > 0, n % 7 - 2.5).alias("crew_size"), F.when(n % 2 == 0, n * 0.5).alias("rmc_scu"))
    out = V.with_runs(G._runs(spark, d), drafts)
    return out.groupBy("crew_size", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("rmc_scu").alias("rmc"))


def stripped_commands(spark, d):
    """Components patched, and others added to runs, some of which there are not."""
    rows = A.table(spark, d, "lineitem").count()
    s = spread(G._stripped(spark, d).filter("qty > 10"), rows, "run_id", "id").dropDuplicates(["run_id", "id"])
    patches = s.filter("qty % 4 = 0").select("run_id", "id", (F.col("qty") - 20.5).alias("qty"), F.when(F.col("qty") % 8 == 0, True).alias("sold"))
    n = F.col("c_custkey")
    added = A.table(spark, d, "customer").select((n * 40).alias("run_id"), n.cast("string").alias("id"), F.lit("radar").alias("type"), F.lit("new").alias("model"), (n % 9 - 4).alias("qty"), (n % 5 - 2).alias("sell_price_each"), F.when(n % 2 == 0, True).alias("sold"))
    out = V.with_stripped(V.patched_stripped(s, patches), added, G._runs(spark, d))
    return out.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.sum("sell_price_each").alias("price"), F.count(F.when(F.col("sold"), 1)).alias("sold"))


def priced_components(spark, d):
    """Stripped components with the price that the reference has for their type and model, whole and not negative."""
    c = A.table(spark, d, "part").filter("p_partkey < 5").select(F.lit("weapon").alias("type"), F.concat(F.lit("model"), F.col("p_partkey").cast("string")).alias("model"), (F.col("p_partkey") * 7).alias("sell_price"))
    s = V.cleaned_stripped(G._stripped(spark, d).withColumn("qty", F.col("qty") - 20).withColumn("sell_price_each", F.col("sell_price_each") - 1500))
    out = V.with_reference_price(s, c)
    return out.groupBy("type", "model", "reference_price").agg(F.sum("qty").alias("qty"), F.sum("sell_price_each").alias("price"), F.count(F.lit(1)).alias("n"))


def next_salvage_number(spark, d):
    s = G._stripped(spark, d).select((F.col("run_id") * 3).alias("created_seq"))
    return V.next_created_seq(G._runs(spark, d), s, s.select((F.col("created_seq") - 1).alias("created_seq")))


def newest_run(spark, d):
    return V.current_run(G._runs(spark, d)).select("id", "started_at")


def run_history(spark, d):
    return V.run_history(G._runs(spark, d)).select("id", S.run_date(F.col("started_at")).alias("date"))


def searched_components(spark, d):
    c = A.table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return V.search(c, " ECO ", ["p_name", "p_type"]).select("p_partkey")


def next_brackets(spark, d):
    """Of each order the share of its size that is delivered, what it pays and what is needed for the next bracket."""
    t = A.legs(spark, d).groupBy("mission_id").agg(F.sum("scu_total").alias("total"), F.sum(F.when(F.col("completed"), F.col("scu_total")).otherwise(F.col("scu_delivered"))).alias("done"))
    ratio = F.col("done") / F.col("total")
    return t.select("mission_id", S.partial_payout(F.lit(100_000), F.col("done"), F.col("total")).alias("pays"), S.next_bracket(ratio).alias("next"))


def applied_objectives(spark, d):
    """Of every fifth order objectives read for a third of its open lines, with new sizes, and one of nothing known, which
    takes the first open dropoff that is left or is inserted."""
    legs = A.legs(spark, d).filter(F.col("mission_id").cast("long") % 5 == 0).withColumn("manual_override", F.lit(None).cast("long"))
    legs = written(legs, "objectives-legs")  # read three times
    some = legs.filter(~F.col("completed") & (F.col("scu_total") % 3 == 0)).select("mission_id", F.col("objective_id").cast("int").alias("pos"), "kind", "commodity", (F.col("scu_total") + 1).alias("scu"), "location")
    odd = legs.select("mission_id").distinct().select("mission_id", F.lit(999).alias("pos"), F.lit("dropoff").alias("kind"), F.lit("Nothing known").alias("commodity"), F.lit(7).cast("long").alias("scu"), F.lit("Nowhere").alias("location"))
    return capture.applied_objectives(legs, some.unionByName(odd), 5)


def reviewed_captures(spark, d):
    """Captures of three ages; a mission of their id or of their title and day."""
    n = F.col("c_custkey")
    now = 10_000_000
    p = A.table(spark, d, "customer").select(
        n.alias("pending_id"), F.when(n % 4 == 0, n.cast("string")).otherwise("none").alias("mission_id"), F.concat(F.lit("haul "), _pick(["1-urgent", "nothing"], n)).alias("title"), (F.lit(800_000_000_000) + n * 86_400_000).alias("ts"),
        (F.lit(now) - _pick([1000, 5000, 70_000], n)).cast("long").alias("enqueued_at"), (n % 5 == 0).alias("reviewed_once"),
    )
    return capture.reconciled(p, A.missions(spark, d), now, review_open=False).select("pending_id", "state")


def preselected(spark, d):
    """Titles with the mission to preselect: the given one, or a sure match's."""
    n = F.col("n_nationkey")
    names = A.table(spark, d, "nation").select(n.cast("string").alias("id"), F.col("n_name").alias("value"), n.alias("idx"))
    inputs = A.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("nation "), (F.col("c_custkey") % 25).cast("string")).alias("input"), F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 40).cast("string")).alias("preselect_id"))
    return fuzzy.preselected(fuzzy.title_match(inputs, names), names).select("c_custkey", "target")


QUERIES = {
    "rock_value_table": rock_values, "rock_search_by_value": searched_rocks, "rocks_of_table": rocks_of_table, "deposits_of_table": deposits_of_table, "terminals_of_table": terminals, "ships_of_table": ships, "venues": venues,
    "merged_locations": merged_locations, "worksheet_ships": worksheet_ships, "route_stops": route_stops, "route_start": route_start, "route_checks": route_checks, "manual_missions": manual_missions, "manual_drafts": manual_drafts,
    "salvage_runs_updated": updated_runs, "salvage_runs_begun": begun_runs, "salvage_stripped_commands": stripped_commands, "salvage_reference_prices": priced_components, "salvage_next_number": next_salvage_number, "salvage_newest_run": newest_run, "salvage_history": run_history, "component_search": searched_components,
    "next_payout_bracket": next_brackets, "captures_reviewed": reviewed_captures, "objectives_applied": applied_objectives, "title_preselected": preselected,
}
_NEAR = 30_000
ORACLE_SQL = {
    "rock_value_table": f"WITH {G._ROCKS} SELECT name, CAST(rk AS INTEGER) AS rank FROM rocks WHERE contains(lower(name), 'an') AND (p_partkey % 2 = 0 OR p_partkey % 3 = 0)",
    "rock_search_by_value": f"WITH {G._ROCKS} SELECT name, CAST(i AS INTEGER) AS tier, abs(1500 - base * i) AS delta FROM rocks, range(1, 7) AS r(i) WHERE abs(1500 - base * i) <= base * i * 0.01",
    "rocks_of_table": "SELECT p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Common' ELSE 'Rare' END AS rarity, array_to_string([p_partkey * i for i in range(1, 7)], ',') AS scan FROM part",
    "deposits_of_table": "SELECT p_name || ' ' || p_partkey AS name, p_type AS type, CASE WHEN p_partkey % 4 > 0 THEN 'Daymar|L' || (p_partkey % 5) ELSE '' END AS places FROM part WHERE p_partkey % 13 > 0",
    "terminals_of_table": f"""SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS displayname, '' AS nickname, s_suppkey % 4 IN (0, 2) AS is_cargo_center, CASE s_suppkey % 3 WHEN 0 THEN 32 WHEN 2 THEN 8 END AS max_container_size,
        nullif({_sql_pick(KINDS, 's_suppkey')}, 'nothing') AS type FROM supplier WHERE s_suppkey % 11 > 0""",
    "ships_of_table": "SELECT 'ship' || p_partkey AS name, CAST(p_partkey % 50 - 5 AS INTEGER) AS scu FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 50 > 5",
    "venues": "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'North Spaceport' WHEN 3 THEN 'Landing Zone' END AS venue, c_custkey % 6 IN (4, 5) AS distribution FROM customer",
    "merged_locations": """WITH s AS (SELECT s_suppkey AS k, x, k % 40 AS p, k * 2 + x AS nr, k % 2 = x AS cargo, ['terminal', 'city', 'station'][(k + x) % 3 + 1] AS type, CASE WHEN (k + x) % 3 = 0 THEN k END AS size FROM supplier, (VALUES (0), (1)) AS t(x))
        SELECT arg_min(CASE WHEN x = 0 THEN 'Place ' ELSE 'PLACE ' END || p, nr) AS name, bool_or(cargo) AS is_cargo_center, coalesce(arg_min(type, nr) FILTER (WHERE type <> 'terminal'), 'terminal') AS type, CAST(arg_min(size, nr) FILTER (WHERE size IS NOT NULL) AS INTEGER) AS max_container_size FROM s GROUP BY p""",
    "worksheet_ships": """SELECT CAST(s_nationkey AS VARCHAR) AS book, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 1300 ELSE 600 END AS cost_tier, CASE WHEN s_suppkey % 2 = 0 THEN 150 ELSE 300 END AS claim_cost_org, CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey % 9 AS DOUBLE) END AS cmat,
               CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 50 AS DOUBLE) END AS cargo_scu, CAST(s_suppkey % 7 AS VARCHAR) AS shield, concat('gun ', s_suppkey, CASE WHEN s_suppkey % 2 = 1 THEN ',laser' END) AS weapons FROM supplier
        UNION ALL SELECT DISTINCT CAST(s_nationkey AS VARCHAR), 'raft ' || s_nationkey, 500, 250, 4.5, NULL, NULL, 'bow' FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey % 5 = 0""",
    "route_stops": f"WITH {A.SQL_MISSIONS}, {A.SQL_LEGS} SELECT mission_id || ':' || objective_id AS stop_id, kind, location, scu_total AS scu, mission_id FROM legs JOIN missions ON id = mission_id WHERE status IN ('accepted', 'in_progress') AND NOT completed",
    "route_start": f"WITH {G._VISITS} SELECT problem_id, round(arg_min(x, stop_id), 6) AS x, round(arg_min(y, stop_id), 6) AS y, round(arg_min(z, stop_id), 6) AS z FROM v WHERE location = 'place3' AND x IS NOT NULL GROUP BY problem_id",
    "route_checks": f"""WITH {G._VISITS}, w AS (SELECT *, CAST(stop_id[2:] AS BIGINT) % 4 AS m FROM v),
        s AS (SELECT problem_id, place, kind, sum(CASE WHEN kind = 'pickup' THEN scu ELSE -scu END) OVER (PARTITION BY problem_id ORDER BY place) AS s FROM w), l AS (SELECT problem_id, kind, s - least(0, min(s) OVER (PARTITION BY problem_id ORDER BY place)) AS load FROM s),
        b AS (SELECT DISTINCT p.problem_id FROM w p JOIN w d ON p.problem_id = d.problem_id AND p.m = d.m AND p.kind = 'pickup' AND d.kind = 'dropoff' AND p.place >= d.place)
        SELECT problem_id, coalesce(max(load) FILTER (WHERE kind = 'pickup'), 0) <= 120 AS fits, problem_id NOT IN (SELECT problem_id FROM b) AS follows FROM l GROUP BY problem_id""",
    "manual_missions": f"""WITH {A.SQL_MISSIONS} SELECT id, title, NULL AS source, status, created_seq, NULL AS scu, NULL AS legs FROM missions
        UNION ALL SELECT 'x' || c_custkey, c_name, 'manual', 'accepted', c_custkey + 10000000, 2 * (c_custkey % 9) + 1, 2 FROM customer WHERE c_custkey % 3 = 0""",
    "manual_drafts": f"SELECT CASE WHEN c_custkey % 3 = 1 THEN c_name ELSE '{reports.DEFAULT_TITLE}' END AS title, count(*) AS n FROM customer GROUP BY 1",
    "salvage_runs_updated": """WITH r AS (SELECT o_orderkey AS id, CAST(o_orderkey % 5 AS INTEGER) AS crew, CASE WHEN o_orderstatus = 'F' THEN 'sold' ELSE 'active' END AS status, CAST(o_custkey % 20 AS DOUBLE) AS rmc, CASE WHEN o_orderkey % 2 = 0 THEN 5 END AS done FROM orders),
        p AS (SELECT *, CASE WHEN id % 3 = 0 THEN ['sold', 'active', 'active'][CAST(floor(id / 3) AS BIGINT) % 3 + 1] END AS new FROM r)
        SELECT id, coalesce(new, status) AS status, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN greatest(1, CAST(id % 4 - 2 AS INTEGER)) ELSE crew END AS crew_size, CASE WHEN id % 3 = 0 AND id % 5 = 0 THEN CAST(id AS DOUBLE) ELSE rmc END AS rmc_scu,
               CASE WHEN new IS NULL THEN done WHEN new = 'active' THEN NULL ELSE coalesce(done, id) END AS completed_at FROM p""",
    "salvage_runs_begun": """WITH r AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS crew_size, CASE WHEN o_orderstatus = 'F' THEN 'sold' ELSE 'active' END AS status, CAST(o_custkey % 20 AS DOUBLE) AS rmc FROM orders
            UNION ALL SELECT CASE WHEN c_custkey % 3 > 0 THEN greatest(1, CAST(trunc(c_custkey % 7 - 2.5) AS INTEGER)) ELSE 1 END, 'active', CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 0.5 ELSE 0 END FROM customer)
        SELECT crew_size, status, count(*) AS n, sum(rmc) AS rmc FROM r GROUP BY ALL""",
    "salvage_stripped_commands": """WITH s AS (SELECT DISTINCT l_orderkey AS run_id, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_extendedprice, l_returnflag = 'R' AS sold FROM lineitem WHERE CAST(l_quantity AS BIGINT) > 10),
        e AS (SELECT run_id, CASE WHEN q % 4 = 0 THEN greatest(0, CAST(trunc(q - 20.5) AS BIGINT)) ELSE q END AS qty, (l_suppkey % 5) * 1000 AS price, sold OR q % 8 = 0 AS sold FROM s
              UNION ALL SELECT c_custkey * 40, greatest(0, c_custkey % 9 - 4), greatest(0, c_custkey % 5 - 2), c_custkey % 2 = 0 FROM customer WHERE c_custkey * 40 IN (SELECT o_orderkey FROM orders))
        SELECT run_id, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(price) AS BIGINT) AS price, count(*) FILTER (WHERE sold) AS sold FROM e GROUP BY run_id""",
    "salvage_reference_prices": """WITH s AS (SELECT ['weapon','powerplant','shield','quantumdrive','cooler','radar'][l_linenumber % 6 + 1] AS type, 'model' || (l_partkey % 9) AS model, greatest(0, CAST(l_quantity AS BIGINT) - 20) AS q, greatest(0, (l_suppkey % 5) * 1000 - 1500) AS price, l_partkey % 9 AS k FROM lineitem),
        c AS (SELECT 'weapon' AS type, 'model' || p_partkey AS model, p_partkey * 7 AS reference_price FROM part WHERE p_partkey < 5)
        SELECT type, model, reference_price, CAST(sum(q) AS BIGINT) AS qty, CAST(sum(price) AS BIGINT) AS price, count(*) AS n FROM s LEFT JOIN c USING (type, model) GROUP BY ALL""",
    "salvage_next_number": "SELECT greatest((SELECT max(o_orderkey) FROM orders), (SELECT max(l_orderkey) * 3 FROM lineitem)) AS created_seq",
    "salvage_newest_run": "SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000 AS started_at FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderkey DESC LIMIT 1",
    "salvage_history": "SELECT o_orderkey AS id, strftime(o_orderdate, '%b %-d, %I:%M %p') AS date FROM orders WHERE o_orderstatus = 'F'",
    "component_search": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'eco') OR contains(lower(p_type), 'eco')",
    "next_payout_bracket": f"""WITH {A.SQL_LEGS}, t AS (SELECT mission_id, sum(CASE WHEN completed THEN scu_total ELSE scu_delivered END) / CAST(sum(scu_total) AS DOUBLE) AS r FROM legs GROUP BY mission_id)
        SELECT mission_id, CAST(floor(100000 * CASE WHEN r >= 1 THEN 1 WHEN r > 0.75 THEN 0.76 WHEN r > 0.5 THEN 0.45 WHEN r > 0.25 THEN 0.15 ELSE 0 END / 250 + 0.5) * 250 AS BIGINT) AS pays,
               CASE WHEN r >= 1 THEN NULL WHEN r > 0.75 THEN 1.0 WHEN r > 0.5 THEN 0.75 WHEN r > 0.25 THEN 0.5 ELSE 0.25 END AS next FROM t""",
    "captures_reviewed": f"""WITH {A.SQL_MISSIONS}, p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'haul 1-urgent' ELSE 'haul nothing' END AS title, 800000000000 + c_custkey * 86400000 AS ts, [1000, 5000, 70000][c_custkey % 3 + 1] AS age FROM customer),
        h AS (SELECT DISTINCT k FROM p JOIN missions ON (k % 4 = 0 AND id = CAST(k AS VARCHAR)) OR (lower(missions.title) = p.title AND abs(accepted_at - ts) <= {_NEAR}))
        SELECT k AS pending_id, CASE WHEN age >= 60000 THEN 'expired' WHEN k % 5 = 0 THEN 'kept' WHEN age >= 3000 OR k IN (SELECT k FROM h) THEN 'review' ELSE 'kept' END AS state FROM p""",
    "objectives_applied": f"""WITH {A.SQL_LEGS}, l AS (SELECT *, concat_ws('|', kind, lower(trim(coalesce(commodity, ''))), lower(trim(coalesce(location, '')))) AS key FROM legs WHERE CAST(mission_id AS BIGINT) % 5 = 0),
        f AS (SELECT *, row_number() OVER (PARTITION BY mission_id, key ORDER BY objective_id) AS r FROM l WHERE NOT completed), o AS (SELECT *, row_number() OVER (PARTITION BY mission_id, key ORDER BY objective_id) AS r FROM l WHERE NOT completed AND scu_total % 3 = 0),
        m AS (SELECT f.mission_id, f.objective_id, f.kind, o.commodity, o.scu_total + 1 AS scu_total, coalesce(o.location, f.location) AS location FROM o JOIN f USING (mission_id, key, r)),
        n AS (SELECT mission_id, count(*) AS n FROM o GROUP BY mission_id), rest AS (SELECT mission_id, min(objective_id) AS first FROM f WHERE kind = 'dropoff' AND (mission_id, objective_id) NOT IN (SELECT mission_id, objective_id FROM m) GROUP BY mission_id)
        SELECT *, 'filled' AS action FROM m
        UNION ALL SELECT i.mission_id, coalesce(first, 'manual_dropoff_5_' || coalesce(n, 0)), 'dropoff', 'Nothing known', 7, 'Nowhere', CASE WHEN first IS NULL THEN 'inserted' ELSE 'filled' END FROM (SELECT DISTINCT mission_id FROM l) i LEFT JOIN rest USING (mission_id) LEFT JOIN n USING (mission_id)""",
    "title_preselected": """WITH i AS (SELECT c_custkey, 'nation' || (c_custkey % 25) AS key, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 40 END AS pre FROM customer), e AS (SELECT n_nationkey AS id, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS e FROM nation),
        s AS (SELECT DISTINCT key, id, 1 - levenshtein(key, e) / CAST(greatest(length(key), length(e)) AS DOUBLE) AS score FROM i, e), r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY key ORDER BY score DESC, id)),
        b AS (SELECT key, CASE WHEN score >= 0.6 AND score - coalesce(nxt, 0) >= 0.08 THEN id END AS sure FROM r WHERE place = 1)
        SELECT c_custkey, CAST(coalesce(CASE WHEN pre < (SELECT count(*) FROM nation) THEN pre END, sure) AS VARCHAR) AS target FROM i LEFT JOIN b USING (key)""",
}
