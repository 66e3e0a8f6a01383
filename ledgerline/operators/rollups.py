"""Grouped views over missions and legs (schemas.MISSIONS, schemas.LEGS).

All are joins on the mission id and partially aggregated group-bys; nested lists are left to nested_missions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.scalars import half_up, leg_key
from ledgerline.sources.sizes import spread

OPEN_STATUS = ("accepted", "in_progress")
UNKNOWN = {"dropoff": "Unknown destination", "pickup": "Unknown pickup"}


def is_open(status: Column) -> Column:
    return status.isin(*OPEN_STATUS)


def active_missions(missions: DataFrame) -> DataFrame:
    """Live and not ended."""
    return missions.filter((F.col("session") == "live") & is_open(F.col("status")))


def remaining(total: Column, delivered: Column, completed: Column) -> Column:
    return F.when(completed, 0).otherwise(F.greatest(F.lit(0), total - delivered)).cast("long")


def history(missions: DataFrame) -> DataFrame:
    """Ended missions, the last completed first, then the last created."""
    return missions.filter(~is_open(F.col("status"))).orderBy(F.coalesce("completed_at", F.lit(0)).desc(), F.desc("created_seq"))


def in_created_order(missions: DataFrame) -> DataFrame:
    """The last created first."""
    return missions.orderBy(F.desc("created_seq"))


def history_view(missions: DataFrame) -> DataFrame:
    """Ended missions as a viewer lists them: the last first by the time of completion, else of acceptance, else 0."""
    return missions.filter(~is_open(F.col("status"))).withColumn("shown_at", F.coalesce("completed_at", "accepted_at", F.lit(0)).cast("long")).orderBy(F.desc("shown_at"), F.desc("created_seq"))


def ordered_destinations(places: DataFrame) -> DataFrame:
    """places (name, is_cargo_center): cargo centers first, then by name as people sort names."""
    return places.orderBy(F.desc("is_cargo_center"), F.collate("name", "UNICODE"), "name")


def choices(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that hold something, sorted: what a list to choose from offers."""
    return df.select(column).filter(F.trim(F.col(column).cast("string")) != "").distinct().orderBy(column)


def first_few(df: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """The first rows in an order: a top-k report."""
    return df.orderBy(*order).limit(most)


def live_references(references: DataFrame, missions: DataFrame, legs: DataFrame, rows: int = 0) -> DataFrame:
    """references (mission_id, objective_id) whose mission and leg still exist; rows: about how many there are of either."""
    keys = ["mission_id", "objective_id"]
    there = spread(legs.select(*keys), rows, *keys).distinct()
    kept = spread(references, rows, *keys).join(there, keys, "left_semi")
    return kept.join(missions.select(F.col("id").alias("mission_id")), "mission_id", "left_semi")


def incomplete_missions(missions: DataFrame, legs: DataFrame) -> DataFrame:
    """Missions with a dropoff that lacks its place or size."""
    lacking = legs.filter((F.col("kind") == "dropoff") & (F.col("location").isNull() | (F.col("scu_total") == 0)))
    return missions.join(lacking.select(F.col("mission_id").alias("id")).distinct(), "id", "left_semi")


def nested_missions(missions: DataFrame, legs: DataFrame) -> DataFrame:
    """Missions with their legs as an array, pickups first, then by objective id."""
    fields = [c for c in legs.columns if c != "mission_id"]
    order = F.struct((F.col("kind") != "pickup").alias("k"), F.col("objective_id").alias("o"), F.struct(*fields).alias("leg"))
    nested = legs.groupBy(F.col("mission_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["leg"]).alias("legs"))
    return missions.join(nested, "id", "left")


def dropoffs_store(missions: DataFrame, legs: DataFrame) -> DataFrame:
    """Store's view, a row a location and commodity: what is left and delivered over active missions, with the totals of
    the location. Places that are null are left out; an empty commodity is `(unknown)`."""
    mine = active_missions(missions).select(F.col("id").alias("mission_id"))
    rows = legs.filter((F.col("kind") == "dropoff") & F.col("location").isNotNull()).join(mine, "mission_id", "left_semi")
    delivered = F.when(F.col("completed"), F.col("scu_total")).otherwise(F.col("scu_delivered"))
    cells = rows.groupBy(
        "location", F.when(F.coalesce("commodity", F.lit("")) == "", "(unknown)").otherwise(F.col("commodity")).alias("commodity")
    ).agg(
        F.sum(F.greatest(F.lit(0), F.col("scu_total") - delivered)).cast("long").alias("scu_remaining"),
        F.sum(delivered).cast("long").alias("scu_delivered"),
        F.sum(F.when(F.col("completed"), 0).otherwise(1)).cast("long").alias("open_legs"),
        F.count(F.lit(1)).alias("legs"),
    )
    groups = cells.groupBy("location").agg(
        F.sum("scu_remaining").alias("group_remaining"), F.sum(F.col("scu_remaining") + F.col("scu_delivered")).alias("group_total"), F.sum("open_legs").alias("group_open")
    )
    return cells.join(groups, "location").select(
        "location", "commodity", F.when((F.col("scu_remaining") > 0) | (F.col("open_legs") > 0), "todo").otherwise("delivered").alias("state"),
        "scu_remaining", "scu_delivered", "legs", "group_remaining", "group_total",
        F.when(F.col("group_total") > 0, half_up((F.col("group_total") - F.col("group_remaining")) / F.col("group_total") * 100)).otherwise(0).cast("long").alias("pct_delivered"),
        ((F.col("group_remaining") == 0) & (F.col("group_open") == 0)).alias("all_done"),
    )


def stop_groups(missions: DataFrame, legs: DataFrame, kind: str = "dropoff") -> DataFrame:
    """Reader's view of the stops of a kind over open missions, a row a location, commodity and state.

    Completed legs count as delivered with their size, open ones as todo with what is left; what an open leg has
    delivered counts in the location's totals only. Null places share one group, which goes if nothing in it is todo.
    """
    mine = missions.filter(is_open(F.col("status"))).select(F.col("id").alias("mission_id"))
    rows = legs.filter(F.col("kind") == kind).join(mine, "mission_id", "left_semi").select(
        F.coalesce("location", F.lit(UNKNOWN[kind])).alias("location"), "commodity", F.when(F.col("completed"), "delivered").otherwise("todo").alias("state"),
        remaining(F.col("scu_total"), F.col("scu_delivered"), F.col("completed")).alias("left"),
        F.when(F.col("completed"), F.col("scu_total")).otherwise(F.col("scu_delivered")).alias("done"),
    )
    todo = F.col("state") == "todo"
    cells = rows.groupBy("location", "commodity", "state").agg(
        F.sum(F.when(todo, F.col("left")).otherwise(F.col("done"))).cast("long").alias("scu"), F.count(F.lit(1)).alias("legs"),
        F.sum("left").alias("left"), F.sum("done").alias("done"),
    )
    groups = cells.groupBy("location").agg(
        F.sum("left").cast("long").alias("group_remaining"), F.sum("done").cast("long").alias("group_delivered"), F.max(todo.cast("int")).alias("todo")
    )
    total = F.col("group_remaining") + F.col("group_delivered")
    return cells.drop("left", "done").join(groups, "location").filter((F.col("location") != UNKNOWN[kind]) | (F.col("todo") == 1)).select(
        "location", "commodity", "state", "scu", "legs", "group_remaining", total.alias("group_total"),
        F.when(total != 0, half_up(F.col("group_delivered") / total * 100)).otherwise(0).cast("long").alias("pct_delivered"),
        (F.col("todo") == 0).alias("all_done"), (F.col("location") == UNKNOWN[kind]).alias("needs_location"),
    )


def ordered_stops(groups: DataFrame) -> DataFrame:
    """stop_groups in the order of the view: unfinished first, then those without a place, then what is left."""
    return groups.orderBy("all_done", F.desc("needs_location"), F.desc("group_remaining"), "location", "state", "commodity")


def group_summary(groups: DataFrame) -> DataFrame:
    """One row: what is left over unfinished groups, and how many of these there are."""
    each = groups.select("location", "group_remaining", "all_done").distinct()
    return each.agg(
        F.coalesce(F.sum(F.when(~F.col("all_done"), F.col("group_remaining"))), F.lit(0)).cast("long").alias("grand_total_remaining"),
        F.count(F.when(~F.col("all_done"), 1)).alias("active_stops"),
    )


def mission_totals(missions: DataFrame, legs: DataFrame) -> DataFrame:
    """A row a mission over its dropoffs; the percentage counts legs."""
    drop = F.col("kind") == "dropoff"
    sums = legs.filter(drop).groupBy("mission_id").agg(
        F.sum(remaining(F.col("scu_total"), F.col("scu_delivered"), F.col("completed"))).cast("long").alias("r"), F.sum("scu_total").cast("long").alias("t"),
        F.sum(F.col("completed").cast("long")).alias("d"), F.count(F.lit(1)).alias("n"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return missions.select(F.col("id").alias("mission_id")).join(sums, "mission_id", "left").select(
        "mission_id", zero("r").alias("scu_remaining"), zero("t").alias("scu_total"), zero("d").alias("legs_done"), zero("n").alias("legs_total"),
        F.when(F.col("n") > 0, half_up(F.col("d") / F.col("n") * 100)).otherwise(0).cast("long").alias("pct_delivered"),
    )


def status_counts(missions: DataFrame) -> DataFrame:
    return missions.groupBy("status").agg(F.count(F.lit(1)).alias("missions"))


def totals_store(missions: DataFrame, legs: DataFrame, earnings: DataFrame, fines: DataFrame) -> DataFrame:
    """Completed missions, units over all their legs, all credits, all fines."""
    done = missions.filter("status = 'complete'")
    moved = legs.join(done.select(F.col("id").alias("mission_id")), "mission_id", "left_semi")
    amount = lambda df, name: df.agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("long").alias(name))
    parts = [
        done.agg(F.count(F.lit(1)).alias("missions_completed")),
        moved.agg(F.coalesce(F.sum(F.when(F.col("completed"), F.col("scu_total")).otherwise(F.col("scu_delivered"))), F.lit(0)).cast("long").alias("scu_hauled")),
        amount(earnings, "credits_earned"), amount(fines, "fines_total"),
    ]
    out = parts[0]
    for p in parts[1:]:  # single rows
        out = out.join(p, F.lit(True))
    return out


def lifetime_totals(missions: DataFrame, legs: DataFrame) -> DataFrame:
    """Completed missions, units of their dropoffs, their payouts."""
    done = missions.filter("status = 'complete'")
    moved = legs.filter("kind = 'dropoff'").join(done.select(F.col("id").alias("mission_id")), "mission_id", "left_semi")
    return done.agg(F.count(F.lit(1)).alias("missions_completed"), F.coalesce(F.sum("payout"), F.lit(0)).cast("long").alias("credits_earned")).join(
        moved.agg(F.coalesce(F.sum("scu_total"), F.lit(0)).cast("long").alias("scu_hauled")), F.lit(True)
    ).select("missions_completed", "scu_hauled", "credits_earned", F.lit(0).cast("long").alias("fines_total"))


def deduped(ledger: DataFrame) -> DataFrame:
    """Earnings or fines, once for each amount and time."""
    return ledger.dropDuplicates(["amount", "ts"])


def deduped_pickups(objectives: DataFrame) -> DataFrame:
    """Pickups of one mission and key merged, their sizes added (null if all are null); dropoffs as they are.

    objectives: mission_id, pos, kind, commodity, scu, location. A merged row has the first position.
    """
    key = leg_key(F.col("kind"), F.col("commodity"), F.col("location"))
    picked = objectives.filter("kind = 'pickup'").withColumn("key", key)
    first = F.struct("pos", "commodity", "location")
    merged = picked.groupBy("mission_id", "key").agg(F.min(first).alias("first"), F.sum("scu").cast("long").alias("scu")).select(
        "mission_id", F.col("first.pos").alias("pos"), F.lit("pickup").alias("kind"), F.col("first.commodity").alias("commodity"), "scu", F.col("first.location").alias("location")
    )
    return merged.unionByName(objectives.filter("kind <> 'pickup'").select("mission_id", "pos", "kind", "commodity", F.col("scu").cast("long").alias("scu"), "location"))


def commodity_summary(legs: DataFrame) -> DataFrame:
    """A mission's distinct dropoff commodities in leg order: two at most, then how many more."""
    first = legs.filter("kind = 'dropoff'").groupBy("mission_id", "commodity").agg(F.min("objective_id").alias("at"))
    names = first.groupBy("mission_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "commodity"))), lambda x: x["commodity"]).alias("names"))
    shown = F.array_join(F.slice("names", 1, 2), ", ")
    return names.select("mission_id", F.when(F.size("names") > 2, F.concat(shown, F.lit(" +"), (F.size("names") - 2).cast("string"))).otherwise(shown).alias("summary"))


def status_rollup(missions: DataFrame, legs: DataFrame) -> DataFrame:
    """id, status: ended by game or hand stays; else by how many legs are done."""
    counts = legs.groupBy(F.col("mission_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("completed").cast("long")).alias("d"))
    ended = F.col("terminal_source").isNotNull() & ~is_open(F.col("status"))
    return missions.join(counts, "id", "left").select(
        "id", F.when(ended, F.col("status")).when((F.col("n") > 0) & (F.col("d") == F.col("n")), "complete").when(F.col("d") > 0, "in_progress").otherwise("accepted").alias("status"),
    )


def incoming(edges: DataFrame) -> DataFrame:
    """node, edges: the edges that end at a place as one array in order of edge_id."""
    fields = [c for c in edges.columns if c != "to_location"]
    order = F.struct("edge_id", F.struct(*fields).alias("edge"))
    return edges.groupBy(F.col("to_location").alias("node")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["edge"]).alias("edges"))


def map_layout(edges: DataFrame, gap: int = 16) -> DataFrame:
    """Nodes of the edges with role, column, height and top: sources left, those with both roles between, sinks right."""
    ends = edges.select(F.col("from_location").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"), F.lit(None).cast("string").alias("commodity")).unionByName(
        edges.select(F.col("to_location").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"), "commodity")
    )
    nodes = ends.groupBy("node").agg(F.max("out").alias("out"), F.max("into").alias("into"), F.count("commodity").alias("lines"))
    role = F.when((F.col("out") == 1) & (F.col("into") == 1), "both").when(F.col("out") == 1, "source").otherwise("sink")
    height = F.when(F.col("lines") > 0, 44 + 15 * F.col("lines") + 8).otherwise(48)
    before = Window.partitionBy("role").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.select("node", role.alias("role"), height.cast("long").alias("height")).withColumn(
        "top", F.coalesce(F.sum(F.col("height") + gap).over(before), F.lit(0)).cast("long")
    )
