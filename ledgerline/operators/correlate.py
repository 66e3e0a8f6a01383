"""Joins by time and by name, and the haul graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.operators.claims import WINDOW_MS


def window_pairs(awards: DataFrame, completions: DataFrame, window: int = WINDOW_MS, by: tuple[str, ...] = ()) -> DataFrame:
    """Awards with the completions in [ts - window, ts]: an equi-join on time cells, then the exact range."""
    cell = lambda c: F.floor(F.col(c) / window)
    left = awards.withColumn("__cell", F.explode(F.array(cell("ts"), cell("ts") - 1)))
    right = completions.withColumn("__cell", cell("completed_at"))
    joined = left.join(right, [*by, "__cell"])
    return joined.filter((F.col("completed_at") <= F.col("ts")) & (F.col("completed_at") >= F.col("ts") - window)).drop("__cell")


def candidate_counts(awards: DataFrame, completions: DataFrame, window: int = WINDOW_MS, by: tuple[str, ...] = ()) -> DataFrame:
    """Each award with the number of completions in its window and what that says of its attribution."""
    n = window_pairs(awards, completions, window, by).groupBy(*by, "amount", "ts").agg(F.count(F.lit(1)).alias("n"))
    count = F.coalesce("n", F.lit(0))
    return awards.join(n, [*by, "amount", "ts"], "left").select(
        *by, "amount", "ts", count.cast("long").alias("candidates"), F.when(count == 0, "other_income").when(count == 1, "confirmed").otherwise("approximate").alias("outcome")
    )


def normalized_title(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def nearest_missions(pending: DataFrame, missions: DataFrame, within: int = 30_000) -> DataFrame:
    """pending (pending_id, mission_id, title, ts) with `match`: the mission of that id, else the one of equal title
    accepted nearest in time (the first created of equally near ones): an equi-join on title and time cells, then the gap."""
    ids = missions.select(F.col("id").alias("mission_id"), F.col("id").alias("by_id"))
    exact = pending.join(ids, "mission_id", "left")
    named = missions.select("id", normalized_title(F.col("title")).alias("key"), "accepted_at", "created_seq")
    cell = lambda c: F.floor(F.col(c) / max(within, 1))
    around = pending.withColumn("key", normalized_title(F.col("title"))).withColumn("__cell", F.explode(F.array(*[cell("ts") + i for i in (-1, 0, 1)])))
    near = around.join(named.withColumn("__cell", cell("accepted_at")), ["key", "__cell"]).withColumn("gap", F.abs(F.col("accepted_at") - F.col("ts"))).filter(F.col("gap") <= within)
    best = near.groupBy("pending_id").agg(F.min_by("id", F.struct("gap", "created_seq")).alias("by_title"))
    return exact.join(best, "pending_id", "left").select("pending_id", F.coalesce("by_id", "by_title").alias("match"))


def paired(picks: Column, drops: Column) -> Column:
    """An array of structs d, p: each dropoff with its pickup, in order: an unused one of its commodity, else the next
    unused one, else the first (null without any). picks, drops: arrays of structs with objective_id and commodity."""

    def claim(state: Column, d: Column) -> Column:
        same = F.filter(state["free"], lambda p: (p["commodity"] != "") & (p["commodity"] == d["commodity"]))
        pick = F.coalesce(F.get(same, F.lit(0)), F.get(state["free"], F.lit(0)), F.get(picks, F.lit(0)))
        # a list of one, so that the pick is worked out once
        after = F.transform(
            F.array(pick),
            lambda p: F.struct(
                F.filter(state["free"], lambda x: ~x["objective_id"].eqNullSafe(p["objective_id"])).alias("free"),
                F.concat(state["out"], F.array(F.struct(d.alias("d"), p.alias("p")))).alias("out"),
            ),
        )
        return F.get(after, F.lit(0))

    none = F.filter(F.transform(drops, lambda d: F.struct(d.alias("d"), F.get(picks, F.lit(0)).alias("p"))), lambda _: F.lit(False))
    return F.aggregate(drops, F.struct(picks.alias("free"), none.alias("out")), claim, lambda state: state["out"])


def route_edges(missions: DataFrame, legs: DataFrame) -> DataFrame:
    """The haul graph of the open missions: one edge a dropoff. A mission's legs, a bounded handful, are gathered in one
    array and paired by a fold over its dropoffs."""
    mine = missions.filter(F.col("status").isin("accepted", "in_progress")).select(F.col("id").alias("mission_id"))
    leg = F.struct("objective_id", "commodity", "scu_total", "location", "completed")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, leg)))
    both = legs.join(mine, "mission_id", "left_semi").groupBy("mission_id").agg(of("pickup").alias("picks"), of("dropoff").alias("drops"))
    edges = both.select("mission_id", F.inline(paired(F.col("picks"), F.col("drops"))))
    name = lambda c: F.coalesce(F.col(c), F.lit("Unknown"))
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    return edges.select(
        "mission_id", F.concat("mission_id", F.lit(":"), F.coalesce("p.objective_id", F.lit("none")), F.lit("->"), "d.objective_id").alias("edge_id"),
        name("p.location").alias("from_location"), name("d.location").alias("to_location"), F.coalesce(text("d.commodity"), text("p.commodity"), F.lit("")).alias("commodity"),
        F.col("d.scu_total").alias("scu"), F.col("p.location").isNotNull().alias("from_known"), F.col("d.location").isNotNull().alias("to_known"),
        (F.coalesce("d.completed", F.lit(False)) & (F.col("p").isNull() | F.coalesce("p.completed", F.lit(False)))).alias("done"),
    )


def route_stop_count(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("from_location", "to_location")).alias("x")).agg(F.countDistinct("x").alias("stops"))


def precedence(legs: DataFrame) -> DataFrame:
    """mission_id, dropoff, pickup: what has to be loaded first; commodities match if equal or if either is blank."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    d = legs.filter("kind = 'dropoff'").select("mission_id", F.col("objective_id").alias("dropoff"), F.col("commodity").alias("dc"))
    p = legs.filter("kind = 'pickup'").select("mission_id", F.col("objective_id").alias("pickup"), F.col("commodity").alias("pc"))
    return d.join(p, "mission_id").filter(blank("dc") | blank("pc") | (F.col("dc") == F.col("pc"))).select("mission_id", "dropoff", "pickup")
