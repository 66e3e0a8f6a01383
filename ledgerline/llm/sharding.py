"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; sorting by fractional rank mixes the sources in
proportion everywhere, and cutting that order by bytes gives shards of near equal size and equal mixture (law `bytes`).
Rows of equal text form one unit and stay in one shard. Units that are large against a shard (at most
shards * LARGE_PARTS exist) are placed first, largest to the emptiest shard, and the cut fills what they leave; a unit
larger than a whole shard is the only one that is divided.

Null text: size 1, a unit of its own. Null source: a stratum of its own. Repeated rows: as many output rows. Empty
table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import dense_positions, materialize, parallelism, unit_hash

#: A unit is large if it exceeds this part of a shard; at most shards * LARGE_PARTS units can be.
LARGE_PARTS = 64


def _capacities(loads: list[float], rest: float) -> list[float]:
    """How much of `rest` each shard takes so that the fullest are least above the others."""
    low, high = 0.0, max(loads) + rest
    for _ in range(100):
        level = (low + high) / 2
        if sum(max(0.0, level - x) for x in loads) < rest:
            low = level
        else:
            high = level
    return [max(0.0, high - x) for x in loads]


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """One row a row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    alone = F.concat(F.lit("null#"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = materialize(
        docs.select(
            "doc_id",
            F.col("source"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.when(F.col("text").isNull(), alone).otherwise(F.md5(text.cast("binary"))).alias("unit"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = max(1.0, total / shards)
    oversize = [r[0] for r in rows.groupBy("unit").agg(F.sum("size").alias("b")).filter(F.col("b") > share).select("unit").collect()]
    if oversize:
        rows = rows.withColumn(
            "unit",
            F.when(F.col("unit").isin(oversize), F.concat_ws("#", "unit", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).otherwise(F.col("unit")),
        )
    units = rows.groupBy("unit").agg(
        F.sum("size").alias("bytes"), F.min(F.struct("doc_id", "source"))["source"].alias("source")
    )
    large_at = share / LARGE_PARTS
    large = sorted(((r["bytes"], r["unit"]) for r in units.filter(F.col("bytes") > large_at).select("unit", "bytes").collect()), reverse=True)
    loads = [0.0] * shards
    placed = []
    for size, unit in large:
        to = min(range(shards), key=loads.__getitem__)
        loads[to] += size
        placed.append((unit, to))
    small_total = total - sum(x[0] for x in large)
    bounds, at = [], 0.0
    for c in _capacities(loads, small_total):
        at += c
        bounds.append(at)

    small = units.filter(F.col("bytes") <= large_at)
    mixed = small.withColumn("mix", unit_hash(F.lit(seed), "unit"))
    ranked = dense_positions(mixed, ["source"], ["mix", "unit"], F.col("mix"), "rank")
    counts = small.groupBy("source").agg(F.count(F.lit(1)).alias("of_source"))
    ordered = ranked.join(counts, ranked["source"].eqNullSafe(counts["source"])).drop(counts["source"]).withColumn(
        "fraction", (F.col("rank") + 0.5) / F.col("of_source")
    )
    cells = 16 * parallelism(spark)
    ordered = ordered.withColumn("cell", F.least(F.floor(F.col("fraction") * cells), F.lit(cells - 1)).cast("int"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    starts = ordered.groupBy("cell").agg(F.sum("bytes").alias("b")).select(
        "cell", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("cell").orderBy("fraction", "mix", "unit").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("start") + F.sum("bytes").over(within) - F.col("bytes") / 2
    cut = F.lit(0)
    for b in bounds[:-1]:
        cut = cut + (F.col("middle") > F.lit(b)).cast("int")
    homes = ordered.join(starts, "cell").withColumn("middle", middle).select("unit", cut.cast("int").alias("shard"))
    if placed:
        homes = homes.unionByName(spark.createDataFrame(placed, "unit string, shard int"))
    located = rows.join(homes, "unit")
    shuffled = located.withColumn("mix", unit_hash(F.lit(seed + 1), "unit", "doc_id"))
    slotted = dense_positions(shuffled, ["shard"], ["mix", "doc_id", "text_crc32"], F.col("mix"), "slot")
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
