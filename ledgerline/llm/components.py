"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: each node of an edge, and the smallest node it reaches. Edges may repeat; loops are ignored.

    Each round hangs every node on the smallest node it sees, so chains shorten geometrically. A round is a few
    partially aggregated group-bys and joins; its results are written to the shared folder, which ends the lineage, and
    those of the round before are deleted.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct(), "edges"
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        # written out, so that the joins read shuffles on both sides and a node with many edges can be split
        least = materialize(both.groupBy("hi").agg(F.min("lo").alias("m")), "edges-least")
        large = (
            both.join(least, "hi")
            .filter(F.col("lo") > F.col("hi"))
            .select(F.col("lo").alias("hi"), F.least("hi", "m").alias("lo"))
            .distinct()
        )
        large = materialize(large, "edges-large")
        below = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "edges-below")
        joined = large.join(below, "hi")
        small = joined.select("hi", F.col("m").alias("lo")).unionByName(
            joined.filter(F.col("lo") > F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        )
        done = (now, least, large, below)
        now = materialize(small.distinct(), "edges")
        discard(*done)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
            ).distinct()
        seen = mark
