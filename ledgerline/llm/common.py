"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints; only where none is configured and all runs in one process (tests)
    a local one is made."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and later readers prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more, as what came of them is written itself."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table._written_to
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


_held: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What a worker remembers under the name. Workers serve one operator after another, so what others left is let go."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def dense_positions(
    df: DataFrame, by: list[str], order: list[str], spread: Column, position: str, cells: int | None = None
) -> DataFrame:
    """Add `position`: each row's 0-based place in its `by` group, ordered by (cell of `spread`, then `order`).

    No group is sorted in one task: a group is cut into cells by the fraction `spread` (a double in [0, 1), evenly
    spread), cells are counted with partial sums, and only cells are sorted. `order` must make rows distinct for a
    fully determined result; rows equal in all of it are interchangeable. The counts are one row a group and cell,
    joined back on both.
    """
    cells = cells or 16 * parallelism(df.sparkSession)
    cell = "__cell"
    placed = df.withColumn(cell, F.least(F.floor(spread * cells), F.lit(cells - 1)).cast("int"))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")).alias(f"__by{i}") for i, c in enumerate(by)]
    names = [f"__by{i}" for i in range(len(by))]
    placed = placed.select("*", *keys)
    sizes = placed.groupBy(*names, cell).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*names).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*names, cell).orderBy(*order)
    return (
        placed.withColumn("__at", F.row_number().over(inside) - 1)
        .join(starts, [*names, cell])
        .withColumn(position, (F.col("__before") + F.col("__at")).cast("long"))
        .drop(*names, cell, "__before", "__at")
    )


def unit_hash(*columns: Column) -> Column:
    """A seeded hash of the columns as a double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))
