"""Parts of tables by their number of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: About how many rows of a large table a task sorts, joins or aggregates at a time.
TASK_ROWS = 250_000
#: The same of rows that are sorted and windowed several times in one task.
MET_ROWS = 100_000
#: Up to how many rows of a dimension Spark may send to all tasks.
SENT_ROWS = 2_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by its keys in as many parts as its rows (about so many) need, so that a task's memory doesn't grow with them;
    a small table is left to Spark."""
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def looked_up(df: DataFrame, rows: Callable[[], int], key: str, dimension: DataFrame, of: str) -> DataFrame:
    """df with the columns of the dimension's row whose `of` is its key, if there is one. A dimension of more than
    SENT_ROWS meets df (about rows() rows) in parts; a smaller one is left to Spark."""
    if dimension.count() > SENT_ROWS:
        df, dimension = spread(df, rows(), key), dimension.hint("merge")
    return df.join(dimension, F.col(key) == F.col(of), "left")


def parts_of(spark: SparkSession, rows: int) -> int:
    """In how many parts so many rows are dealt by one key where several tables must meet in the same parts."""
    return max(-(-rows // MET_ROWS), spark.sparkContext.defaultParallelism)
