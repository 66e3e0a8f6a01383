"""State tables on disk: columns that later versions added, back-fill, and writing them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators.rollups import is_open

TABLES = {"missions": schemas.MISSIONS, "legs": schemas.LEGS, "earnings": schemas.EARNINGS, "fines": schemas.FINES}
DEFAULTS = {"session": "historical", "reward": None, "terminal_source": None, "manual_override": None, "title_pickup": None, "title_dropoff": None}


def migrated(df: DataFrame, name: str) -> DataFrame:
    """df with all columns of the table; ended missions of versions without terminal_source count as ended by the game."""
    kinds = [x.split(" ", 1) for x in TABLES[name].split(", ")]
    old = "terminal_source" not in df.columns
    out = df
    for column, kind in kinds:
        if column not in df.columns:
            out = out.withColumn(column, F.lit(DEFAULTS.get(column)).cast(kind))
    if name == "missions" and old:
        out = out.withColumn("terminal_source", F.when(~is_open(F.col("status")), "game"))
    return out.select(*[F.col(c).cast(k) for c, k in kinds])


def save(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: migrated(spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}"), name) for name in TABLES}


def reset(spark: SparkSession, path: str) -> None:
    """Empty all mission tables; salvage tables are elsewhere and stay."""
    save({name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}, path)
