"""Dimension tables from CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of terminals, words of ports and of distribution points.
TERMINAL_TYPES = ["station", "city", "outpost", "distribution", "venue", "terminal"]
PORT_WORDS = r"(?i)spaceport|space port|landing|terminal|port\b"
DISTRIBUTION = r"(?i)distribution cent|logistics depot|cargo cent|S\dDC\d|S\dLD\d"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def rocks_of(table: DataFrame) -> DataFrame:
    """name, rarity, scan_values from RockName, Rarity, 1..6; a number after the name goes; a value that is no number fails."""
    require_columns(table, ["RockName", "Rarity", *"123456"])
    values = F.array(*[F.col(f"`{i}`").cast("double") for i in range(1, 7)])
    checked = F.when(F.exists(values, lambda v: v.isNull()), F.raise_error("six scan values are needed")).otherwise(values)
    name = F.regexp_replace(F.trim("RockName"), r"\s+\d+\z", "")
    return table.filter(F.coalesce(F.trim("RockName"), F.lit("")) != "").select(name.alias("name"), F.trim("Rarity").alias("rarity"), checked.cast("array<double>").alias("scan_values"))


def deposits_of(table: DataFrame) -> DataFrame:
    require_columns(table, ["Name", "Type", "FoundAt"])
    places = F.filter(F.transform(F.split(F.coalesce("FoundAt", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return table.filter(F.coalesce(F.trim("Name"), F.lit("")) != "").select(F.trim("Name").alias("name"), F.trim("Type").alias("type"), places.alias("found_at"))


def snapshot_counts(rocks: DataFrame, deposits: DataFrame) -> DataFrame:
    """kind, value, n; an empty snapshot is refused."""
    if rocks.isEmpty() or deposits.isEmpty():
        raise ValueError("an empty snapshot is refused")
    count = lambda df, c, k: df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "value", "n")
    return count(rocks, "rarity", "rarity").unionByName(count(deposits, "type", "type"))


def write_snapshot(rocks: DataFrame, deposits: DataFrame, path: str) -> None:
    rocks.write.mode("overwrite").json(f"{path}/rocks")
    deposits.write.mode("overwrite").json(f"{path}/deposits")


def read_snapshot(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The rows of one array of a JSON document, or of a document that is the array."""
    doc = spark.read.json(path, multiLine=True)
    if field in doc.columns:
        return doc.select(F.inline(field))
    return doc.select(F.inline("data")) if "data" in doc.columns else doc


def is_active(df: DataFrame) -> bool:
    return not df.isEmpty()


def flag(x: Column) -> Column:
    return F.coalesce(x.cast("string").isin("1", "true", "1.0"), F.lit(False))


def number_or_null(x: Column) -> Column:
    n = x.cast("string").try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def commodities_of(raw: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return raw.select(text("name").alias("name"), text("code").alias("code"), text("kind").alias("kind")).filter("name <> ''")


def terminals_of(raw: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return raw.select(
        text("name").alias("name"), text("displayname").alias("displayname"), text("nickname").alias("nickname"), flag(F.col("is_cargo_center")).alias("is_cargo_center"),
        number_or_null(F.col("max_container_size")).cast("int").alias("max_container_size"), F.when(F.col("type").isin(TERMINAL_TYPES), F.col("type")).alias("type"),
    ).filter("name <> ''")


def ships_of(raw: DataFrame) -> DataFrame:
    return raw.withColumn("scu", number_or_null(F.col("scu")).cast("int")).filter("scu > 0").orderBy(F.desc("scu"), "name")


def venue_of(name: Column) -> Column:
    """The last but one part of `a - b - c`, if it reads like a port."""
    parts = F.filter(F.transform(F.split(name, " - "), lambda x: F.trim(x)), lambda x: x != "")
    venue = F.get(parts, F.size(parts) - 2)
    return F.when((F.size(parts) >= 3) & venue.rlike(PORT_WORDS), venue)


def is_distribution_point(name: Column) -> Column:
    return F.coalesce(name.rlike(DISTRIBUTION), F.lit(False))


def merged_locations(*sources: DataFrame) -> DataFrame:
    """name, is_cargo_center, type, max_container_size of sources with these columns and `at` (their order): places of one
    name without regard to case, cargo centre if any is, the first kind that says more than terminal, the first size."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("at")))
    said = F.col("type").isNotNull() & (F.col("type") != "terminal")
    return every.groupBy(F.lower("name").alias("key")).agg(
        F.min_by("name", "at").alias("name"), (F.max(F.col("is_cargo_center").cast("int")) == 1).alias("is_cargo_center"),
        F.coalesce(first("type", said), F.lit("terminal")).alias("type"), first("max_container_size", F.col("max_container_size").isNotNull()).alias("max_container_size"),
    ).drop("key")
