"""Salvage runs: totals, groups of stripped components, and the commands on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of component types, states, prices of materials.
TYPE_ORDER = ["weapon", "powerplant", "shield", "quantumdrive", "cooler", "radar"]
STATES = ["active", "sold", "abandoned"]
RMC_PRICE, CMAT_PRICE = 7200, 12000


def run_totals(runs: DataFrame, stripped: DataFrame, rmc: int = RMC_PRICE, cmat: int = CMAT_PRICE) -> DataFrame:
    """id, materials_value, components_value (sold ones), total_value, per_crew (a crew of one at least)."""
    sold = stripped.groupBy(F.col("run_id").alias("id")).agg(F.sum(F.when(F.col("sold"), F.col("qty") * F.col("sell_price_each"))).alias("sold"))
    materials = F.col("rmc_scu") * rmc + F.col("cmat_scu") * cmat
    parts = F.coalesce("sold", F.lit(0)).cast("double")
    return runs.join(sold, "id", "left").select("id", materials.alias("materials_value"), parts.alias("components_value"), (materials + parts).alias("total_value"), ((materials + parts) / F.greatest(F.lit(1), "crew_size")).alias("per_crew"))


def component_lines(stripped: DataFrame) -> DataFrame:
    """Components of a run by type, model, price and whether sold, with their type's values."""
    known = stripped.filter(F.col("type").isin(TYPE_ORDER))
    lines = known.groupBy("run_id", "type", "model", "sell_price_each", "sold").agg(F.sum("qty").cast("long").alias("qty"), F.array_sort(F.collect_list("id")).alias("ids"))
    lines = lines.withColumn("line_value", F.col("qty") * F.col("sell_price_each"))
    kinds = lines.groupBy("run_id", "type").agg(F.sum(F.when(F.col("sold"), F.col("line_value")).otherwise(0)).cast("long").alias("sold_value"), F.sum("line_value").cast("long").alias("gross_value"))
    return lines.join(kinds, ["run_id", "type"])


def in_group_order(lines: DataFrame) -> DataFrame:
    return lines.orderBy("run_id", F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("type")), F.desc("line_value"), "model")


def lifetime(runs: DataFrame, stripped: DataFrame) -> DataFrame:
    """Value and material units over the sold runs."""
    sold = runs.filter("status = 'sold'")
    value = run_totals(sold, stripped).agg(F.coalesce(F.sum("total_value"), F.lit(0.0)).alias("total_value"))
    return value.join(sold.agg(F.coalesce(F.sum(F.col("rmc_scu") + F.col("cmat_scu") + F.col("construction_scu")), F.lit(0.0)).alias("material_scu")), F.lit(True))


def run_history(runs: DataFrame) -> DataFrame:
    return runs.filter("status <> 'active'").orderBy(F.coalesce("completed_at", "started_at").desc(), F.desc("created_seq"))


def current_run(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'active'").orderBy(F.desc("created_seq")).limit(1)


def next_created_seq(runs: DataFrame, stripped: DataFrame, wrecks: DataFrame) -> DataFrame:
    both = runs.select("created_seq").unionByName(stripped.select("created_seq")).unionByName(wrecks.select("created_seq"))
    return both.agg(F.coalesce(F.max("created_seq"), F.lit(0)).alias("created_seq"))


def models_of(components: DataFrame, kind: str) -> DataFrame:
    return components.filter(F.col("type") == kind).orderBy("model")


def with_reference_price(stripped: DataFrame, components: DataFrame) -> DataFrame:
    prices = components.groupBy("type", "model").agg(F.first("sell_price").alias("reference_price"))
    return stripped.join(prices, ["type", "model"], "left")


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    q = query.strip().lower()
    hit = F.lit(not q)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return df.filter(hit)


def ships_in_order(ships: DataFrame) -> DataFrame:
    return ships.orderBy(F.asc_nulls_last("cost_tier"), F.desc("cmat"))


def ships_by_slug(wanted: DataFrame, ships: DataFrame) -> DataFrame:
    """wanted (slug) with the ship of that slug; nulls where there is none."""
    return wanted.join(ships, "slug", "left")


def components_in_order(components: DataFrame) -> DataFrame:
    return components.orderBy(F.coalesce("sell_price", F.lit(-1)).desc(), "model")


def haulers_in_order(haulers: DataFrame) -> DataFrame:
    return haulers.orderBy(F.desc("grid_scu"))


def status_of(x: Column) -> Column:
    return F.when(x.isin(STATES), x).otherwise("active")


def updated_runs(runs: DataFrame, patches: DataFrame) -> DataFrame:
    """patches: id and any of status, crew_size, notes, rmc_scu, cmat_scu, construction_scu, at (ms). A run that ends gets
    its time once; a run that opens again loses it."""
    names = [c for c in patches.columns if c not in ("id", "at")]
    p = patches.select("id", F.lit(True).alias("__hit"), F.col("at").alias("__at"), *[F.col(c).alias(f"__{c}") for c in names])
    out = runs.join(p, "id", "left")
    for c in names:
        new = status_of(F.col(f"__{c}")) if c == "status" else F.greatest(F.lit(1), F.col(f"__{c}").cast("int")) if c == "crew_size" else F.col(f"__{c}")
        out = out.withColumn(c, F.when(F.col(f"__{c}").isNotNull(), new).otherwise(F.col(c)))
    done = F.when(F.col("status") == "active", F.lit(None).cast("long")).otherwise(F.coalesce("completed_at", "__at"))
    if "status" in names:
        out = out.withColumn("completed_at", F.when(F.col("__status").isNotNull(), done).otherwise(F.col("completed_at")))
    return out.select(*runs.columns)


def with_runs(runs: DataFrame, drafts: DataFrame) -> DataFrame:
    """runs and those begun: drafts have id, at (ms), created_seq, and any of crew_size, notes, rmc_scu, cmat_scu,
    construction_scu (null: as usual)."""
    given = lambda c, usual: F.coalesce(F.col(c), F.lit(usual)) if c in drafts.columns else F.lit(usual)
    new = drafts.select(
        "id", F.col("at").alias("started_at"), F.lit(None).cast("long").alias("completed_at"), F.lit("active").alias("status"), F.greatest(F.lit(1), given("crew_size", 1).cast("int")).alias("crew_size"), given("notes", "").alias("notes"),
        *[given(c, 0.0).cast("double").alias(c) for c in ("rmc_scu", "cmat_scu", "construction_scu")], "created_seq",
    )
    return runs.unionByName(new.select(*[c for c in new.columns if c in runs.columns]), allowMissingColumns=True)


def with_stripped(stripped: DataFrame, added: DataFrame, runs: DataFrame) -> DataFrame:
    """stripped and the added components (its columns) of runs that there are; the others are left out."""
    new = cleaned_stripped(added.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi"))
    return stripped.unionByName(new.withColumn("sold", F.coalesce("sold", F.lit(False))).select(*[c for c in stripped.columns if c in new.columns]), allowMissingColumns=True)


def patched_stripped(stripped: DataFrame, patches: DataFrame) -> DataFrame:
    """patches: run_id, id and any of type, model, qty, sell_price_each, sold (null: as it is)."""
    names = [c for c in patches.columns if c not in ("run_id", "id")]
    p = patches.select("run_id", "id", *[F.col(c).alias(f"__{c}") for c in names])
    whole = lambda c: F.when(F.col(f"__{c}").isNotNull(), F.greatest(F.lit(0), F.col(f"__{c}").cast("long"))) if c in ("qty", "sell_price_each") else F.col(f"__{c}")
    out = stripped.join(p, ["run_id", "id"], "left")
    return out.withColumns({c: F.coalesce(whole(c), F.col(c)) for c in names}).select(*stripped.columns)


def cleaned_stripped(stripped: DataFrame) -> DataFrame:
    """Quantities and prices are whole and not negative."""
    return stripped.withColumn("qty", F.greatest(F.lit(0), F.col("qty").cast("int"))).withColumn("sell_price_each", F.greatest(F.lit(0), F.col("sell_price_each").cast("long")))


def without_runs(ids: DataFrame, runs: DataFrame, *children: DataFrame) -> list[DataFrame]:
    gone = ids.select("id")
    return [runs.join(gone, "id", "left_anti"), *[c.join(gone.withColumnRenamed("id", "run_id"), "run_id", "left_anti") for c in children]]
