"""Commands on missions and legs: patches are tables that are joined, never loops over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.operators.rollups import is_open, status_rollup

ENDED = ("complete", "abandoned")


def with_manual_missions(missions: DataFrame, legs: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """drafts: id, title, giver, at, created_seq, legs (array of kind, commodity, scu_total, location)."""
    new = drafts.select(
        "id", "title", "giver", F.lit("MANUAL").alias("variant"), F.lit("UNKNOWN").alias("grade"), F.lit("accepted").alias("status"), F.lit("manual").alias("source"),
        F.lit("live").alias("session"), F.col("at").alias("accepted_at"), "created_seq",
    )
    added = drafts.select(F.col("id").alias("mission_id"), F.posexplode("legs").alias("i", "leg")).select(
        "mission_id", F.concat(F.lit("manual_leg_"), F.col("i").cast("string")).alias("objective_id"), "leg.kind", "leg.commodity", F.col("leg.scu_total").cast("long").alias("scu_total"),
        F.lit(0).cast("long").alias("scu_delivered"), "leg.location", F.lit(False).alias("completed"),
    )
    return missions.unionByName(new, allowMissingColumns=True), legs.unionByName(added, allowMissingColumns=True)


def patched_missions(missions: DataFrame, patches: DataFrame) -> DataFrame:
    """patches: id, at, and any of status, payout, payout_confidence, reward, notes (null: as it is). A payout is confirmed
    unless the patch says otherwise; an end by hand stays until it is opened again."""
    names = [c for c in patches.columns if c not in ("id", "at")]
    out = missions.join(patches.select("id", F.col("at").alias("__at"), *[F.col(c).alias(f"__{c}") for c in names]), "id", "left")
    given = lambda c: F.col(f"__{c}") if c in names else F.lit(None)
    values = {c: F.coalesce(given(c), F.col(c)) for c in ("status", "payout", "reward", "notes") if c in names}
    if "payout" in names or "payout_confidence" in names:
        values["payout_confidence"] = F.coalesce(given("payout_confidence").cast("string"), F.when(given("payout").isNotNull(), "confirmed"), F.col("payout_confidence"))
    if "status" in names:
        ended = F.col("__status").isin(*ENDED)
        values["completed_at"] = F.when(ended, F.coalesce("completed_at", "__at")).when(F.col("__status").isNull(), F.col("completed_at"))
        values["terminal_source"] = F.when(ended, "manual").when(F.col("__status").isNull(), F.col("terminal_source"))
    return out.withColumns(values).select(*missions.columns)


def patched_legs(legs: DataFrame, patches: DataFrame) -> DataFrame:
    """patches: mission_id, objective_id, at, completed, scu_delivered, scu_total, location, commodity (null: as it is).

    Checking a leg off delivers all of it, taking that back delivers none; a delivered amount that is given wins; a
    new size of a completed leg is its delivered amount too. Patched legs carry the time as manual_override."""
    keys = ["mission_id", "objective_id"]
    kinds = {"completed": "boolean", "scu_delivered": "long", "scu_total": "long", "location": "string", "commodity": "string"}
    p = patches.select(*keys, F.col("at").alias("__at"), *[(F.col(c) if c in patches.columns else F.lit(None)).cast(kind).alias(f"__{c}") for c, kind in kinds.items()])
    total, done = F.coalesce("__scu_total", "scu_total"), F.coalesce("__completed", "completed")
    delivered = (
        F.when(F.col("__scu_delivered").isNotNull(), F.col("__scu_delivered").cast("long")).when(F.col("__completed"), total).when(~F.col("__completed"), F.lit(0))
        .when(F.col("__scu_total").isNotNull() & F.col("completed"), total).otherwise(F.col("scu_delivered"))
    )
    out = legs.join(p, keys, "left").withColumns({
        "scu_delivered": delivered.cast("long"), "scu_total": total.cast("long"), "completed": done.cast("boolean"), "location": F.coalesce(F.col("__location").cast("string"), "location"),
        "commodity": F.coalesce(F.col("__commodity").cast("string"), "commodity"), "manual_override": F.coalesce("__at", "manual_override") if "manual_override" in legs.columns else F.col("__at"),
    })
    return out.select(*dict.fromkeys([*legs.columns, "manual_override"]))


def without_legs(legs: DataFrame, gone: DataFrame) -> DataFrame:
    return legs.join(gone.select("mission_id", "objective_id"), ["mission_id", "objective_id"], "left_anti")


def with_legs(legs: DataFrame, added: DataFrame) -> DataFrame:
    """added: mission_id, kind, commodity, scu_total, location, at. Ids are numbered among those that exist already."""
    stem = F.concat_ws("_", F.lit("manual"), "kind", F.col("at").cast("string"))
    taken = legs.withColumn("stem", F.regexp_extract("objective_id", r"^(manual_[a-z]+_\d+)_\d+\z", 1)).filter("stem <> ''").groupBy("mission_id", "stem").agg(
        F.max(F.regexp_extract("objective_id", r"_(\d+)\z", 1).cast("long")).alias("most")
    )
    new = added.withColumn("stem", stem).join(taken, ["mission_id", "stem"], "left")
    number = F.row_number().over(Window.partitionBy("mission_id", "stem").orderBy("commodity", "location", "scu_total")) + F.coalesce("most", F.lit(-1))
    made = new.select(
        "mission_id", F.concat_ws("_", "stem", number.cast("string")).alias("objective_id"), "kind", "commodity", F.col("scu_total").cast("long").alias("scu_total"), F.lit(0).cast("long").alias("scu_delivered"),
        "location", F.lit(False).alias("completed"), F.col("at").alias("manual_override"),
    )
    return legs.unionByName(made, allowMissingColumns=True)


def recomputed(missions: DataFrame, legs: DataFrame, at: int) -> DataFrame:
    """missions with the status that their legs give, where nothing ended them; a mission that is complete by its legs
    keeps the time it has or gets `at`."""
    new = status_rollup(missions, legs).withColumnRenamed("status", "__status")
    out = missions.join(new, "id", "left")
    free = F.col("terminal_source").isNull() | is_open(F.col("status"))
    when = F.when(~free, F.col("completed_at")).when(F.col("__status") == "complete", F.coalesce("completed_at", F.lit(at)))
    return out.withColumn("completed_at", when.cast("long")).withColumn("status", F.coalesce("__status", "status")).select(*missions.columns)


def abandoned(missions: DataFrame, ids: DataFrame, at: int) -> DataFrame:
    """missions of which those of the ids are ended by hand; the rows stay."""
    return patched_missions(missions, ids.select("id", F.lit(at).cast("long").alias("at"), F.lit("abandoned").alias("status")))


def paid(missions: DataFrame, payouts: DataFrame, at: int) -> DataFrame:
    """missions with payouts (id, payout) set by hand."""
    return patched_missions(missions, payouts.select("id", F.lit(at).cast("long").alias("at"), F.col("payout").cast("long").alias("payout")))


def toggled(legs: DataFrame, keys: DataFrame, at: int) -> DataFrame:
    """legs of which those of the keys (mission_id, objective_id) are checked off, or opened again if they were."""
    now = legs.join(keys.select("mission_id", "objective_id").distinct(), ["mission_id", "objective_id"], "left_semi")
    return patched_legs(legs, now.select("mission_id", "objective_id", F.lit(at).cast("long").alias("at"), (~F.col("completed")).alias("completed")))


def deleted(missions: DataFrame, legs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("id")
    return missions.join(gone, "id", "left_anti"), legs.join(gone.withColumnRenamed("id", "mission_id"), "mission_id", "left_anti")


def cleared_active(missions: DataFrame, legs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """missions and legs without the live open ones, and how many went."""
    active = missions.filter((F.col("session") == "live") & is_open(F.col("status"))).select("id")
    return (*deleted(missions, legs, active), active.agg(F.count(F.lit(1)).alias("cleared")))


def check_off(missions: DataFrame, legs: DataFrame, lines: DataFrame, at: int) -> DataFrame:
    """legs after lines (kind, location, commodity) are toggled over all open missions: done if any was open, else
    all opened again."""
    mine = missions.filter(is_open(F.col("status"))).select(F.col("id").alias("mission_id"))
    hit = legs.join(mine, "mission_id", "left_semi").join(lines, ["kind", "location", "commodity"], "left_semi")
    all_done = hit.groupBy("kind", "location", "commodity").agg(F.min(F.col("completed").cast("int")).alias("all"))
    patches = hit.join(all_done, ["kind", "location", "commodity"]).select("mission_id", "objective_id", F.lit(at).cast("long").alias("at"), (F.col("all") == 0).alias("completed"))
    return patched_legs(legs, patches)
