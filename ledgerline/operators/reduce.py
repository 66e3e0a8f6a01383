"""Events to missions and legs, in order of arrival (`seq`).

Each rule is an ordered aggregate (min_by or max_by on seq), so a mission's events are reduced map-side first and never
gathered. Only the running status needs the order itself, as a window over a mission's legs and completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions import logparse as P
from ledgerline.sources.scratch import written


def first_of(value: Column, when: Column | None = None) -> Column:
    ok = value.isNotNull() if when is None else when & value.isNotNull()
    return F.min_by(F.when(ok, value), F.when(ok, F.col("seq")))


def last_of(value: Column, when: Column | None = None) -> Column:
    ok = value.isNotNull() if when is None else when & value.isNotNull()
    return F.max_by(F.when(ok, value), F.when(ok, F.col("seq")))


def reduce_legs(events: DataFrame) -> DataFrame:
    """A row a mission and objective: kind, commodity, sizes, place, position, completed; first_seq, done_seq."""
    declared, marker, closed = (F.col("type") == t for t in ("objectiveDeclared", "missionMarker", "objectiveCompleted"))
    mine = events.filter(F.col("objective_id").isNotNull() & F.col("mission_id").isNotNull())
    keys = ["mission_id", "objective_id"]
    token = F.nullif(P.commodity_name(P.commodity_token(F.col("contract_template"))), F.lit(""))
    legs = mine.groupBy(*keys).agg(
        F.min("seq").alias("first_seq"), F.coalesce(last_of(F.col("kind")), F.lit("dropoff")).alias("kind"),
        F.coalesce(last_of(F.nullif(F.col("commodity"), F.lit("")), declared), first_of(token, marker), F.lit("")).alias("commodity"),
        F.coalesce(last_of(F.col("scu_total"), declared), F.lit(0)).cast("long").alias("scu_total"), last_of(F.col("location"), declared).alias("location"),
        last_of(F.col("position"), marker).alias("position"), F.min(F.when(closed, F.col("seq"))).alias("done_seq"), F.max(F.when(closed, F.col("seq"))).alias("redone_seq"),
    )
    finished = events.filter("type = 'missionEnded' AND completion_type = 'complete'").groupBy("mission_id").agg(F.max("seq").alias("end_seq"))
    legs = legs.join(finished, "mission_id", "left").withColumn(
        "at", F.greatest("redone_seq", F.when(F.col("first_seq") < F.col("end_seq"), F.col("end_seq")))
    )
    sizes = mine.filter(declared).select(*keys, "seq", F.col("scu_total").alias("size"))
    moved = sizes.join(legs.select(*keys, "at").filter("at IS NOT NULL"), keys).filter("seq < at").groupBy(*keys).agg(F.max_by("size", "seq").alias("moved"))
    return legs.join(moved, keys, "left").select(
        *keys, "kind", "commodity", "scu_total", F.coalesce("moved", F.lit(0)).cast("long").alias("scu_delivered"), "location",
        *[F.col("position")[c].alias(f"pos_{c}") for c in "xyz"], F.col("at").isNotNull().alias("completed"), F.lit(None).cast("long").alias("manual_override"), "first_seq", "done_seq",
    )


def running_status(events: DataFrame, legs: DataFrame) -> DataFrame:
    """mission_id, status, since: what the legs say at the last completion, and from when on it was complete."""
    closed = events.filter("type = 'objectiveCompleted'").select("mission_id", "seq", "ts", F.lit(0).alias("leg"), F.lit(0).alias("done"), F.lit(True).alias("look"))
    born = legs.select("mission_id", F.col("first_seq").alias("seq"), F.lit(None).cast("long").alias("ts"), F.lit(1).alias("leg"), F.lit(0).alias("done"), F.lit(False).alias("look"))
    done = legs.filter("done_seq IS NOT NULL").select("mission_id", F.col("done_seq").alias("seq"), F.lit(None).cast("long").alias("ts"), F.lit(0).alias("leg"), F.lit(1).alias("done"), F.lit(False).alias("look"))
    order = Window.partitionBy("mission_id").orderBy("seq", "look").rowsBetween(Window.unboundedPreceding, 0)
    seen = closed.unionByName(born).unionByName(done).withColumn("legs", F.sum("leg").over(order)).withColumn("closed", F.sum("done").over(order)).filter("look")
    state = seen.withColumn("all", (F.col("legs") > 0) & (F.col("legs") == F.col("closed")))
    broken = state.groupBy("mission_id").agg(F.max(F.when(~F.col("all"), F.col("seq"))).alias("broken"), F.max_by("all", "seq").alias("last"), F.max_by("closed", "seq").alias("closed"))
    since = state.join(broken.select("mission_id", "broken"), "mission_id").filter(F.col("all") & (F.col("seq") > F.coalesce("broken", F.lit(-1)))).groupBy("mission_id").agg(F.min_by("ts", "seq").alias("since"))
    return broken.join(since, "mission_id", "left").select(
        "mission_id", F.when(F.col("last"), "complete").when(F.col("closed") > 0, "in_progress").otherwise("accepted").alias("status"), "since"
    )


def reduce_missions(events: DataFrame, legs: DataFrame | None = None) -> DataFrame:
    """schemas.MISSIONS without the columns that only commands fill."""
    legs = reduce_legs(events) if legs is None else legs
    accepted, marker, ended = (F.col("type") == t for t in ("missionAccepted", "missionMarker", "missionEnded"))
    mine = events.filter(F.col("mission_id").isNotNull())
    first = F.min_by(F.when(accepted | marker, F.col("ts")), "seq")
    base = mine.groupBy(F.col("mission_id").alias("id")).agg(
        F.coalesce(first_of(F.nullif(F.col("title"), F.lit("")), accepted), F.lit("")).alias("title"), last_of(F.col("giver"), marker).alias("giver"),
        last_of(F.col("contract_template"), marker).alias("contract_template"), last_of(F.col("contract_definition_id"), marker).alias("contract_definition_id"),
        F.coalesce(first, first_of(F.col("ts"), accepted)).alias("accepted_at"), first_of(F.col("title_pickup"), accepted).alias("title_pickup"), first_of(F.col("title_dropoff"), accepted).alias("title_dropoff"),
        F.when(F.max((F.col("source") == "live").cast("int")) == 1, "live").otherwise("historical").alias("session"), F.min("seq").alias("created_seq"),
        last_of(F.struct("completion_type", "ts"), ended).alias("end"),
    )
    status = running_status(events, legs).withColumnRenamed("mission_id", "id").withColumnRenamed("status", "running")
    over = F.col("end").isNotNull()
    return base.join(status, "id", "left").select(
        "id", "title", "giver", F.when(F.col("contract_template").isNull(), "MANUAL").otherwise(P.stored_variant(F.col("contract_template"))).alias("variant"),
        F.when(F.col("contract_template").isNull(), "UNKNOWN").otherwise(P.stored_grade(F.col("contract_template"))).alias("grade"), "contract_template", "contract_definition_id",
        F.when(over & (F.col("end.completion_type") == "complete"), "complete").when(over, "abandoned").otherwise(F.coalesce("running", F.lit("accepted"))).alias("status"),
        F.lit(None).cast("long").alias("payout"), F.lit(None).cast("string").alias("payout_confidence"), F.lit(None).cast("long").alias("reward"), F.lit("log").alias("source"), "accepted_at",
        F.when(over, F.col("end.ts")).otherwise(F.col("since")).alias("completed_at"), F.lit(None).cast("string").alias("notes"), "created_seq", "title_pickup", "title_dropoff", "session",
        F.when(over, "game").alias("terminal_source"),
    )


def with_title_places(missions: DataFrame, legs: DataFrame) -> DataFrame:
    """Legs without a place take the title's, in missions from one place to one other, if they are the only leg of their
    kind."""
    count = F.count(F.lit(1)).over(Window.partitionBy("mission_id", "kind"))
    routes = missions.filter("variant = 'A_TO_B'").select(F.col("id").alias("mission_id"), "title_pickup", "title_dropoff")
    side = F.when(F.col("kind") == "pickup", F.col("title_pickup")).otherwise(F.col("title_dropoff"))
    filled = F.when((F.coalesce("location", F.lit("")) == "") & (F.col("__n") == 1), F.coalesce(side, F.col("location"))).otherwise(F.col("location"))
    return legs.withColumn("__n", count).join(routes, "mission_id", "left").withColumn("location", filled).select(*legs.columns)


def reduce_events(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """missions, legs, awards (amount, ts, seq), fines (amount, ts). Events are parsed once: they and the legs are
    written out, as several aggregations read them."""
    events = written(events, "events")
    legs = written(reduce_legs(events), "legs")
    missions = reduce_missions(events, legs)
    awards = events.filter("type = 'payoutAwarded'").groupBy("amount", "ts").agg(F.min("seq").alias("seq"))
    fines = events.filter("type = 'fined'").select("amount", "ts").distinct()
    return missions, with_title_places(missions, legs), awards, fines
