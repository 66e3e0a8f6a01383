"""State as text: one block a mission or run, assembled by column functions and ordered by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.fuzzy import fuzzy_match
from ledgerline.functions.logparse import last_lines
from ledgerline.functions.redact import identities, redacted

#: The title of a draft without one, rules of the reports.
DEFAULT_TITLE = "OCR Captured Contract"
MISSION_RULE, SALVAGE_RULE = "-" * 70, "=" * 70


def said(x: Column, default: str) -> Column:
    text = x.cast("string")
    return F.when(F.coalesce(text, F.lit("")) == "", default).otherwise(text)


def number(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("string")


def mission_blocks(missions: DataFrame, legs: DataFrame) -> DataFrame:
    """id, text: a mission with its legs, pickups first."""
    line = F.format_string(
        "    - [%s] %s %s/%s SCU -> %s (%s) [%s]", said(F.col("kind"), "?"), said(F.col("commodity"), "(no commodity)"), number(F.col("scu_delivered")), number(F.col("scu_total")),
        said(F.col("location"), "(no location)"), F.when(F.col("completed"), "done").otherwise("open"), said(F.col("objective_id"), "?"),
    )
    order = F.struct((F.col("kind") != "pickup").alias("k"), F.col("objective_id").alias("o"), line.alias("line"))
    lines = legs.groupBy(F.col("mission_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]).alias("lines"))
    of = lambda c, d="": said(F.col(c), d)
    all_lines = F.coalesce("lines", F.array().cast("array<string>"))
    head = F.array(
        F.concat(F.lit("mission "), of("id", "(no id)")), F.concat(F.lit("  title    : "), of("title")), F.concat(F.lit("  giver    : "), of("giver")),
        F.concat(F.lit("  variant  : "), of("variant"), F.lit("   grade: "), of("grade")), F.concat(F.lit("  status   : "), of("status", "(unknown)")), F.concat(F.lit("  source   : "), of("source", "(unknown)")),
        F.concat(F.lit("  payout   : "), said(F.col("payout"), "—"), F.lit(" ("), of("payout_confidence", "unknown"), F.lit(")")), F.concat(F.lit("  legs     : "), F.size(all_lines).cast("string")),
    )
    return missions.join(lines, "id", "left").select("id", F.array_join(F.concat(head, all_lines), "\n").alias("text"))


def status_line(missions: DataFrame) -> DataFrame:
    """One row: how many missions, and how many of each status in order of its name."""
    counts = missions.groupBy(said(F.col("status"), "(unknown)").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("s", "n"))), lambda x: F.concat_ws("=", x["s"], x["n"].cast("string")))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("missions"), F.array_join(parts, ", ").alias("by_status"))


def run_blocks(runs: DataFrame, stripped: DataFrame) -> DataFrame:
    """id, text: a salvage run with its components."""
    line = F.format_string("    - %s %s x%s @ %s (%s)", said(F.col("type"), "?"), said(F.col("model"), ""), number(F.col("qty")), number(F.col("sell_price_each")), F.when(F.col("sold"), "sold").otherwise("unsold"))
    lines = stripped.groupBy(F.col("run_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("created_seq", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    all_lines = F.coalesce("lines", F.array().cast("array<string>"))
    units = F.concat(F.lit("  materials  : rmc="), number(F.col("rmc_scu")), F.lit(" cmat="), number(F.col("cmat_scu")), F.lit(" construction="), number(F.col("construction_scu")), F.lit(" SCU"))
    head = F.array(
        F.concat(F.lit("run "), said(F.col("id"), "(no id)")), F.concat(F.lit("  status     : "), said(F.col("status"), "(unknown)")), F.concat(F.lit("  crewSize   : "), number(F.col("crew_size"))), units,
        F.concat(F.lit("  components : "), F.size(all_lines).cast("string")),
    )
    return runs.join(lines, "id", "left").select("id", F.array_join(F.concat(head, all_lines), "\n").alias("text"))


def manual_drafts(titles: DataFrame) -> DataFrame:
    """titles (title) as drafts without legs: a blank title gets a default."""
    return titles.select(F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit(DEFAULT_TITLE)).alias("title"), F.lit("").alias("giver"), F.lit("accepted").alias("status"))


def shows_banner(resolved: Column, exists: Column, state: Column) -> Column:
    """Whether a log that can't be read is worth saying: not before it is resolved."""
    return F.coalesce(F.when(~resolved, F.lit(False)).otherwise(~exists | F.coalesce(state == "disconnected", F.lit(False))), F.lit(False))


def mission_line_extract(lines: DataFrame, log: list[str], user: str | None = None, most: int = 2000) -> DataFrame:
    """The last lines about missions, in order, without the names of players and users, which are looked for in all
    lines. log: the columns of a log."""
    at = F.col("file_rank").cast("long") * F.lit(1 << 40) + F.col("line_no")
    who = identities(lines.withColumn("seq", at), log)
    kept = last_lines(lines, most).withColumn("seq", at).join(who, log, "left")
    return kept.withColumn("value", redacted(F.col("value"), F.col("handle"), F.col("geid"), user)).drop("handle", "geid").orderBy("seq")


def objectives_to_apply(objectives: DataFrame, commodities: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """objectives with blank places gone, and names as the dictionaries (idx, value) write those that they come near."""
    out = objectives.withColumn("location", F.nullif(F.trim("location"), F.lit("")))
    for column, names in (("commodity", commodities), ("location", places)):
        if names is not None:
            read = out.select(F.col(column).alias("input")).filter("input IS NOT NULL").distinct()
            near = fuzzy_match(read, names).select(F.col("input").alias(column), F.col("match").alias("__match"))
            out = out.join(near, column, "left").withColumn(column, F.coalesce("__match", column)).select(*objectives.columns)
    return out
