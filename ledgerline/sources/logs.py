"""Log files as tables of lines, in batch and as they land.

A line's number counts all lines of its file, also the empty ones, which are left out. Files are read by blocks: a block's
lines stand together in one task, so a line's number is its place in the block and the number of lines of the blocks
before it in its file. Only one row a block is grouped and written for that, in a first pass over the files; no file is a
row, and up to BLOCKS blocks no line is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.sources.scratch import written

#: Blocks whose places are sent to every task; beyond, lines are joined with them.
BLOCKS = 1 << 17
LINES = "source string, file_rank int, line_no int, value string"
LANDED = "source string, file string, modified timestamp, at long, value string"


def file_ranks(files: DataFrame) -> DataFrame:
    """files (file, modified, maybe path) with file_rank, by name without regard to case, then time, then path. One row a file."""
    last = ["path"] if "path" in files.columns else []
    return files.withColumn("file_rank", F.row_number().over(Window.orderBy(F.lower("file"), "modified", *last)))


def _with_meta(df: DataFrame) -> DataFrame:
    meta = F.col("_metadata")
    return df.select("*", meta["file_path"].alias("path"), meta["file_name"].alias("file"), meta["file_modification_time"].alias("modified"), meta["file_size"].alias("size"), meta["file_block_start"].alias("block"))


def _without_return(value: Column) -> Column:
    return F.when(value.endswith("\r"), F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)


def read_logs(spark: SparkSession, path: str, source: str = "historical") -> DataFrame:
    """LINES of the files under the path, the oldest first; `live` holds back a last line that is still being written.

    A file whose bytes are all accounted for by lines and their ends is closed; one more is a line without an end (a
    mark of the byte order at the start, which readers skip, takes three).
    """
    lines = _with_meta(spark.read.option("ignoreCorruptFiles", "true").option("lineSep", "\n").text(path)).withColumn("id", F.monotonically_increasing_id())
    blocks = lines.groupBy("path", "file", "modified", "size", "block").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    in_file = Window.partitionBy("path")
    n = F.col("last") - F.col("first") + 1
    blocks = blocks.withColumn("before", F.coalesce(F.sum(n).over(in_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("left", F.col("size") - F.sum("bytes").over(in_file)).withColumn("final", F.col("block") == F.max("block").over(in_file))
    ranks = file_ranks(blocks.select("path", "file", "modified").distinct()).select("path", "file_rank")
    open_line = F.when(F.col("final") & ~F.col("left").isin(0, 3) & F.lit(source == "live"), F.col("last"))
    places = written(blocks.join(ranks, "path").select("path", "block", "first", "before", "file_rank", open_line.alias("open")), "log-blocks")
    beside = F.broadcast(places) if places.count() <= BLOCKS else places
    numbered = lines.select("path", "block", "id", "value").join(beside, ["path", "block"]).filter(F.col("open").isNull() | (F.col("id") != F.col("open")))
    value = _without_return(F.col("value"))
    return numbered.filter(value != "").select(F.lit(source).alias("source"), "file_rank", (F.col("before") + F.col("id") - F.col("first")).cast("int").alias("line_no"), value.alias("value"))


def backfill_then_live(spark: SparkSession, backups: str, live: str) -> DataFrame:
    """Historical lines, then those of the current log, which ranks after all backups."""
    return read_logs(spark, backups).unionByName(read_logs(spark, live, "live").withColumn("file_rank", F.lit(1 << 20)))


def split_lines(files: DataFrame) -> DataFrame:
    """Non-empty lines of whole files (column `value`) with their numbers as `at`."""
    lines = files.select("*", F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    return lines.filter("line <> ''").drop("value").withColumnRenamed("line", "value").withColumn("at", F.col("at").cast("long"))


def stream_logs(spark: SparkSession, path: str, source: str = "live", max_files: int = 100) -> DataFrame:
    """LANDED: lines of chunk files as they land in the directory. A tailer writes chunks of bounded size that end in a
    line's end; the file source takes each once, whatever is appended to it later. What follows appended bytes is
    `tail.follow`."""
    files = _with_meta(spark.readStream.option("maxFilesPerTrigger", max_files).option("wholetext", "true").format("text").load(path))
    return split_lines(files).select(F.lit(source).alias("source"), F.col("path").alias("file"), "modified", "at", "value")


def natural(name: Column) -> Column:
    """A name in which numbers sort by their value: chunk-9 before chunk-10."""
    parts = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    wide = lambda x: F.when(x.rlike("^[0-9]{1,19}$"), F.lpad(x, 20, "0")).otherwise(x)
    return F.array_join(F.transform(parts, wide), "")


#: Bits of a number that count within a batch; what is left counts 2 ** 24 batches.
IN_BATCH = 39


def numbered(batch: DataFrame, batch_id: int) -> DataFrame:
    """A batch of LANDED lines with seq: batches in their order, in a batch files by natural name, time and path, in a file
    lines by `at`. Files take up as many numbers as `at` spans, so only one row a file is sorted; 2 ** 39 in a batch. A
    repeated batch gets the same numbers, lines of different files never share one."""
    name = F.element_at(F.split("file", "/"), -1)
    files = batch.groupBy("file").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.min("modified").alias("modified")).withColumn("name", natural(name))
    before = F.sum(F.col("high") - F.col("low") + 1).over(Window.orderBy("name", "modified", "file").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.withColumn("start", F.coalesce(before, F.lit(0)) - F.col("low")).select("file", "start")
    place = F.col("start") + F.col("at")
    seq = F.lit(batch_id << IN_BATCH) + F.when(place < F.lit(1 << IN_BATCH), place).otherwise(F.raise_error(F.lit("a batch spans more than 2 ** 39 bytes")).cast("long"))
    return batch.join(starts, "file").withColumn("seq", seq).drop("start", "modified", "at")


def recent_files(files: DataFrame, n: int = 2) -> DataFrame:
    return files.orderBy(F.desc("modified"), "file").limit(n)


def file_progress(files: DataFrame) -> DataFrame:
    """Each file's share of the whole in percent when it is through. One row a file."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return file_ranks(files).withColumn("percent", F.floor(F.col("file_rank") / n * 100 + 0.5).cast("int"))


def write_report(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)
