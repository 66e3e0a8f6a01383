"""SimHash fingerprints and search within a Hamming radius; DataFrame functions only.

A text's terms are its runs of five words (padded at both ends, so that texts of any length with a word have terms),
weighted by how often they occur. Each term's 64-bit hash votes on 64 signed bits; a bit is set if more weight votes
for it than against (a tie leaves it 0). A text without words has fingerprint 0. Two counters share a 64-bit lane, so
32 sums carry the votes; they can't overflow below 2^32 terms in a text.

near_fingerprints cuts the bits into `pieces`, and for each choice of pieces - radius of them has a table with those
pieces moved to the front as its key: two fingerprints within the radius agree in at least one table. Buckets that
hold many fingerprints are cut into chunks of bounded size, and a fingerprint meets whole chunks, so a bucket never
turns into its pairs of rows.

Null texts count as empty. Repeated rows are rows each. Empty table: no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import materialize, parallelism, text_of

BITS = 64
WORDS = 5
LANES = 0x0000000100000001
SPACES = r"[\x20\x09-\x0D]+"


def votes() -> list[Column]:
    """The aggregates of a term hash column `term`: 32 sums of two counters, and the number of terms."""
    lane = F.lit(LANES)
    return [F.sum(F.shiftrightunsigned("term", i).bitwiseAND(lane)).alias(f"s{i}") for i in range(32)] + [
        F.count("term").alias("terms")
    ]


def fingerprint_of(prefix: str = "") -> Column:
    """The fingerprint (long) from the columns that votes() made."""
    terms = F.col(f"{prefix}terms")
    out = F.lit(0).cast("long")
    for i in range(32):
        pair = F.col(f"{prefix}s{i}")
        low, high = pair.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(pair, 32)
        for bit, ones in ((i, low), (i + 32, high)):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out.bitwiseOR(F.when(2 * ones > terms, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def terms_of(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """A row a term: the kept columns and the term's hash; texts without words give one row with a null term."""
    words = F.filter(F.split(F.lower(text), SPACES), lambda w: w != "")
    pad = F.array(*[F.lit("")] * (WORDS - 1))
    split = df.select(*keep, words.alias("__w"))
    padded = split.select(*keep, F.when(F.size("__w") > 0, F.concat(pad, "__w", pad)).alias("__w"))
    n = F.size("__w")
    shifted = [F.slice("__w", i + 1, F.greatest(n - (WORDS - 1), F.lit(0))).alias(f"w{i}") for i in range(WORDS)]
    rows = padded.select(*keep, F.inline_outer(F.arrays_zip(*shifted)))
    return rows.select(*keep, F.when(F.col("w0").isNotNull(), F.xxhash64(*[f"w{i}" for i in range(WORDS)])).alias("term"))


def fingerprints(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, fingerprint: one row for each distinct key; keys should identify rows."""
    return terms_of(df, text, keys).groupBy(*keys).agg(*votes()).select(*keys, fingerprint_of().alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def hex16(f: Column) -> Column:
    return F.lower(F.lpad(F.hex(f), 16, "0"))


def in_order(docs: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """doc_id, text, bucket: the buckets follow one another in ascending doc_id, and each holds a row (nulls: first)."""
    stats = docs.agg(
        F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 100 * buckets), F.max("doc_id")
    ).first()
    edges = sorted({*(stats[0] or []), *([stats[1]] if stats[1] is not None else [])})
    if len(edges) < 2:
        return docs.withColumn("bucket", F.lit(0)), 1
    step = max(1, int(len(edges) ** 0.5))
    coarse, every = F.lit(edges[step - 1 :: step]), F.lit(edges)
    inner = F.size(F.filter(coarse, lambda e: e < F.col("doc_id")))
    fine = F.size(F.filter(F.slice(every, inner * step + 1, F.lit(step)), lambda e: e < F.col("doc_id")))
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(inner * step + fine)), len(edges)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next document in ascending doc_id; after the last comes the first. Rows of one doc_id follow in order of text.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", text_of().alias("text"))
    placed, n = in_order(base, 4 * parallelism(spark))
    # each bucket also gets a copy of the first row of the next one, marked, so that no row lacks its successor
    first = placed.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("x"))
    guests = first.select(F.col("x.doc_id").alias("doc_id"), F.col("x.text").alias("text"), F.pmod(F.col("bucket") - 1, F.lit(n)).cast("int").alias("bucket"), F.lit(1).alias("guest"))
    rows = placed.withColumn("bucket", F.col("bucket").cast("int")).withColumn("guest", F.lit(0)).unionByName(guests)
    order = Window.partitionBy("bucket").orderBy("guest", F.asc_nulls_first("doc_id"), "text")
    chars = F.length("text")
    quarter = F.floor(chars / 4).cast("int")
    follow = rows.withColumn("at", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 4) as int))"))
    both = follow.select(
        "bucket", "at", "guest", "doc_id", chars.cast("long").alias("n_chars"),
        F.when(F.col("guest") == 0, F.sha2(edited.cast("binary"), 256)).alias("edited_sha256"),
        F.array(F.struct(F.lit(0).alias("edit"), F.col("text").alias("t")), F.struct(F.lit(1).alias("edit"), F.when(F.col("guest") == 0, edited).otherwise("").alias("t"))).alias("texts"),
    )
    split = both.select("bucket", "at", "guest", "doc_id", "n_chars", "edited_sha256", F.inline("texts"))
    keys = ["bucket", "at", "edit", "guest", "doc_id", "n_chars", "edited_sha256"]
    single = terms_of(split, "t", keys).groupBy("bucket", "at", "edit").agg(*[F.first(c).alias(c) for c in keys[3:]], *votes())
    marks = single.select(*keys, fingerprint_of().alias("f"))
    one = marks.groupBy("bucket", "at").agg(
        *[F.first(c).alias(c) for c in keys[3:]],
        F.max(F.when(F.col("edit") == 0, F.col("f"))).alias("f"),
        F.max(F.when(F.col("edit") == 1, F.col("f"))).alias("g"),
    )
    seen = Window.partitionBy("bucket").orderBy("at")
    return (
        one.withColumn("next_f", F.lead("f").over(seen))
        .filter(F.col("guest") == 0)
        .select(
            "doc_id", "n_chars", "edited_sha256", F.col("f").alias("fingerprint_bits"),
            hex16(F.col("f")).alias("fingerprint"), hex16(F.col("g")).alias("edited_fingerprint"),
            likeness(F.col("f"), F.col("g")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"),
        )
    )


def near_fingerprints(prints: DataFrame, column: str = "fingerprint_bits", radius: int = 3, pieces: int = 5, chunk: int = 256) -> DataFrame:
    """column, near_distinct: how many other distinct fingerprints lie within the radius of each that has one.

    A table's key are the `pieces - radius` pieces that it holds fixed, 26 of 64 bits here: of n fingerprints in general
    position n * n * 10 / 2 ** 26 pairs meet, besides those that are alike, so more pieces suit more fingerprints.
    """
    edges = [round(i * BITS / pieces) for i in range(pieces + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(pieces)]
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    choices = list(itertools.combinations(range(pieces), pieces - radius))
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("f").bitwiseAND(signed(sum(masks[i] for i in c))).alias("key")) for t, c in enumerate(choices)])
    rows = prints.select(F.col(column).alias("f")).distinct().select("f", F.inline(tables))
    full = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = full.select("t", "key", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    members = materialize(rows.join(materialize(sized, "simhash-buckets"), ["t", "key"]), "simhash-members")
    part = F.pmod(F.xxhash64("f"), F.col("parts")).cast("int").alias("part")
    chunks = members.groupBy("t", "key", part).agg(F.collect_list("f").alias("others"))

    def first_table(x: Column) -> Column:
        """The first table in which two fingerprints with this difference agree."""
        out = F.lit(len(choices))
        for t in reversed(range(len(choices))):
            out = F.when(x.bitwiseAND(signed(sum(masks[i] for i in choices[t]))) == 0, F.lit(t)).otherwise(out)
        return out

    # a member meets the chunks of its bucket one by one, each in the task of that chunk: a hot bucket is many tasks
    asked = members.select("t", "key", "f", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = asked.join(materialize(chunks, "simhash-chunks"), ["t", "key", "part"])
    hits = F.filter("others", lambda o: (o != F.col("f")) & (F.bit_count(o.bitwiseXOR(F.col("f"))) <= radius) & (first_table(o.bitwiseXOR(F.col("f"))) == F.col("t")))
    return met.groupBy(F.col("f").alias(column)).agg(F.sum(F.size(hits)).alias("near_distinct")).filter("near_distinct > 0")  # summed before the shuffle


def simhash_report(docs: DataFrame, radius: int = 3) -> DataFrame:
    """document_fingerprints, and near_distinct: the other distinct fingerprints of the table within the radius."""
    marks = materialize(document_fingerprints(docs), "simhash-marks")
    # written out, so that the join reads shuffles on both sides and the rows of one fingerprint can be split
    near = materialize(near_fingerprints(marks, radius=radius), "simhash-near")
    return marks.join(near, "fingerprint_bits", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.coalesce("near_distinct", F.lit(0)).cast("long").alias("near_distinct"),
    )
