"""A corpus from documents: toxic ones go, one of each near-duplicate group stays, repeated strings go, domains are
mixed to their target weights, and what is left is packed into training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next
stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import minhash, mixing, packing, repeats, toxicity
from ledgerline.llm.common import dense_positions, load, shared_dir
from ledgerline.llm.queries import MIXTURE

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; rows without text stay."""
    return toxicity.without_toxic(docs, load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of documents with a shingle similarity of 0.8 stays; rows without an id too.

    Rows of one id and text are one document, of which the least row stays. An id with several texts is as many
    documents: then (id, hash of the text) are numbered in order and the numbers stand for the ids.
    """
    rows = docs.filter("doc_id IS NOT NULL").withColumn("__text", F.xxhash64("text"))
    texts = rows.groupBy("doc_id").agg(F.min("__text").alias("a"), F.max("__text").alias("b"))
    ids = texts.agg(F.max(F.col("a") != F.col("b")).alias("several"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    if ids.several:
        place = (F.col("doc_id").cast("double") - float(ids.least)) / (float(ids.most) - float(ids.least) + 1)
        numbers = dense_positions(rows.select("doc_id", "__text").distinct(), [], ["doc_id", "__text"], place, "__id")
        rows = rows.join(numbers, ["doc_id", "__text"])
    else:
        rows = rows.withColumn("__id", F.col("doc_id").cast("long"))
    groups = minhash.near_duplicates(rows.select(F.col("__id").alias("doc_id"), "text"), percent=80, side=7)
    kept = groups.filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    one_each = rows.groupBy("__id").agg(F.min(F.struct(*docs.columns)).alias("row")).join(kept, "__id", "left_semi").select("row.*")
    return one_each.unionByName(docs.filter("doc_id IS NULL"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur twice lose their bytes; n_chars follows; documents left without a word go."""
    out = repeats.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; documents of domains short of their target weight are repeated by their fitted rates."""
    return mixing.mixed(docs, load(spark, sf_dir, "labels"), MIXTURE, least=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 tokens."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: No SQL expresses the trained stages; the tests hold each stage against brute force.
ORACLE_SQL = None
