"""The engine's tables from the relational test tables, in DataFrames and in SQL.

orders are missions, line items are legs, the supplier's nation is the place and the part's type the commodity. All
derivations are deterministic. The SQL_* texts are the same derivations as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.sources.sizes import looked_up, spread

REST = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    key = F.col("o_orderkey")
    done = F.col("o_orderstatus") == "F"
    accepted = ms(F.col("o_orderdate"))
    return looked_up(orders, orders.count, "o_custkey", customers, "c_custkey").select(
        key.cast("string").alias("id"), F.concat(F.lit("Haul "), F.col("o_orderpriority")).alias("title"), F.col("c_mktsegment").alias("giver"),
        F.when(F.substring("o_orderpriority", 1, 1) == "1", "A_TO_B").when(F.substring("o_orderpriority", 1, 1) == "2", "SINGLE_TO_MULTI").when(F.substring("o_orderpriority", 1, 1) == "3", "MULTI_TO_SINGLE").otherwise("MANUAL").alias("variant"),
        F.when(done, "complete").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("accepted").alias("status"),
        F.when(done & (key % 5 != 0), F.floor("o_totalprice")).cast("long").alias("payout"),
        F.when(key % 2 == 0, "confirmed").otherwise("approximate").alias("payout_confidence"),
        F.floor("o_totalprice").cast("long").alias("reward"), accepted.alias("accepted_at"),
        F.when(done, accepted + (key % 30) * 86400000).cast("long").alias("completed_at"), key.cast("long").alias("created_seq"),
        F.when(F.col("o_custkey") % 3 == 0, "historical").otherwise("live").alias("session"),
        F.when(done & (key % 4 != 0), "game").when(key % 4 == 0, "manual").alias("terminal_source"),
    )


SQL_MISSIONS = """missions AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Haul ' || o_orderpriority AS title, c_mktsegment AS giver,
           CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A_TO_B' WHEN '2' THEN 'SINGLE_TO_MULTI' WHEN '3' THEN 'MULTI_TO_SINGLE' ELSE 'MANUAL' END AS variant,
           CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'in_progress' ELSE 'accepted' END AS status,
           CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS payout,
           CASE WHEN o_orderkey % 2 = 0 THEN 'confirmed' ELSE 'approximate' END AS payout_confidence,
           CAST(floor(o_totalprice) AS BIGINT) AS reward, epoch_us(o_orderdate) // 1000 AS accepted_at,
           CASE WHEN o_orderstatus = 'F' THEN epoch_us(o_orderdate) // 1000 + (o_orderkey % 30) * 86400000 END AS completed_at,
           o_orderkey AS created_seq, CASE WHEN o_custkey % 3 = 0 THEN 'historical' ELSE 'live' END AS session,
           CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 <> 0 THEN 'game' WHEN o_orderkey % 4 = 0 THEN 'manual' END AS terminal_source
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    suppliers, nations = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    rows = items.count()
    numbered = spread(items, rows, "l_orderkey").withColumn("leg_no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*REST)))
    # two joins, not one with a joined table, whose size Spark would put at the product of both
    placed = looked_up(numbered, lambda: rows, "l_suppkey", suppliers, "s_suppkey").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    placed = placed.select("l_orderkey", "l_partkey", "leg_no", "l_quantity", "l_returnflag", "l_linestatus", F.when(F.col("l_suppkey") % 17 != 0, F.col("n_name")).alias("location"))
    return looked_up(placed, lambda: rows, "l_partkey", parts, "p_partkey").select(
        F.col("l_orderkey").cast("string").alias("mission_id"), F.lpad(F.col("leg_no").cast("string"), 3, "0").alias("objective_id"),
        F.when(F.col("l_linestatus") == "O", "pickup").otherwise("dropoff").alias("kind"), F.col("p_type").alias("commodity"),
        F.col("l_quantity").cast("long").alias("scu_total"),
        F.when(F.col("l_returnflag") == "A", F.floor(F.col("l_quantity") / 2)).otherwise(0).cast("long").alias("scu_delivered"),
        "location", (F.col("l_returnflag") == "R").alias("completed"),
    )


SQL_LEGS = """legs AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS mission_id,
           lpad(CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS VARCHAR), 3, '0') AS objective_id,
           CASE WHEN l_linestatus = 'O' THEN 'pickup' ELSE 'dropoff' END AS kind, p_type AS commodity, CAST(l_quantity AS BIGINT) AS scu_total,
           CASE WHEN l_returnflag = 'A' THEN CAST(floor(l_quantity / 2) AS BIGINT) ELSE 0 END AS scu_delivered,
           CASE WHEN l_suppkey % 17 <> 0 THEN n_name END AS location, l_returnflag = 'R' AS completed
    FROM lineitem LEFT JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON l_suppkey = s_suppkey
    LEFT JOIN part ON l_partkey = p_partkey)"""


def ledger(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """amount, ts of one kind of event, once for each pair."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return events.select(F.floor("value").cast("long").alias("amount"), ms(F.col("ts")).alias("ts"))


def sql_ledger(name: str, kind: str) -> str:
    return f"{name} AS (SELECT DISTINCT CAST(floor(value) AS BIGINT) AS amount, epoch_us(ts) // 1000 AS ts FROM events WHERE event_type = '{kind}')"
