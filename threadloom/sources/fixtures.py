"""Discussion tables derived from the generated benchmark tables.

Comments need an explicit place in their discussion, since a DataFrame has no
order of rows; it is made from the time and the comment's id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators import forest
from threadloom.sources.tables import table

#: Scores of a comment that rankings are judged by, and the columns they come from.
FEATURES = ("lexdiv", "sim", "smog", "sentcomp")


def seconds(column: str) -> Column:
    """Whole seconds since 1970 of a time without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def forum_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as discussions and their order lines as comments."""
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"), seconds("l_shipdate"))
    comments = rows.select(
        F.col("l_suppkey").alias("article"),
        F.md5(key).alias("comment_id"),
        seconds("l_shipdate").alias("ts"),
        F.col("l_quantity").cast("int").alias("votes_pos"),
        F.round(F.col("l_tax") * 100).cast("int").alias("votes_neg"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("pinned"),
        F.col("l_extendedprice").alias("lexdiv"),
        F.col("l_discount").alias("sim"),
        F.col("l_quantity").alias("smog"),
        F.col("l_tax").alias("sentcomp"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pred_nb"),
        (F.col("l_partkey") % 1000).cast("double").alias("pred_xgb"),
    )
    place = Window.partitionBy("article").orderBy("ts", "comment_id")
    placed = comments.withColumn("order", F.row_number().over(place)).withColumn("votes_rel", F.col("votes_pos") - F.col("votes_neg"))
    placed = placed.withColumn("level", (F.col("order") - 1) % 4).withColumn("pin_lr", F.col("pred_nb")).withColumn("pin_xgb", F.col("pred_xgb"))
    return forest.with_roots(placed)


FORUM_SQL = """
lines AS (
  SELECT l_suppkey AS article,
         md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(epoch(l_shipdate) AS BIGINT))) AS comment_id,
         CAST(epoch(l_shipdate) AS BIGINT) AS ts, CAST(l_quantity AS INT) AS votes_pos, CAST(round(l_tax * 100) AS INT) AS votes_neg,
         l_returnflag = 'R' AND l_linenumber = 1 AS pinned, l_extendedprice AS lexdiv, l_discount AS sim, l_quantity AS smog, l_tax AS sentcomp,
         l_extendedprice * (1 - l_discount) AS pred_nb, CAST(l_partkey % 1000 AS DOUBLE) AS pred_xgb
  FROM lineitem
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY article ORDER BY ts, comment_id) AS ord, votes_pos - votes_neg AS votes_rel FROM lines
), forum AS (
  SELECT *, (ord - 1) % 4 AS level, ord - (ord - 1) % 4 AS root_ord, (ord - 1) % 4 = 0 AS is_root FROM placed
)
"""


def forum_events(spark: SparkSession, folder: str) -> DataFrame:
    """Users as discussions and their events as comments."""
    return table(spark, folder, "events", "event_id", "user_id", "ts", "event_type", "value").select(
        F.col("user_id").alias("article"), F.col("event_id").alias("comment_id"), F.col("ts").alias("time"), seconds("ts").alias("ts"), (F.col("event_type") == "purchase").alias("pinned"), F.floor("value").cast("int").alias("votes"), F.col("event_type").alias("kind"), "value"
    )


EVENTS_SQL = """
posts AS (
  SELECT user_id AS article, event_id AS comment_id, ts AS "time", CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS ts,
         event_type = 'purchase' AS pinned, CAST(floor(value) AS INT) AS votes, event_type AS kind, value
  FROM events
)
"""


def forum_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as discussions: turns 0, 3, 6 open a tree, others reply one level deeper."""
    return table(spark, folder, "conversations", "conv_id", "turn", "role", "text").select(
        F.col("conv_id").alias("article"), F.concat_ws("-", "conv_id", "turn").alias("comment_id"), F.col("turn").alias("order"), (F.col("turn") % 3).cast("int").alias("level"), "role", "text"
    )


def forum_text(spark: SparkSession, folder: str) -> DataFrame:
    """Sources as articles and documents as comments."""
    return table(spark, folder, "documents", "doc_id", "source", "lang", "text").select(F.col("source").alias("article"), F.col("doc_id").alias("comment_id"), "lang", "text")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels."""
    return table(spark, folder, "documents", "doc_id", "n_chars", "lang", "source").join(table(spark, folder, "labels"), "doc_id")


def articles_join(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with their order's customer, nation and region: three genres with holes."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_tax", "l_shipdate")
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey")
    nations, regions = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    known = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return lines.join(known, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_tax", "l_shipdate", "o_orderdate",
        F.col("o_orderpriority").alias("genre1"), F.nullif(F.col("n_name"), F.lit("CHINA")).alias("genre2"), F.nullif(F.col("r_name"), F.lit("ASIA")).alias("genre3"),
    )


ARTICLES_SQL = """
joined AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_tax, l_shipdate, o_orderdate, o_orderpriority AS genre1, nullif(n_name, 'CHINA') AS genre2, nullif(r_name, 'ASIA') AS genre3
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)
"""


def demo_orders(spark: SparkSession, n: int = 100, alpha: float = 1.0, beta: float = 1.0, seed: int = 100) -> DataFrame:
    """(article, order, x): n Beta numbers in four orders, for figures of the score: sorted down, every second place shuffled, all shuffled, sorted up."""
    r = np.random.default_rng(seed)
    down = np.sort(r.beta(alpha, beta, n))[::-1]
    half = down.copy()
    half[::2] = r.permutation(half[::2])
    orders = {"sorted": down, "half": half, "shuffled": r.permutation(down), "reversed": down[::-1]}
    return spark.createDataFrame([(name, k, float(x)) for name, values in orders.items() for k, x in enumerate(values, 1)], "article string, `order` int, x double")
