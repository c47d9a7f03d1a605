"""Queries about reply forests and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import values
from threadloom.operators import forest
from threadloom.operators.relational import density, percentiles, rounded
from threadloom.plans.registry import query
from threadloom.sources.fixtures import EVENTS_SQL, forum_events, forum_tree

TREE_SQL = """
tree AS (
  SELECT conv_id AS article, concat_ws('-', conv_id, turn) AS comment_id, turn AS ord, CAST(turn % 3 AS INT) AS level, role, text FROM conversations
), rooted AS (
  SELECT *, last_value(CASE WHEN level = 0 THEN comment_id END IGNORE NULLS) OVER (PARTITION BY article ORDER BY ord ROWS UNBOUNDED PRECEDING) AS root_of_tree FROM tree
)
"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.with_roots(forum_tree(spark, sf_dir))


@query(f"WITH {TREE_SQL} SELECT article, comment_id, root_of_tree, count(*) OVER (PARTITION BY article, root_of_tree) AS size_of_tree, max(level) OVER (PARTITION BY article, root_of_tree) AS height_of_tree FROM rooted")
def tree_size_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.with_tree_shape(_tree(spark, sf_dir)).select("article", "comment_id", "root_of_tree", "size_of_tree", "height_of_tree")


@query(f"""WITH {TREE_SQL} SELECT c.article, c.comment_id, CASE WHEN c.level = 0 THEN '' ELSE (SELECT max_by(p.comment_id, p.ord) FROM tree p WHERE p.article = c.article AND p.level = c.level - 1 AND p.ord < c.ord) END AS direct_root_id FROM tree c""")
def direct_parent_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.with_parents(_tree(spark, sf_dir)).select("article", "comment_id", "direct_root_id")


@query("""WITH t AS (SELECT conv_id AS article, concat_ws('-', conv_id, turn) AS comment_id, turn AS ord, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS level FROM conversations)
SELECT c.article, c.comment_id, CASE WHEN c.level = 0 THEN '' ELSE (SELECT max_by(p.comment_id, p.ord) FROM t p WHERE p.article = c.article AND p.level = c.level - 1 AND p.ord < c.ord) END AS direct_root_id FROM t c""")
def direct_parent_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents where whole levels are missing."""
    rows = forum_tree(spark, sf_dir).withColumn("level", F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2))
    return forest.with_parents(rows).select("article", "comment_id", "direct_root_id")


@query(f"""WITH {TREE_SQL}, r AS (SELECT article, root_of_tree AS comment_id, count(*) - 1 AS n FROM rooted GROUP BY ALL) SELECT t.article, t.comment_id, coalesce(r.n, 0) AS all_replies FROM tree t LEFT JOIN r USING (article, comment_id)""")
def replies_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.with_replies(_tree(spark, sf_dir)).select("article", "comment_id", "all_replies")


@query("""WITH l AS (SELECT l_suppkey AS article, CASE WHEN l_partkey % 50 = 0 THEN '' ELSE CAST(l_partkey % 97 AS VARCHAR) END AS id, l_returnflag = 'R' AS pinned,
row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS ord FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY article, id ORDER BY pinned DESC, ord) AS k FROM l WHERE id <> '') SELECT article, id, pinned, CAST(ord AS INT) AS ord FROM n WHERE k = 1""")
def dedup_keep_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    place = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = lines.select(F.col("l_suppkey").alias("article"), F.when(F.col("l_partkey") % 50 == 0, "").otherwise((F.col("l_partkey") % 97).cast("string")).alias("id"), (F.col("l_returnflag") == "R").alias("pinned"), F.row_number().over(place).alias("order"))
    return forest.deduplicated(rows).withColumnRenamed("order", "ord")


@query(f"""WITH {EVENTS_SQL} SELECT article, comment_id, CAST(rank() OVER w AS INT) AS min_rank, round(rank() OVER w / count(*) OVER (PARTITION BY article) * 100, 6) + 0.0 AS percentile,
round((ts - min(ts) OVER (PARTITION BY article)) / 60.0::DOUBLE, 6) + 0.0 AS minutes, round(((ts - min(ts) OVER (PARTITION BY article)) % 86400) / 60.0::DOUBLE, 6) + 0.0 AS minutes_of_day FROM posts WINDOW w AS (PARTITION BY article ORDER BY ts)""")
def min_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, order = Window.partitionBy("article"), Window.partitionBy("article").orderBy("ts")
    first = F.min("ts").over(whole)
    rows = forum_events(spark, sf_dir).select(
        "article", "comment_id", F.rank().over(order).alias("min_rank"), (F.rank().over(order) / F.count("*").over(whole) * 100).alias("percentile"),
        values.minutes_since_first("ts", first).alias("minutes"), values.minutes_since_first("ts", first, True).alias("minutes_of_day"),
    )
    return rounded(rows)


@query(f"WITH {EVENTS_SQL}, m AS (SELECT pinned, (ts - min(ts) OVER (PARTITION BY article)) / 60.0::DOUBLE AS minutes, value FROM posts) SELECT pinned, round(median(minutes), 6) + 0.0 AS median_minutes, round(median(value), 6) + 0.0 AS median_value FROM m GROUP BY pinned")
def median_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = forum_events(spark, sf_dir).select("article", "pinned", "ts", "value")
    first = posts.groupBy("article").agg(F.min("ts").alias("first"))
    rows = posts.join(first, "article").select("pinned", values.minutes_since_first("ts", F.col("first")).alias("minutes"), "value")
    return rounded(percentiles(rows, "minutes", {"median_minutes": 0.5}, "pinned").join(percentiles(rows, "value", {"median_value": 0.5}, "pinned"), "pinned"))


@query(f"""WITH {EVENTS_SQL}, b AS (SELECT pinned, round(value / 0.2::DOUBLE) AS b, count(*) AS c FROM posts WHERE value IS NOT NULL GROUP BY ALL), x AS (SELECT unnest(range(0, 21)) * 5.0::DOUBLE AS x)
SELECT pinned, x, round(sum(c * exp(-pow((x - b * 0.2::DOUBLE) / 2, 2) / 2)) / (sum(c) * 2 * 2.5066282746310002), 6) + 0.0 AS density FROM b, x GROUP BY pinned, x""")
def density_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density(forum_events(spark, sf_dir).filter("value is not null"), "value", 0.0, 100.0, 21, 2.0, "pinned"))


@query(f"""WITH {EVENTS_SQL} SELECT article, time_bucket(INTERVAL 1 HOUR, "time") AS start, count(*) AS comments, CAST(sum(votes) AS BIGINT) AS votes FROM posts GROUP BY ALL""")
def hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forum_events(spark, sf_dir)
    return rows.groupBy("article", F.date_trunc("hour", "time").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("comments"), F.sum("votes").alias("votes"))
