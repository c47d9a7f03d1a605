"""Queries about editors' picks and readers' votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import overlap
from threadloom.operators.relational import rounded
from threadloom.plans.registry import query
from threadloom.sources.fixtures import FORUM_SQL, forum_ranking

FLAGS_SQL = """
flags AS (
  SELECT *, row_number() OVER (PARTITION BY article ORDER BY votes_pos DESC, ord) <= picks AS top_up, row_number() OVER (PARTITION BY article ORDER BY votes_neg DESC, ord) <= picks AS top_down
  FROM (SELECT *, sum(CASE WHEN pinned THEN 1 ELSE 0 END) OVER (PARTITION BY article) AS picks FROM forum)
)
"""


def _pair(a: str, b: str) -> str:
    return f"count(*) FILTER ({a} AND {b}) / nullif(count(*) FILTER ({a} OR {b}), 0)"


@query(f"WITH {FORUM_SQL}, {FLAGS_SQL} SELECT article, comment_id FROM flags WHERE top_up")
def group_top_k_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.top_like_picks(forum_ranking(spark, sf_dir), "votes_pos", "top").filter("top").select("article", "comment_id")


@query(f"""WITH {FORUM_SQL}, {FLAGS_SQL} SELECT article, count(*) FILTER (pinned) AS picks, round({_pair("pinned", "top_up")}, 6) + 0.0 AS pick_up, round({_pair("pinned", "top_down")}, 6) + 0.0 AS pick_down, round({_pair("top_up", "top_down")}, 6) + 0.0 AS up_down FROM flags GROUP BY article HAVING count(*) FILTER (pinned) > 0""")
def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap.preferences(forum_ranking(spark, sf_dir))
    return rounded(found.toDF("article", "picks", "pick_up", "pick_down", "up_down"))


@query(f"""WITH {FORUM_SQL}, {FLAGS_SQL}, j AS (SELECT {_pair("pinned", "top_up")} AS a, {_pair("pinned", "top_down")} AS b FROM flags GROUP BY article HAVING count(*) FILTER (pinned) > 0) SELECT round(avg(a), 6) + 0.0 AS pick_up, round(avg(b), 6) + 0.0 AS pick_down FROM j""")
def jaccard_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap.preferences(forum_ranking(spark, sf_dir))
    return rounded(found.agg(F.avg("pinned|top_up").alias("pick_up"), F.avg("pinned|top_down").alias("pick_down")))


@query(f"""WITH {FORUM_SQL}, a AS (SELECT * FROM forum ORDER BY lexdiv DESC, article, ord LIMIT 10), b AS (SELECT * FROM forum ORDER BY pred_nb DESC, article, ord LIMIT 10)
SELECT (SELECT avg(CAST(pinned AS DOUBLE)) FROM a) AS picks_a, (SELECT avg(CAST(pinned AS DOUBLE)) FROM b) AS picks_b, (SELECT count(*) FROM a SEMI JOIN b USING (article, comment_id)) / 10.0::DOUBLE AS shared""")
def global_topk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_shares(forum_ranking(spark, sf_dir), "lexdiv", "pred_nb", 10)


@query(f"WITH {FORUM_SQL} SELECT article, comment_id, lexdiv FROM forum ORDER BY lexdiv DESC, article, ord LIMIT 10")
def global_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.global_top(forum_ranking(spark, sf_dir), "lexdiv", 10).select("article", "comment_id", "lexdiv")
