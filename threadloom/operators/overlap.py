"""What editors and readers prefer, and how far they agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_like_picks(df: DataFrame, by: str, flag: str) -> DataFrame:
    """flag: whether a comment is among the top k of its article by a column, k being the article's picks."""
    article = Window.partitionBy("article")
    best = Window.partitionBy("article").orderBy(F.col(by).desc_nulls_last(), "order")
    return df.withColumn("_k", F.sum(F.col("pinned").cast("int")).over(article)).withColumn(flag, F.row_number().over(best) <= F.col("_k")).drop("_k")


def jaccard(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Per article with picks: common comments over comments of either flag, for each pair of flags."""
    cells = [(F.count_if(F.col(a) & F.col(b)) / F.nullif(F.count_if(F.col(a) | F.col(b)), F.lit(0))).alias(f"{a}|{b}") for a, b in pairs]
    return df.groupBy("article").agg(F.count_if("pinned").alias("picks"), *cells).filter("picks > 0")


def preferences(df: DataFrame, up: str = "votes_pos", down: str = "votes_neg") -> DataFrame:
    """Jaccard of picks, most up-voted and most down-voted comments of each article."""
    flagged = top_like_picks(top_like_picks(df, up, "top_up"), down, "top_down")
    return jaccard(flagged, [("pinned", "top_up"), ("pinned", "top_down"), ("top_up", "top_down")])


def global_top(df: DataFrame, by: str, k: int) -> DataFrame:
    """The first k comments of all by a column; ties by article and place."""
    return df.orderBy(F.col(by).desc_nulls_last(), "article", "order").limit(k)


def overlap_shares(df: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """Shares of picks among the global top k by a and by b, and of comments in both."""
    keys = ["article", "comment_id"]
    top_a, top_b = global_top(df, a, k), global_top(df, b, k)
    both = top_a.join(top_b.select(*keys), keys, "left_semi")
    return top_a.agg(F.avg(F.col("pinned").cast("double")).alias("picks_a")).crossJoin(top_b.agg(F.avg(F.col("pinned").cast("double")).alias("picks_b"))).crossJoin(both.agg((F.count("*") / k).alias("shared")))
