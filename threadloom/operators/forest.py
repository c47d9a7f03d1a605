"""Reply forests: roots, parents, sizes and heights, and removal of duplicates.

A discussion's rows are a pre-order walk of its trees: column order is the
place, level the depth. All operators are windows over one discussion, so they
share a single exchange by article.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_roots(df: DataFrame) -> DataFrame:
    """root_of_tree: the last root at or above each comment; is_root."""
    above = Window.partitionBy("article").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    root = F.last(F.when(F.col("level") == 0, F.col("comment_id")), ignorenulls=True).over(above)
    return df.withColumn("root_of_tree", root).withColumn("is_root", F.col("level") == 0)


def with_tree_shape(df: DataFrame) -> DataFrame:
    """size_of_tree and height_of_tree by a window over the tree, without a join."""
    tree = Window.partitionBy("article", "root_of_tree")
    return df.withColumn("size_of_tree", F.count("*").over(tree)).withColumn("height_of_tree", F.max("level").over(tree))


def with_parents(df: DataFrame) -> DataFrame:
    """direct_root_id: the nearest earlier comment one level up; "" for roots, null if there is none.

    As-of lookup in linear time: every comment stands once as a possible parent,
    at its level, and once as a question, one level up; in each level the last
    parent before a question is its answer.
    """
    keep = df.columns
    both = F.array(F.struct(F.col("level").alias("at"), F.lit(0).alias("asks")), F.struct((F.col("level") - 1).alias("at"), F.lit(1).alias("asks")))
    events = df.withColumn("_e", F.explode(both)).select(*keep, "_e.at", "_e.asks")
    earlier = Window.partitionBy("article", "at").orderBy("order", "asks").rowsBetween(Window.unboundedPreceding, -1)
    answer = F.last(F.when(F.col("asks") == 0, F.col("comment_id")), ignorenulls=True).over(earlier)
    found = events.withColumn("_parent", answer).filter("asks = 1")
    return found.withColumn("direct_root_id", F.when(F.col("level") == 0, F.lit("")).otherwise(F.col("_parent"))).select(*keep, "direct_root_id")


def deduplicated(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per article and key: the pinned copy if there is one, else the first; deleted rows (blank key) go."""
    copies = Window.partitionBy("article", key).orderBy(F.col("pinned").desc(), F.col("order"))
    return df.filter(F.col(key) != "").withColumn("_n", F.row_number().over(copies)).filter("_n = 1").drop("_n")


def with_replies(df: DataFrame) -> DataFrame:
    """all_replies: a root's comments in its tree but itself; 0 for all others."""
    counts = df.groupBy("article", F.col("root_of_tree").alias("comment_id")).agg((F.count("*") - 1).alias("_replies"))
    return df.join(counts, ["article", "comment_id"], "left").withColumn("all_replies", F.coalesce("_replies", F.lit(0))).drop("_replies")


def largest_step(df: DataFrame) -> DataFrame:
    """Comments whose level is more than one below the comment before them."""
    before = F.lag("level").over(Window.partitionBy("article").orderBy("order"))
    return df.withColumn("jump", F.col("level") - F.coalesce(before, F.lit(-1))).filter("jump > 1")
