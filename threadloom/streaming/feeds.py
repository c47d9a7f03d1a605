"""Comments that arrive as a stream: what needs one comment, or one window of them, at a time.

Rankings need complete discussions and stay with batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text


def read_feed(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """A folder of Parquet files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def with_features(feed: DataFrame, column: str = "text") -> DataFrame:
    """The same text features as in batch: all are expressions of one row."""
    return text.with_features(feed, column)


def activity(feed: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Comments and votes of each article and time window; later rows than late are left out."""
    return feed.withWatermark("time", late).groupBy("article", F.window("time", window).alias("w")).agg(F.count("*").alias("comments"), F.sum("votes").alias("votes")).select("article", F.col("w.start").alias("start"), "comments", "votes")


def first_copies(feed: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each comment id that arrives within the watermark."""
    return feed.withWatermark("time", late).dropDuplicatesWithinWatermark(["comment_id"])
