"""From raw documents to encoded training text, in five stages.

Each stage calls one operator of threadloom.llm on all rows that its
predecessor kept. Between stages rows are written as Parquet and read again. All
stages but the last return the columns of documents.

Every stage takes null ids, texts and sources, empty texts, texts of any length, rows that
share an id and equal rows, ignores further columns whatever their names, and gives
no rows of an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, mixing, rules, secrets, shared, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle.
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail any rule of the policy; null and empty texts have too few words."""
    return rules.ledger(docs, COLUMNS).filter(rules.passes(rules.STRICT)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; of rows that share it, one.

    Null and empty texts are one group; a row without an id stays only where its group has none with an id.
    """
    rows = secrets.numbered(docs, *COLUMNS)
    groups = simhash.deduplicate_similar(rows.select(F.col("row").alias("doc_id"), "text"), SHINGLE)
    # the group's smallest doc_id, and of equal ids the first row
    named = rows.select("row", "doc_id").join(groups.select(F.col("doc_id").alias("row"), "component_id"), "row")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "row")).alias("least")).select(F.col("least.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the value of every secret found by its kind; all documents stay, null texts as null."""
    rows = secrets.numbered(docs, *COLUMNS)
    found = secrets.find(rows).filter("size(spans) > 0")
    clean = secrets.redacted(rows.join(found, "row", "left").drop("row"))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row a copy; a null source is a source of its own, the last."""
    rows = secrets.numbered(docs, *COLUMNS)
    taken = mixing.mix(rows, row="row").filter("copies > 0").select("row", "copies")
    repeated = rows.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, with the digests that a reader can check them by; a null text is empty."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mixture),
    ("bpe_encoding", encoding),
]

#: SHA-256 digests of ids, XXH64 fingerprints and scans with spans aren't expressible in the oracle's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
