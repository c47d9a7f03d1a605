"""Secret scan with corpus-wide ownership frequency.

One pass finds spans in each whole text: the base kinds by their patterns, and
candidates of further kinds. Every value is hashed. The hashes are counted over
the corpus by the distinct owners, and by the distinct repositories, that hold
them; counts are made per (hash, owner) before any hash is brought together, so
that a value copied a million times is a few rows. A value that more than a few
owners hold, or that stands in more repositories than one owner's use of it
explains, is an example that people copy; one that stays with its owner and
looks random is live-looking. Where the corpus has no finer columns, a document is
the repository and its source the owner. Base spans are always reported, with that verdict;
candidates become spans only if live-looking, whatever their pattern.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import by_bytes, in_arrow, materialise, renamed, whole_texts

#: The base kinds in their order, their patterns, the group that is the value, and its least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    # of all runs of hex digits, those of 24 or more are what remains
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: Candidate kinds: they are spans only where the corpus says that the value is live-looking.
MORE = (
    ("key_block", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+"), 0, 64),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 30),
    ("prefixed", re.compile(r"\b(?:gh[pousr]_|xox[abprs]-|sk_live_|rk_live_|AIza|glpat-)[A-Za-z0-9_-]+"), 0, 20),
    ("userinfo", re.compile(r"://[^\s/:@]++:([^\s/:@]++)@"), 1, 6),
)
KINDS = tuple(k for k, *_ in BASE + MORE)
#: Most distinct owners, and distinct repositories, of a value that is still live-looking.
OWNERS, REPOSITORIES = 2, 25
#: Least bits a character of a live-looking value, and words that mark made-up ones.
ENTROPY, MADE_UP = 2.5, re.compile(r"example|sample|dummy|placeholder|changeme|your_|xxxx|0{8}|1234567", re.IGNORECASE)


def entropy(value: str) -> float:
    """Bits a character, by the value's own character counts."""
    counts, n = Counter(value).values(), len(value)
    return -sum(c / n * math.log2(c / n) for c in counts) if n else 0.0


def looks_random(value: str) -> bool:
    return entropy(value) >= ENTROPY and not MADE_UP.search(value)


def scan(text: str) -> list[tuple[int, int, int, int, int, str]]:
    """(start, kind, end, value's start, value's end, value) of all base spans and candidates.

    Leftmost and not overlapping within a kind; a match whose value is too
    short is dropped after it has taken its place. Ordered by start, then kind.
    """
    found = []
    for k, (_, pattern, group, least) in enumerate(BASE + MORE):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end(), m.start(group), m.end(group), m[group]))
    found.sort(key=lambda x: x[:2])
    return found


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


SPAN = "struct<kind: int, start: int, end: int, value_start: int, value_end: int, value: bigint, random: boolean>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("value_end", pa.int32()), ("value", pa.int64()), ("random", pa.bool_())])


def _scanned(keep: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["row", "repository", "owner", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            rows = [[{"kind": k, "start": a, "end": b, "value_start": c, "value_end": d, "value": _hash(v), "random": looks_random(v)} for a, k, b, c, d, v in scan(t)] for t in whole_texts(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, pa.list_(_SPAN))], [*names, "spans"])

    return run


def ownership(spans: DataFrame) -> DataFrame:
    """(value, owners, repositories) of spans (value, owner, repository): distinct ones, null as one of them."""
    pairs = spans.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    owned = pairs.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    # a repository belongs to one owner: its name is looked at within the owner
    return owned.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def find(docs: DataFrame, owner: str = "source", repository: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, the columns of keep, spans) for every row of docs (row: unique; text; the owner and repository columns).

    spans: ordered by start, then kind; each has kind (a place in KINDS), start
    and end in code points, the value's start and end, owners, repositories
    and live. A null text is empty. A null owner or repository counts as one. An
    empty table gives no rows.
    """
    rows = docs.select("row", "text", F.col(f"`{repository}`").cast("string").alias("repository"), F.col(f"`{owner}`").cast("string").alias("owner"), *[F.col(f"`{c}`") for c in keep])
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    found = materialise(in_arrow(rows, _scanned(keep), ", ".join([f"row {docs.schema['row'].dataType.simpleString()}, repository string, owner string", *kept, f"spans array<{SPAN}>"])), "secret-spans")
    each = found.filter("size(spans) > 0").select("row", "owner", "repository", F.explode("spans").alias("s")).select("row", "owner", "repository", "s.*")
    counts = ownership(each)
    judged = each.join(counts, "value").withColumn("live", F.col("random") & (F.col("owners") <= OWNERS) & (F.col("repositories") <= REPOSITORIES))
    kept = judged.filter((F.col("kind") < len(BASE)) | F.col("live"))
    lists = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "value_start", "value_end", "owners", "repositories", "live"))).alias("spans"))
    empty = F.array().cast("array<struct<start: int, kind: int, end: int, value_start: int, value_end: int, owners: bigint, repositories: bigint, live: boolean>>")
    return found.select("row", *keep).join(lists, "row", "left").select("row", *keep, F.coalesce("spans", empty).alias("spans"))


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns with a unique key row, the same in every later scan.

    A row of a Parquet table is known by its file and its place in it, however
    the scan is split. Rows of other plans are written with a number once, as
    numbers that follow the split change with the number of executors.
    """
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in docs.columns
    names = [F.col(f"`{c}`") for c in columns]
    if plain:
        try:
            return docs.select(*names, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("row"))
        except AnalysisException:  # files of another format
            pass
    return materialise(docs.select(*names, F.monotonically_increasing_id().alias("row")), "numbered-rows")


def redacted(texts: DataFrame) -> DataFrame:
    """texts (any columns, text, spans): text with every span's value replaced by its kind.

    Values that overlap are replaced as one, by the kind of the first.
    """
    schema = texts.drop("spans").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if text and spans:
                    parts, at = [], 0
                    for s in sorted(spans, key=lambda s: (s["value_start"], s["kind"])):
                        if s["value_start"] >= at:
                            parts += [text[at : s["value_start"]], f"<{KINDS[s['kind']]}>"]
                        at = max(at, s["value_end"])
                    text = "".join([*parts, text[at:]])
                out.append(text)
            names = [f.name for f in schema]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return in_arrow(texts, run, schema)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_<base kind>, base_sha256, spans, n_live) for every row of docs.

    A null text is empty; null or repeated ids and rows are reported each. Texts of any length are handled whole; columns other than those named are ignored, whatever their names.
    An empty table gives no rows.
    """
    rows = renamed(docs, "doc_id", "text", "source").withColumn("row", F.monotonically_increasing_id())
    found = find(rows, keep=("doc_id",))  # the one scan gives the numbers

    def name(s):
        kind = F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
        return F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))

    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def of_kind(k: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{n}") for k, (n, *_) in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, name), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))
