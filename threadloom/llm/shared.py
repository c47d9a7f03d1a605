"""What the operators of this subpackage share.

* a workspace in the folder that the cluster names in ``spark.checkpoint.dir``;
* Arrow batches re-cut by bytes, so that memory follows a byte budget and not
  a row count;
* a chunk coder: texts are cut at boundaries that no tokenizer merge crosses,
  equal parts are found per batch in Arrow, and each distinct part is encoded
  once and kept in a bounded memo, in Arrow too.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Bytes of text handled at once in a Python worker; one longer text goes alone.
BATCH_BYTES = 4 << 20
#: Bytes of an Arrow batch between an executor and its Python worker.
ARROW_BYTES = 8 << 20


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder that driver and executors share.

    Only where ``spark.checkpoint.dir`` is unset and the master is local (tests, a
    laptop) a temporary folder of this machine is set for the session; executors
    elsewhere would each write to their own disk, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to a shared folder and read it back.

    Cuts lineage as checkpoint() does, computes df once only, and survives
    lost executors.
    """
    spark = df.sparkSession
    path = workspace(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Removes what materialise wrote, once nothing reads it any more."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def renamed(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that any extra ones can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def release() -> None:
    """Gives free memory of Arrow and of the allocator back to the system, where they can."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(f, schema) in batches of at most about ARROW_BYTES.

    Spark's own limits, 10,000 rows and 64 MB, let a batch of long texts hold many
    times what its rows need in the executor and in the worker; the session's limit
    is lowered for all that follows. Workers give free memory back at their end.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return df.mapInArrow(run, schema)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches re-cut so that each holds about limit bytes of a text column.

    After each of them, memory that its work has freed goes back to the system:
    a worker beside others shall not hold the most that it ever needed.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
            release()


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


class Known:
    """Distinct strings by number, held in Arrow and bounded in number and in each one's bytes."""

    def __init__(self, most: int = 500_000, longest: int = 64):
        self.most, self.longest = most, longest
        self.keys = pa.array([], pa.string())

    def find(self, strings: pa.Array) -> np.ndarray:
        """Each string's number, or -1."""
        if not len(self.keys):
            return np.full(len(strings), -1, np.int64)
        return pc.fill_null(pc.index_in(strings, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, strings: pa.Array) -> np.ndarray:
        """Of new strings, the places of those that got the next numbers: the first short ones, as far as there is room."""
        short = np.flatnonzero(pc.binary_length(strings).to_numpy(zero_copy_only=False) <= self.longest)
        some = short[: max(0, self.most - len(self.keys))]
        if len(some):
            self.keys = pa.concat_arrays([self.keys, strings.take(pa.array(some))])
        return some

    def stale(self, found: np.ndarray) -> bool:
        """Whether most strings of a call are new although a good part of the room is taken."""
        return len(self.keys) >= self.most // 2 and 4 * np.count_nonzero(found < 0) > 3 * len(found)

    def clear(self) -> None:
        self.keys = self.keys[:0]


class Memo:
    """Encoded parts by text: ids in one pool, bounded in entries and ids.

    encode gives the ids of many parts, one after another, and each one's
    number. Once full, the memo keeps what it has, since common parts come
    early, and holds further ones for one call only; it is emptied when most
    of a call's parts are new to it. A part encodes alike every time, so
    results do not depend on what the memo holds.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], entries: int = 500_000, ids: int = 4 << 20):
        self.encode, self.ids, self.known = encode, ids, Known(entries)
        self.clear()

    @property
    def entries(self) -> int:
        return self.known.most

    @entries.setter
    def entries(self, most: int) -> None:
        self.known.most = most

    def clear(self) -> None:
        self.known.clear()
        self.pool, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each part's ids start and how many they are."""
        at = self.known.find(parts)
        if self.known.stale(at):
            self.clear()
            at = np.full(len(parts), -1, np.int64)
        missing = np.flatnonzero(at < 0)
        starts, lengths = self.ends[at], self.ends[at + 1] - self.ends[at]
        if not len(missing):
            return self.pool, starts, lengths
        new = parts.take(pa.array(missing))
        ids, counts = self.encode(new)
        own = np.cumsum(counts) - counts
        pool = np.concatenate([self.pool, ids])
        starts[missing], lengths[missing] = own + len(self.pool), counts
        if len(self.pool) < self.ids:
            kept = self.known.add(new)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts[kept])])
            self.pool = np.concatenate([self.pool, ids[spread(own[kept], counts[kept])]])
        return pool, starts, lengths


class Chunks:
    """Texts cut at single spaces that stand between two characters of other kinds.

    blank: the characters (as the inside of a regex class) that must not touch
    such a space. A part is what stands between two cuts; all parts but a
    text's first had a space before them.
    """

    def __init__(self, blank: str):
        self.edge = re.compile(f"[{blank}]")
        self.cut = re.compile(f"(?<=[^{blank}]) (?=[^{blank}])")

    def blank_edges(self, parts: pa.Array) -> np.ndarray:
        """Which parts are empty, or begin or end with a blank."""
        first, last = pc.utf8_slice_codeunits(parts, 0, 1), pc.utf8_slice_codeunits(parts, -1)
        blank = [c for c in {*first.unique().to_pylist(), *last.unique().to_pylist()} if not c or self.edge.match(c)]
        if not blank:
            return np.zeros(len(parts), bool)
        blank = pa.array(blank, parts.type)
        return pc.or_(pc.is_in(first, value_set=blank), pc.is_in(last, value_set=blank)).to_numpy(zero_copy_only=False)

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Parts (a part may stand twice), each text's parts as indices into them, and each text's count."""
        split = pc.split_pattern(texts, pattern=" ")
        counts = np.diff(split.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        codes, parts = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        unsafe = self.blank_edges(parts)
        if not unsafe.any():
            return parts, codes, counts
        begins = np.cumsum(counts) - counts
        odd = np.logical_or.reduceat(unsafe[codes], begins) & (counts > 1)
        if not odd.any():
            return parts, codes, counts
        cut = [self.cut.split(t) for t in texts.take(pa.array(np.flatnonzero(odd))).to_pylist()]
        others = pa.array([p for x in cut for p in x], pa.string()).dictionary_encode()
        every = counts.copy()
        every[odd] = [len(x) for x in cut]
        to = np.cumsum(every) - every
        out = np.empty(int(every.sum()), np.int64)
        out[spread(to[~odd], every[~odd])] = codes[spread(begins[~odd], counts[~odd])]
        out[spread(to[odd], every[odd])] = others.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(parts)
        return pa.concat_arrays([parts, others.dictionary]), out, every


#: Characters of all kinds that may stand at both sides of a space.
PROBES = "aZé日ñµ1٣²'’\"!?.,;:-_/()[]{}<>|#$%&*+=~^@\\`▁…€\u0301\u200d😀ſs"


def divisible(encode: Callable[[list[str]], list[list[int]]]) -> bool:
    """Whether texts of all pairs of PROBES with a space between encode as their two parts alone."""
    whole = encode([f"{a} {b}{b}" for a in PROBES for b in PROBES])
    first, last = encode(list(PROBES)), encode([f" {b}{b}" for b in PROBES])
    return whole == [a + b for a in first for b in last]


class Coder:
    """ids of whole texts, by parts.

    encode: the ids of many strings, each after a given lead, and each one's
    number. spaced: whether a part's own space belongs to it for the tokenizer.
    Where texts aren't divisible at spaces, they are encoded whole.
    """

    def __init__(self, encode: Callable[[pa.Array, str], tuple[np.ndarray, np.ndarray]], blank: str = r"\s", spaced: bool = True, divisible: bool = True):
        self.encode, self.chunks, self.spaced, self.divisible = encode, Chunks(blank), spaced, divisible
        self.memo = Memo(lambda parts: encode(parts, " " if spaced else ""))
        self.heads = Memo(lambda parts: encode(parts, ""), 50_000, 1 << 20) if spaced else self.memo

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and each text's number of ids."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.divisible:
            return self.encode(texts, "")
        parts, codes, counts = self.chunks(texts)
        firsts = np.cumsum(counts) - counts
        pool, starts, lengths = self.memo(parts)
        starts, lengths = starts[codes], lengths[codes]
        if self.spaced:
            heads = parts.take(pa.array(codes[firsts])).dictionary_encode()
            own, at, n = self.heads(heads.dictionary)
            which = heads.indices.to_numpy(zero_copy_only=False)
            starts[firsts], lengths[firsts] = at[which] + len(pool), n[which]
            pool = np.concatenate([pool, own])
        return pool[spread(starts, lengths)], np.add.reduceat(lengths, firsts)


def whole_texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A text column as strings, null as the empty text."""
    texts = batch.column(column)
    return pc.fill_null(texts, "")
