"""Token ids as Simple-8b words in files.

Format. A folder ``ids`` of Parquet files, one per shard, shards and the blocks
in them in ascending document order. A row is a block: whole documents, about
BLOCK_IDS ids. Its columns: shard; block (its place in the shard); start (ids of
the shard before it); n_ids; words (little-endian 64-bit Simple-8b words);
escapes (64-bit ids that no selector holds); doc_ids and doc_ends (64-bit; each
document's id, and the ids of the block up to its end); null_ids (which doc_ids
are null, one byte each).

A word has a selector in its top 4 bits and then as many ids as the selector
tells, the first lowest. Selector 0 is an escape: one id, at the place in
escapes that the payload names. Every block starts a new word, so that blocks
decode alone, and all words of a block decode by selector in a few vector
operations. Parquet is only the container: its writer commits or drops a task's
file as a whole, on any file system that Spark reaches.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.shared import Coder, by_bytes, divisible, in_arrow, renamed, spread, whole_texts, workspace

#: Ids in a word and bits of each, by selector from 1 on.
LAYOUT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK_IDS = 1 << 16
#: Ids that are packed side by side from one starting point each.
LANE = 1 << 9
#: Bytes of text handled at once; the more, the more of its parts are equal.
TEXT_BYTES = 8 << 20
#: Parts that are encoded as lines of one text.
LINES = 500

BLOCKS = "shard long, block long, start long, n_ids long, words binary, escapes binary, doc_ids binary, doc_ends binary, null_ids binary"


def bit_widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 1 at least."""
    if len(ids) and ids.dtype == np.uint32:
        # whole numbers below 2^53 are exact as doubles, and frexp gives their bits
        return np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)
    low, high = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64), (ids >> np.uint64(32)).astype(np.float64)
    return np.maximum(np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]), 1).astype(np.uint8)


def _widest(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    """The larger of a[i] and b[i + by]; beyond the end a alone."""
    out = a.copy()
    if by < len(b):
        np.maximum(out[: len(b) - by], b[by:], out=out[: len(b) - by])
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Simple-8b words of ids (unsigned 32-bit or 64-bit) and the escaped ids.

    Ids are cut into lanes of LANE; in each step all lanes choose their next
    word's selector at once. A lane's last word may hold less than its selector
    counts: then a selector of a smaller count is taken.
    """
    ids = np.asarray(ids)
    ids = ids if ids.dtype == np.uint32 else ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    width = bit_widths(ids)
    room = LANE - np.arange(n, dtype=np.int64) % LANE
    room[n - n % LANE :] -= LANE - n % LANE
    room = np.minimum(room, 255).astype(np.uint8)
    # windows[k]: the widest of the 2**k ids from each place on; past the end nothing is wide
    windows = [width]
    while 2 << len(windows) - 1 <= LAYOUT[0][0]:
        windows.append(_widest(windows[-1], windows[-1], 1 << len(windows) - 1))
    choice = np.zeros(n, np.uint8)
    for s in range(len(LAYOUT), 0, -1):
        count, bits = LAYOUT[s - 1]
        k = count.bit_length() - 1
        choice[(_widest(windows[k], windows[k], count - (1 << k)) <= bits) & (room >= count)] = s
    step = np.array([1, *(c for c, _ in LAYOUT)], np.int64)
    place, taken = np.arange(0, n, LANE, dtype=np.int64), []
    stop = np.minimum(place + LANE, n)
    while len(place):
        taken.append(place)
        place = place + step[choice[place]]
        left = place < stop
        place, stop = place[left], stop[left]
    starts = np.sort(np.concatenate(taken))
    selectors = choice[starts]
    ids = ids.astype(np.uint64)
    words = selectors.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selectors):
        here = selectors == s
        if s == 0:
            words[here] |= np.arange(here.sum(), dtype=np.uint64)
            continue
        count, bits = LAYOUT[s - 1]
        own = starts[here]
        payload = np.zeros(len(own), np.uint64)
        for k in range(count):
            payload |= ids[own + k] << np.uint64(k * bits)
        words[here] |= payload
    return words, ids[starts[selectors == 0]]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of a block, by one vector operation per selector and place."""
    selectors = (words >> np.uint64(60)).astype(np.uint8)
    counts = np.array([1, *(c for c, _ in LAYOUT)], np.int64)[selectors]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    begins = ends - counts
    for s in np.unique(selectors):
        here = selectors == s
        payload, to = words[here] & np.uint64((1 << 60) - 1), begins[here]
        if s == 0:
            out[to] = escapes[payload.astype(np.int64)]
            continue
        count, bits = LAYOUT[s - 1]
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            out[to + k] = (payload >> np.uint64(k * bits)) & mask
    return out


def _blocks(coder: Callable[[], Coder], end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = coder(), TaskContext.get().partitionId()
        state = {"block": 0, "start": 0}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # of some documents: doc_ids, which are null, counts, ids

        def block() -> pa.RecordBatch:
            docs, null, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            words, escapes = pack(ids)
            row = [shard, state["block"], state["start"], len(ids), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(), docs.astype("<i8").tobytes(), np.cumsum(counts).astype("<i8").tobytes(), null.astype(np.uint8).tobytes()]
            state["block"] += 1
            state["start"] += len(ids)
            held.clear()
            kinds = [pa.int64()] * 4 + [pa.binary()] * 5
            names = ["shard", "block", "start", "n_ids", "words", "escapes", "doc_ids", "doc_ends", "null_ids"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        size = 0
        for batch in by_bytes(batches, "text", TEXT_BYTES):
            ids, counts = encode(whole_texts(batch, "text"))
            ids, counts = ended(ids, counts, end_id)
            docs = batch.column("doc_id")
            null, docs = docs.is_null().to_numpy(zero_copy_only=False), pc.fill_null(docs, 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(counts)
            at, done = 0, 0  # documents and ids of the batch that are in a block or held
            while at < len(docs):
                to = min(len(docs), int(np.searchsorted(ends, done + BLOCK_IDS - size)) + 1)
                held.append((docs[at:to], null[at:to], counts[at:to], ids[done : ends[to - 1]]))
                size += int(ends[to - 1]) - done
                at, done = to, int(ends[to - 1])
                if size >= BLOCK_IDS:
                    yield block()
                    size = 0
        if held:
            yield block()

    return run


def ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of documents with end_id after each, and each one's number with it."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def write_ids(docs: DataFrame, coder: Callable[[], Coder], path: str, end_id: int = 0) -> None:
    """Encode (doc_id, text) and write the ids in ascending doc_id order to path.

    coder: called in each Python worker, gives the chunk coder. One range
    exchange orders the texts; rows of equal doc_id are ordered by a hash of
    their text and may be split over tasks by it. Null ids come first, a null
    text is empty, equal rows are all written.
    """
    ordered = renamed(docs, "doc_id", "text").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    in_arrow(ordered, _blocks(coder, end_id), BLOCKS).write.option("compression", "zstd").parquet(f"{path}/ids")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8"))
            raw = memoryview(ids.astype("<u4").tobytes())
            ends = np.frombuffer(row["doc_ends"], "<i8")
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            doc_ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["null_ids"], np.uint8).astype(bool))
            crc = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.full(n, row["shard"], np.int64)), pa.array(begins + row["start"]), pa.array(ends - begins), pa.array(crc, pa.int64())], ["doc_id", "shard", "place", "n_tokens", "ids_crc32"])


def read_documents(spark, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    Blocks decode alone, in any task. Only the ids of each shard before it are
    carried from shard to shard, one row per file.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/ids")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = in_arrow(blocks, _documents, "doc_id long, shard long, place long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


class LibraryCoder:
    """Builds, in a worker, a chunk coder over a vocabulary file of the tokenizers library.

    Whether its pre-tokenizer starts a new piece at a space between two
    characters that aren't white space, as the byte-level one does, is probed;
    where it doesn't, whole texts are encoded. Built once a worker process and
    file, so that its memo serves all of its tasks.
    """

    kept: dict[str, Coder] = {}

    def __init__(self, path: str):
        self.path = path

    def __call__(self) -> Coder:
        if self.path not in self.kept:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.path)

            def ids(texts: list[str]) -> list[list[int]]:
                return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

            # where a line's end is always a token of its own, many parts go as lines of one text
            probe = ids(["a", " b", "c", "\n", "a\n b\nc"])
            end = probe[3][0] if len(probe[3]) == 1 else -1
            lines = end >= 0 and probe[4] == [*probe[0], end, *probe[1], end, *probe[2]]
            # an added token with a space at or in it could stand across a cut
            added = tokenizer.get_added_tokens_decoder().values()
            parted = divisible(ids) and not any(t.lstrip or t.rstrip or " " in t.content for t in added)

            def encode(parts: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
                alone = coder.chunks.blank_edges(parts) | pc.match_substring(parts, "\n").to_numpy(zero_copy_only=False) if lines and parted else np.ones(len(parts), bool)
                strings = parts.to_pylist()
                single = np.flatnonzero(alone).tolist()
                joined = [strings[k] for k in np.flatnonzero(~alone).tolist()] if single else strings
                found = ids([lead + f"\n{lead}".join(joined[at : at + LINES]) for at in range(0, len(joined), LINES)])
                flat = np.fromiter(chain.from_iterable(chain(x, (end,)) for x in found), np.uint32) if joined else np.zeros(0, np.uint32)
                ends = np.flatnonzero(flat == end)
                counts = np.diff(ends, prepend=-1) - 1
                flat = flat[flat != end]
                if not single:
                    return flat, counts
                others = ids([lead + strings[k] for k in single])
                every = np.zeros(len(strings), np.int64)
                every[~alone], every[alone] = counts, [len(x) for x in others]
                begins = np.cumsum(every) - every
                out = np.zeros(int(every.sum()), np.uint32)
                out[spread(begins[~alone], counts)] = flat
                out[spread(begins[alone], every[alone])] = np.fromiter(chain.from_iterable(others), np.uint32)
                return out, every

            coder = Coder(encode, divisible=parted)
            self.kept[self.path] = coder
        return self.kept[self.path]


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents' ids to the shared folder and give what the files say: doc_id, start, n_tokens, ids_crc32.

    A null text is empty and has the end id only; null ids come first; rows that share an id
    are each written, ordered by their texts. Texts of any length are handled whole; columns other than those named are ignored, whatever their names.
    An empty table gives no rows.
    """
    path = workspace(docs.sparkSession, "token-ids")
    write_ids(docs, LibraryCoder(vocabulary), path)
    return read_documents(docs.sparkSession, path)
