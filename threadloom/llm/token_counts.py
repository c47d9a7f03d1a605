"""Token counts: lengths only, from batches balanced by bytes.

Texts are cut at single spaces that no piece of the vocabulary spans, so that a
text's count is the sum of its parts' counts however long it is. Whether a
vocabulary allows that is read off its pieces; where one does span such a
space, whole texts are encoded instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import Chunks, Known, by_bytes, divisible, in_arrow, renamed, whole_texts

#: SentencePiece's mark for a space.
MARK = "▁"
#: Distinct parts whose counts a worker remembers.
MEMO = 500_000
#: Parts that are counted by one call of a library.
CALL = 4096


class Counter:
    """Counts the tokens of texts by their parts. count: lengths of many strings."""

    def __init__(self, count: Callable[[list[str]], list[int]], blank: str, spaced: bool, divisible: bool = True):
        self.count, self.chunks, self.spaced, self.divisible = count, Chunks(blank), spaced, divisible
        self.memo, self.heads = (Lengths(lambda parts, lead=lead: count([lead + p for p in parts.to_pylist()]), most) for lead, most in ((" " if spaced else "", MEMO), ("", MEMO // 10)))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0, np.int64)
        if not self.divisible:
            return np.array(self.count(texts.to_pylist()), np.int64)
        parts, codes, counts = self.chunks(texts)
        firsts = np.cumsum(counts) - counts
        each = self.memo(parts)[codes]
        if self.spaced:
            heads = parts.take(pa.array(codes[firsts])).dictionary_encode()
            each[firsts] = self.heads(heads.dictionary)[heads.indices.to_numpy(zero_copy_only=False)]
        return np.add.reduceat(each, firsts)


class Lengths:
    """Counts of parts, remembered as long as there is room."""

    def __init__(self, count: Callable[[pa.Array], list[int]], most: int):
        self.count, self.known, self.kept = count, Known(most), np.zeros(0, np.int64)

    def __call__(self, parts: pa.Array) -> np.ndarray:
        at = self.known.find(parts)
        if self.known.stale(at):
            self.known.clear()
            self.kept, at = self.kept[:0], np.full(len(parts), -1, np.int64)
        out = np.append(self.kept, 0)[at]
        missing = np.flatnonzero(at < 0)
        for k in range(0, len(missing), CALL):
            some = missing[k : k + CALL]
            new = parts.take(pa.array(some))
            out[some] = self.count(new)
            self.kept = np.append(self.kept, out[some][self.known.add(new)])
        return out


def _sentencepiece(path: str) -> Counter:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    spans = any(MARK in p.lstrip(MARK) for p in pieces)
    # a part must encode as in its place: its space becomes the mark that the model puts first,
    # and the model leaves all other characters as they are
    probe = "a  b Ａ\tc \n"
    plain = model.decode(model.encode(probe)) == probe and model.encode("a b") == model.encode("a") + model.encode("b")

    def count(texts: list[str]) -> list[int]:
        return [len(x) for x in model.encode(texts, num_threads=1)]

    return Counter(count, f" {MARK}", spaced=False, divisible=plain and not spans)


def _tokenizers(path: str) -> Counter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    added = model.get_added_tokens_decoder().values()
    parted = divisible(lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]) and not any(t.lstrip or t.rstrip or " " in t.content for t in added)

    def count(texts: list[str]) -> list[int]:
        return [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    return Counter(count, r"\s", spaced=True, divisible=parted)


_KEPT: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a vocabulary file (.json or .model), one a worker process."""
    if path not in _KEPT:
        _KEPT[path] = _tokenizers(path) if path.endswith(".json") else _sentencepiece(path)
    return _KEPT[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text).

    A null text is empty and has no tokens. Rows are counted alone, so null or
    repeated ids and rows are as any other. Texts of any length are handled whole; columns other than those named are ignored, whatever their names.
    An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in by_bytes(batches, "text"):
            texts = whole_texts(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(tokens(texts))], ["doc_id", "n_bytes", "n_tokens"])

    rows = renamed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
