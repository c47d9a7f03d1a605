"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over
the vocabulary finds all tokens in a piece in one pass; many pieces are passed at
once, parted by a character outside of Latin-1. What is kept is the longest token
from each position on. From the left the
longest token is taken that may stand after the one before it; a position from
which no token leads on is marked, and the token before it is replaced by the
next shorter one. Two tokens may be neighbours if merging their joint bytes
gives just these two; that is decided once for each pair and remembered. Each
position is marked once and each pair looked up, so a piece takes linear time
where repeated merging takes quadratic time, and the ids are those of merging.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import Coder, by_bytes, divisible, in_arrow, renamed, spread, whole_texts

#: Neighbour pairs that a worker remembers.
PAIRS = 300_000
#: Characters of pieces that the automaton passes at once, and what parts them.
PASS, PART = 1 << 18, "\u0100"
#: Above all ranks.
NEVER = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a file of base64 tokens and ranks, one a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Vocabulary:
    """Encodes and decodes byte strings by ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.pieces = regex.compile(pattern)
        self.pairs: dict[int, bool] = {}
        self.less: dict[int, int] = {}
        self.usable: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        #: By token: the tokens that its last, or first, bytes grow into as it is merged, from
        #: the single byte up, each with the rank at which it grows on (NEVER for the token).
        self.tails: dict[int, list[tuple[int, int]]] = {}
        self.heads: dict[int, list[tuple[int, int]]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: (len(x[0]), x[1])):
            if len(token) == 1:
                self.tails[rank] = self.heads[rank] = [(rank, NEVER)]
            else:
                halves = self._halves(token)
                # a token that merging its bytes doesn't give, or gives before its halves, can only be a whole piece
                if not halves or max(halves) >= rank or not (halves[0] in self.tails and halves[1] in self.heads):
                    if halves and max(halves) >= rank and min(map(len, map(self.bytes_of.get, halves))) > 1:
                        self.ordered = False
                    if not halves:
                        continue
                left, right = halves
                self.heads[rank] = [*self.heads[left][:-1], (left, rank), (rank, NEVER)]
                self.tails[rank] = [*self.tails[right][:-1], (right, rank), (rank, NEVER)]
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
            self.usable[token.decode("latin-1")] = rank
        self.automaton.make_automaton()
        self.size = {i: len(t) for t, i in ranks.items()}

    #: Whether every merge has a higher rank than the merges of its halves.
    ordered = True

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token's bytes joins, if merging gives it."""
        parts = self._merge([token[i : i + 1] for i in range(len(token))], 2)
        if len(parts) != 2:
            return None
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _merge(self, parts: list[bytes], least: int = 1) -> list[bytes]:
        while len(parts) > least:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NEVER))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def merged(self, piece: bytes, whole: bool = True) -> list[int]:
        """ids by merging the neighbours of lowest joint rank, again and again."""
        if whole and piece in self.ranks:
            return [self.ranks[piece]]
        return [self.ranks[p] for p in self._merge([piece[i : i + 1] for i in range(len(piece))])]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the joint bytes of two tokens merge to just these two."""
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            apart = self._apart if self.ordered else self._merge_apart
            known = self.pairs[left << 32 | right] = apart(left, right)
        return known

    def _merge_apart(self, left: int, right: int) -> bool:
        return self.merged(self.bytes_of[left] + self.bytes_of[right], whole=False) == [left, right]

    def _apart(self, left: int, right: int) -> bool:
        """Follows what stands at both sides of the joint while the two tokens grow.

        A merge over the joint comes first if its rank is below that of the
        left side's next merge and not above that of the right side's: of equal
        ranks the one farther left goes first.
        """
        tail, head = self.tails[left], self.heads[right]
        i = j = 0
        while True:
            (x, grows_x), (y, grows_y) = tail[i], head[j]
            joint = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
            if joint is not None and joint < grows_x and joint <= grows_y:
                return False
            if grows_x == grows_y == NEVER:
                return True
            if grows_x <= grows_y:
                i += 1
            else:
                j += 1

    def longest(self, text: str) -> list[int]:
        """The longest token from each place of a Latin-1 text on, by one pass of the automaton; -1: none."""
        found = [-1] * len(text)
        for end, (size, rank) in self.automaton.iter(text):  # ends ascend, so a place's last token is its longest
            found[end + 1 - size] = rank
        return found

    def shorter(self, token: int) -> int:
        """The next shorter token that a token begins with, or -1."""
        found = self.less.get(token)
        if found is None:
            text = self.bytes_of[token].decode("latin-1")
            found = self.less[token] = next((self.usable[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.usable), -1)
        return found

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each of some matches of the pattern."""
        found = [[] if not p else [r] if (r := self.ranks.get(p)) is not None else None for p in pieces]
        some, size = [], 0
        for k, ids in enumerate(found):
            if ids is None:
                some.append(k)
                size += len(pieces[k]) + 1
            if some and (size >= PASS or k == len(found) - 1):
                starts = self.longest(PART.join(pieces[i].decode("latin-1") for i in some))
                at = 0
                for i in some:
                    found[i] = self._walk(starts, at, len(pieces[i]))
                    at += len(pieces[i]) + 1
                some, size = [], 0
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        return self.encode_pieces([piece])[0]

    def _walk(self, starts: list[int], at: int, length: int) -> list[int]:
        """The ids of the piece at a place of a passed text; starts: as longest gives."""
        size, pairs, stop = self.size, self.pairs, at + length
        ids: list[int] = []
        dead: set[int] = set()
        last, token = -1, starts[at]
        while True:
            while token >= 0:
                end = at + size[token]
                if end not in dead:
                    fits = last < 0 or pairs.get(last << 32 | token)
                    if fits is None:
                        fits = self.neighbours(last, token)
                    if fits:
                        break
                token = self.shorter(token)
            if token >= 0:
                ids.append(token)
                if end == stop:
                    return ids
                at, last = end, token
                token = starts[at]
            else:  # no token leads on from here after the one before
                dead.add(at)
                token = ids.pop()
                at -= size[token]
                last = ids[-1] if ids else -1

    def encode(self, text: str) -> list[int]:
        """The ids of a text, each match of the pattern on its own."""
        return [i for ids in self.encode_pieces([p.encode() for p in self.pieces.findall(text)]) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_KEPT: dict[tuple[str, str], tuple[Vocabulary, Coder]] = {}


def coder(path: str, pattern: str) -> tuple[Vocabulary, Coder]:
    """The vocabulary of a rank file and a chunk coder over it, one a worker process.

    Whether the pattern starts a new match at a space between two characters
    that aren't white space is probed; where it doesn't, whole texts are encoded.
    """
    if (path, pattern) not in _KEPT:
        vocabulary = Vocabulary(load_ranks(path), pattern)
        matches = vocabulary.pieces.findall

        def encode(parts: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
            own = [matches(lead + p) for p in parts.to_pylist()]
            distinct = list(dict.fromkeys(chain.from_iterable(own)))
            ids = dict(zip(distinct, vocabulary.encode_pieces([p.encode() for p in distinct]), strict=True))
            flat, counts = array("I"), []
            for pieces in own:
                before = len(flat)
                for p in pieces:
                    flat.extend(ids[p])
                counts.append(len(flat) - before)
            return np.array(flat, np.uint32), np.array(counts, np.int64)

        _KEPT[path, pattern] = vocabulary, Coder(encode, divisible=divisible(lambda texts: [matches(t) for t in texts]))
    return _KEPT[path, pattern]


class Decoder:
    """Bytes of id sequences, gathered from one table of all tokens' bytes."""

    def __init__(self, vocabulary: Vocabulary):
        size = max(vocabulary.bytes_of) + 1
        tokens = [vocabulary.bytes_of.get(i, b"") for i in range(size)]
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.fromiter(map(len, tokens), np.int64, size)
        self.start = np.cumsum(self.length) - self.length

    def __call__(self, ids: np.ndarray) -> bytes:
        return self.table[spread(self.start[ids], self.length[ids])].tobytes()


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) for every row of docs (doc_id, text).

    ids are little-endian unsigned 32-bit integers; the bytes decoded from them
    are hashed. A null text is empty. Rows are encoded alone, so null or
    repeated ids and rows are as any other. Texts of any length are handled whole; columns other than those named are ignored, whatever their names.
    An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, encode = coder(path, pattern)
        decode = Decoder(vocabulary)
        for batch in by_bytes(batches, "text"):
            ids, counts = encode(whole_texts(batch, "text"))
            ends = np.cumsum(counts)
            raw, hashes, back = [], [], []
            for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
                own = ids[end - n : end]
                raw.append(own.astype("<u4").tobytes())
                hashes.append(hashlib.sha256(raw[-1]).hexdigest())
                back.append(hashlib.sha256(decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(hashes), pa.array(back), pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    rows = renamed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
