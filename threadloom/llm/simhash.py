"""Near duplicates by SimHash fingerprints, linked by a binary trie self-join.

Two fingerprints within BUDGET differing bits agree wholly on one of BUDGET + 1
blocks of bits. The trie is therefore kept in BUDGET + 1 bit orders, each with
another block on top. In each order only node pairs with no difference in the
top block are followed, so the subtries under that block are independent: they
are dealt out by (order, block), and every task traverses its node pairs
together, adds up differing bits, and drops a pair once it has spent the budget.

A subtrie of more than SUBTRIE fingerprints is divided further: pairs of its
next nodes whose prefixes differ in at most BUDGET bits become tasks of their
own, so that no task's work grows with the most common block, and no link is
lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.components import local_roots, roots
from threadloom.llm.shared import by_bytes, in_arrow, materialise, renamed

BITS, BUDGET, SEED = 64, 2, 42
#: Bits that texts of a similarity of 0.8 differ in at most, but for one pair in thousands, and the shingle samples that find them:
#: classes of hashes, and the least hashes of each that must agree.
SIMILAR, CLASSES, LEAST = 20, 10, 4
#: Least Jaccard similarity of the shingles of two linked texts.
SIMILARITY = 0.8
#: Fingerprints of a subtrie beyond which its node pairs become tasks of their own.
SUBTRIE = 50_000
#: Fingerprints of whole subtries that a task traverses at once.
FOREST = 200_000
#: Bytes of shingles that a task holds at once, beside those of its largest tree.
FOREST_BYTES = 8 << 20
#: Node pairs of at most so many fingerprint pairs are compared at once.
LEAF_PAIRS = 32
#: Candidate pairs after which those that hang together by now are left out, and node pairs of theirs that go down together.
VERIFIED = 2048
#: Words, as a power of two, of the map that tells which nodes' shingles are wanted.
MAP_WORDS = 18
#: Node pairs that go down together.
CHUNK = 1 << 15
#: Shingles whose bits are summed at once.
SUM_ROWS = 1 << 15


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of a text's word shingles, each as often as it occurs.

    Only A-Z are lower-cased and only ASCII white space divides words: that is
    what bytes.lower and bytes.split do. Fewer than width words are one
    shingle; without words there is none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, max(1, len(words) - width + 1))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SUM_ROWS):
        some = hashes[at : at + SUM_ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int) -> int:
    """The SimHash of a text."""
    return majority(shingle_hashes(text, width))


def samples(hashes: np.ndarray, classes: int, least: int) -> list[int | None]:
    """A key for each class of hashes: what its least distinct ones, up to least of them, hash to.

    A class without hashes has no key: else all short texts would share one.

    A hash's class is its remainder, so the same shingle is in the same class in
    every text; texts of Jaccard similarity s share a key with a chance of about
    s ** least in each class.
    """
    distinct = np.unique(hashes)
    of = (distinct % np.uint64(classes)).astype(np.int64)
    some = [distinct[of == k][:least] for k in range(classes)]
    return [xxhash.xxh64_intdigest(s.tobytes(), k) >> 1 if len(s) else None for k, s in enumerate(some)]


def _fingerprints(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            found = np.fromiter((fingerprint(t or b"", width) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long; a null text is empty."""
    rows = renamed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return in_arrow(rows, _fingerprints(width), "doc_id long, fp long")


def _node(distinct: np.ndarray) -> int:
    """What stands for a text's set of shingles: texts of equal sets are one node."""
    return xxhash.xxh64_intdigest(distinct.tobytes(), SEED)


def _sampled(width: int, classes: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            fps, nodes, keys = [], [], []
            for t in batch.column("text").to_pylist():
                distinct = np.unique(shingle_hashes(t or b"", width))
                fps.append(majority(distinct))
                nodes.append(_node(distinct))
                keys.append(samples(distinct, classes, least))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, nodes)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fp", "node", "keys"])

    return run


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text's node and its distinct shingles, as the low halves of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            nodes, sets = [], []
            for t in batch.column("text").to_pylist():
                distinct = np.unique(shingle_hashes(t or b"", width))
                nodes.append(_node(distinct))
                sets.append(np.unique(distinct.astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_walk(keys: np.ndarray, pairs: np.ndarray, depth: int, budget: int, done: Callable | None = None, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys within budget differing bits, by a paired trie traversal.

    keys: unsigned 64-bit, ascending in each node. pairs: rows (alo, ahi, blo,
    bhi) of node pairs as ranges of keys, a node with itself having equal
    ranges. depth: the top bits that all keys of a node share. Many node pairs
    go down one bit at once, at most chunk of them, the deepest first; so what is
    held follows the depth and not the pairs. Those of few keys are compared.
    done(alo, ahi, blo, bhi) tells which node pairs can bring nothing new.
    """
    counts: dict[int, np.ndarray] = {}
    same = (pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] == pairs[:, 3])
    work = [(depth, *(np.ascontiguousarray(pairs[:, k]) for k in range(4)), np.zeros(len(pairs), np.int64), same)]
    while work:
        depth, *columns = work.pop()
        if len(columns[0]) > chunk:
            work += [(depth, *(x[at : at + chunk] for x in columns)) for at in range(0, len(columns[0]), chunk)]
            continue
        if done is not None:
            new = ~done(*columns[:4])
            columns = [x[new] for x in columns]
        alo, ahi, blo, bhi, spent, same = columns
        size_a, size_b = ahi - alo, bhi - blo
        leaf = (size_a * size_b <= LEAF_PAIRS) | (depth >= BITS)
        if leaf.any():
            a0, b0, nb = alo[leaf], blo[leaf], size_b[leaf]
            each = size_a[leaf] * nb
            which = np.repeat(np.arange(len(each)), each)
            k = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
            u, v = a0[which] + k // nb[which], b0[which] + k % nb[which]
            near = (_popcount(keys[u] ^ keys[v]) <= budget) & (u != v) & (~same[leaf][which] | (u < v))
            if near.any():
                yield u[near], v[near]
            alo, ahi, blo, bhi, spent, same = (x[~leaf] for x in (alo, ahi, blo, bhi, spent, same))
        if not len(alo):
            continue
        if depth not in counts:
            counts[depth] = np.concatenate([[0], np.cumsum((keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1))]).astype(np.int32)
        ones = counts[depth]
        am, bm = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        across = ~same
        steps = [(alo, am, blo, bm, spent, same), (am, ahi, bm, bhi, spent, same), (alo, am, bm, bhi, spent + 1, np.zeros_like(same))]
        steps.append(tuple(x[across] for x in (am, ahi, blo, bm, spent + 1, same)))
        alo, ahi, blo, bhi, spent, same = (np.concatenate(x) for x in zip(*steps, strict=True))
        keep = (alo < ahi) & (blo < bhi) & (spent <= budget) & ~(same & (ahi - alo < 2))
        if keep.any():
            work.append((depth + 1, *(x[keep] for x in (alo, ahi, blo, bhi, spent, same))))


def trie_pairs(keys: np.ndarray, pairs: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of trie_walk."""
    found = list(trie_walk(keys, pairs, depth, budget))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(u for u, _ in found)]), np.concatenate([none, *(v for _, v in found)])


class Forest:
    """Which keys of a task hang together so far; a fingerprint may stand in several trees."""

    def __init__(self, original: np.ndarray):
        self.nodes, self.index = np.unique(original.view(np.int64), return_inverse=True)
        self.root = np.arange(len(self.nodes))
        self._seen()

    def _seen(self) -> None:
        own = self.root[self.index]
        self.changes = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
        self.own = own

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        u, v = self.index[u], self.index[v]
        apart = self.root[u] != self.root[v]
        if apart.any():
            self.root = local_roots(len(self.nodes), u[apart], v[apart], self.root)
            self._seen()

    def done(self, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> np.ndarray:
        """Node pairs whose keys are all of one component already."""
        c = self.changes
        return (c[ahi - 1] == c[alo]) & (c[bhi - 1] == c[blo]) & (self.own[alo] == self.own[blo])

    def moved(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.nodes[at], self.nodes[self.root[at]]


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(offset, length) of each of budget + 1 blocks of the 64 bits."""
    cuts = [BITS * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _turned(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _traverse(budget: int, blocks: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows (turn, block, a, b, side, key) sorted by them: forests of whole tasks at a time.

    blocks: for each turn, by how much its keys are rotated, and how many top
    bits the keys of a task share.
    """

    def links(turn: np.ndarray, block: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray, side: np.ndarray) -> pa.RecordBatch | None:
        # one forest: node ranges are runs of equal (turn, block, a, b, side)
        change = np.flatnonzero((np.diff(turn) != 0) | (np.diff(block) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(side) != 0)) + 1
        lo = np.concatenate([[0], change])
        hi = np.concatenate([change, [len(key)]])
        own = a[lo] == b[lo]
        selfs = np.stack([lo, hi, lo, hi], 1)[own & (hi - lo > 1)]
        partner = np.flatnonzero(~own[:-1] & (side[lo[:-1]] == 0) & (side[lo[1:]] == 1) & (turn[lo[:-1]] == turn[lo[1:]]) & (block[lo[:-1]] == block[lo[1:]]) & (a[lo[:-1]] == a[lo[1:]]) & (b[lo[:-1]] == b[lo[1:]]))
        crosses = np.stack([lo[partner], hi[partner], lo[partner + 1], hi[partner + 1]], 1)
        offsets = np.array([o for o, _ in blocks], np.uint64)[turn]
        forest = Forest((key >> offsets) | np.where(offsets > 0, key << ((np.uint64(BITS) - offsets) % np.uint64(BITS)), np.uint64(0)))
        # neighbours first: of a group of near copies most node pairs are done with that
        inside = np.ones(max(0, len(key) - 1), bool)
        inside[change - 1] = False
        near = np.flatnonzero(inside & (_popcount(key[1:] ^ key[:-1]) <= budget))
        forest.link(near, near + 1)
        for k, (_, shared) in enumerate(blocks):
            for pairs, depth in ((selfs, shared), (crosses, 0)):  # nodes with other prefixes are followed from the root on
                for u, v in trie_walk(key, pairs[turn[pairs[:, 0]] == k], depth, budget, forest.done):
                    forest.link(u, v)
        u, v = forest.moved()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"]) if len(u) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("turn", "block", "a", "b", "key", "side")]
            held.append(columns)
            rows += batch.num_rows
            if rows < FOREST:
                continue
            turn, block, a, b, key, side = (np.concatenate(x) for x in zip(*held, strict=True))
            ends = np.flatnonzero((np.diff(turn) != 0) | (np.diff(block) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0))
            if not len(ends):
                held = [[turn, block, a, b, key, side]]
                continue
            to = ends[-1] + 1
            out = links(turn[:to], block[:to], a[:to], b[:to], key[:to].view(np.uint64), side[:to])
            held, rows = [[x[to:] for x in (turn, block, a, b, key, side)]], len(turn) - to
            if out is not None:
                yield out
        if rows:
            turn, block, a, b, key, side = (np.concatenate(x) for x in zip(*held, strict=True))
            out = links(turn, block, a, b, key.view(np.uint64), side)
            if out is not None:
                yield out

    return run


def links(fps: DataFrame, budget: int = BUDGET, subtrie: int = SUBTRIE) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints within budget bits of each other.

    fps: (fp long), distinct. Of the links that a task finds in a forest, only
    as many leave it as connect the same fingerprints.
    """
    turns = F.array(*[F.struct(F.lit(k).alias("turn"), _turned(F.col("fp"), o).alias("key"), F.shiftrightunsigned(_turned(F.col("fp"), o), BITS - n).alias("block"), F.lit(n).alias("length")) for k, (o, n) in enumerate(_blocks(budget))])
    rows = fps.select(F.explode(turns).alias("t")).select("t.*")
    sizes = rows.groupBy("turn", "block").agg(F.count("*").alias("size")).filter(F.col("size") > subtrie)
    # bits to divide a large subtrie by: a subtrie's share of its size, with some to spare
    bits = F.least(F.lit(12), F.ceil(F.log2(F.col("size") / subtrie)).cast("int") + 2)
    marked = rows.join(sizes, ["turn", "block"], "left").withColumn("bits", F.when(F.col("size").isNotNull(), bits).otherwise(0))
    prefix = F.expr("shiftrightunsigned(shiftleft(key, length), 64 - bits)")
    masks = F.expr(f"filter(sequence(0L, shiftleft(1L, bits) - 1), m -> bit_count(m) <= {budget})")
    own = F.when(F.col("bits") == 0, F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("side")))).otherwise(
        F.transform(masks, lambda m: F.struct(F.least(F.col("prefix"), F.col("prefix").bitwiseXOR(m)).alias("a"), F.greatest(F.col("prefix"), F.col("prefix").bitwiseXOR(m)).alias("b"), F.when(F.col("prefix") <= F.col("prefix").bitwiseXOR(m), 0).otherwise(1).alias("side")))
    )
    dealt = marked.withColumn("prefix", F.when(F.col("bits") > 0, prefix).otherwise(0)).select("turn", "block", "key", F.explode(own).alias("o")).select("turn", "block", "o.a", "o.b", "o.side", "key")
    # signed order with the top bit turned over is unsigned order; inside a block only the bits below it count
    ordered = dealt.repartition("turn", "block", "a", "b").sortWithinPartitions("turn", "block", "a", "b", "side", F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
    return in_arrow(ordered, _traverse(budget, _blocks(budget)), "u long, v long")


class Verifier:
    """Links the candidates whose shingles are similar enough; sets: each key's, ascending."""

    def __init__(self, forest: Forest, sets: list[np.ndarray], similarity: float):
        self.forest, self.sets, self.similarity = forest, sets, similarity
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        for at in range(0, len(u), VERIFIED):
            self._link(u[at : at + VERIFIED], v[at : at + VERIFIED])

    def _link(self, u: np.ndarray, v: np.ndarray) -> None:
        own = self.forest.own
        less, more = np.minimum(self.sizes[u], self.sizes[v]), np.maximum(self.sizes[u], self.sizes[v])
        may = (own[u] != own[v]) & (less >= self.similarity * more) & (less > 0)
        u, v = u[may], v[may]
        if not len(u):
            return
        order = np.argsort(u, kind="stable")
        u, v = u[order], v[order]
        starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        similar = np.zeros(len(u), bool)
        for lo, hi in zip(starts, [*starts[1:], len(u)], strict=True):
            one, others = self.sets[u[lo]], v[lo:hi]
            every = np.concatenate([self.sets[k] for k in others])
            held = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
            sizes = self.sizes[others]
            shared = np.add.reduceat(held, np.cumsum(sizes) - sizes, dtype=np.int64)
            similar[lo:hi] = shared >= self.similarity * (len(one) + sizes - shared)
        self.forest.link(u[similar], v[similar])


def _verified(budget: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows (turn, block, key, node, shingles) sorted by turn, block and key: forests of whole trees at a time."""

    def links(rows: pa.Table) -> pa.RecordBatch | None:
        turn, block, key, node = (rows.column(c).to_numpy() for c in ("turn", "block", "key", "node"))
        key = key.view(np.uint64)
        change = np.flatnonzero((np.diff(turn) != 0) | (np.diff(block) != 0)) + 1
        lo, hi = np.concatenate([[0], change]), np.concatenate([change, [len(key)]])
        forest = Forest(node)
        # views into the batches
        verifier = Verifier(forest, [np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("shingles")], similarity)
        # neighbours first: of a group of near copies most node pairs are done with that
        inside = np.ones(max(0, len(key) - 1), bool)
        inside[change - 1] = False
        near = np.flatnonzero(inside & (_popcount(key[1:] ^ key[:-1]) <= budget))
        verifier.link(near, near + 1)
        for u, v in trie_walk(key, np.stack([lo, hi, lo, hi], 1)[hi - lo > 1], 0, budget, forest.done, VERIFIED):
            verifier.link(u, v)
        u, v = forest.moved()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"]) if len(u) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < FOREST_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            turn, block = rows.column("turn").to_numpy(), rows.column("block").to_numpy()
            ends = np.flatnonzero((np.diff(turn) != 0) | (np.diff(block) != 0))
            if not len(ends):
                continue
            to = int(ends[-1]) + 1
            out = links(rows.slice(0, to))
            rest = rows.slice(to)
            held, size = rest.to_batches(), rest.nbytes
            if out is not None:
                yield out
        if held:
            out = links(pa.Table.from_batches(held))
            if out is not None:
                yield out

    return run


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose node's bit is set in a map of the wanted nodes' bits, before anything is exchanged.

    The map has at most 2**MAP_WORDS rows of 64 bits, whatever wanted holds, so it
    can be broadcast. Some other rows pass too; the more are wanted, the more.
    """
    h = F.xxhash64("node", F.lit(2))
    word, bit = F.shiftrightunsigned(h, 64 - MAP_WORDS), F.expr("shiftleft(1L, cast(xxhash64(node, 2) & 63 as int))")
    bits = wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    keyed = rows.withColumn("word", word)
    return keyed.join(F.broadcast(bits), "word").filter(F.col("bits").bitwiseAND(bit) != 0).select(*rows.columns)


def similar_links(rows: DataFrame, texts: DataFrame, width: int, budget: int, similarity: float) -> DataFrame:
    """Links (u, v) that connect nodes within budget bits that share a sample key and are similar enough.

    rows: (fp, node, keys). texts: (text) of the same rows. For budgets that
    leave no block of useful width: the trees are dealt by (class, key) in place
    of a block, each a trie of whole fingerprints. What it finds are candidates;
    the similarity of their shingles decides. Near copies agree in most classes:
    of trees with the same nodes one is followed. The shingles are only held for
    nodes that share a key with another.
    """
    each = rows.select("fp", "node", F.posexplode("keys").alias("turn", "block")).select("turn", "block", "fp", "node").filter("block is not null").distinct()
    members = (F.bit_xor(F.xxhash64("node")).alias("m1"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).alias("m2"))
    crowded = each.groupBy("turn", "block").agg(F.count("*").alias("size"), *members).filter("size > 1")
    trees = crowded.groupBy("size", "m1", "m2").agg(F.min(F.struct("turn", "block")).alias("t")).select("t.*")
    dealt = materialise(each.join(trees, ["turn", "block"], "left_semi").select("turn", "block", "node", F.col("fp").alias("key")), "simhash-candidates")
    wanted = dealt.select("node").distinct()
    # an inner join: the optimiser would ask a semi join before the map
    sets = _marked(in_arrow(texts, _sets(width), "node long, shingles binary"), wanted).join(wanted, "node")
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    ordered = dealt.join(sets, "node").repartition("turn", "block").sortWithinPartitions("turn", "block", F.col("key").bitwiseXOR(F.lit(-(1 << 63)))).select("turn", "block", "key", "node", "shingles")
    return in_arrow(ordered, _verified(budget, similarity), "u long, v long")


def components(fps: DataFrame, budget: int = BUDGET, subtrie: int = SUBTRIE) -> DataFrame:
    """(fp, component) of distinct fps (fp long, doc_id long: a fingerprint's smallest).

    component: the smallest doc_id of all fingerprints reached by links.
    """
    return _components(fps, links(fps.select("fp"), budget, subtrie))


def _components(fps: DataFrame, found: DataFrame) -> DataFrame:
    """Only nodes with a link are grouped; a component's smallest doc_id is summed up before any exchange
    by root and written, and so is the result: joins back to members, and to rows, read two plain exchanges,
    of which a large component's or a much copied text's can be split."""
    moved = roots(found, "simhash-links").select(F.col("node").alias("fp"), "root")
    held = moved.unionByName(moved.select(F.col("root").alias("fp"), "root").distinct())
    least = materialise(held.join(fps, "fp").groupBy("root").agg(F.min("doc_id").alias("component")), "simhash-components")
    named = held.join(least, "root").select("fp", "component")
    return materialise(fps.join(named, "fp", "left").select("fp", F.coalesce("component", "doc_id").alias("component")), "simhash-members")


def deduplicate(docs: DataFrame, width: int = 5, budget: int = BUDGET, subtrie: int = SUBTRIE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text; more columns are ignored).

    Copies share a fingerprint and are counted as one in the join. Null and
    empty texts have fingerprint zero and link with each other; a null doc_id
    never names a component; rows that share an id are each kept. Texts of any length are handled whole; columns other than those named are ignored, whatever their names.
    An empty table gives no rows.
    """
    rows = materialise(fingerprints(docs, width), "simhash-fingerprints")
    each = rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    found = components(each, budget, subtrie).withColumnRenamed("component", "component_id")
    return rows.join(found, "fp", "left").select("doc_id", "fp", "component_id")


def deduplicate_similar(docs: DataFrame, width: int = 5, budget: int = SIMILAR, classes: int = CLASSES, least: int = LEAST, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: groups that hang together by links of at least similarity.

    doc_id may be of any type that has an order.

    fp is of the distinct shingles. Every link is decided by the Jaccard similarity of the two sets of
    shingles (32 bits of each one's hash). Fingerprints of similar texts differ
    in up to budget bits, more than blocks can divide by. So that only likely
    pairs are looked at, a link also needs a common sample of shingles: at a
    similarity of 0.8 one of the classes agrees in 99 cases of 100. Null and
    empty texts are one set.
    """
    rows = renamed(docs, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))
    sampled = materialise(in_arrow(rows, _sampled(width, classes, least), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, node long, keys array<long>"), "simhash-samples")
    each = sampled.groupBy("node").agg(F.min("doc_id").alias("doc_id")).select(F.col("node").alias("fp"), "doc_id")
    found = _components(each, similar_links(sampled, rows.select("text"), width, budget, similarity)).select(F.col("fp").alias("node"), F.col("component").alias("component_id"))
    return sampled.select("doc_id", "fp", "node").join(found, "node", "left").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
