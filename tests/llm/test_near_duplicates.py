"""Fingerprints, trie join, components and embedding links against brute force."""

import random

import numpy as np
import pytest
import xxhash

from threadloom.llm import components, embeddings, simhash


def plain_fingerprint(text, width):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint(hard):
    for t in [*hard, "One two THREE four fiveÉ six", "x y z " * 40_000]:
        for width in (3, 5):
            assert simhash.fingerprint(t.encode(), width) == plain_fingerprint(t, width)


@pytest.mark.parametrize("budget", [0, 1, 2, 3, 6])
def test_trie_pairs(budget):
    r = np.random.default_rng(budget)
    keys = list(r.integers(0, 1 << 63, 120, dtype=np.uint64))
    for b in list(keys):
        for _ in range(6):
            k = int(b)
            for bit in r.integers(0, 64, r.integers(0, budget + 2)):
                k ^= 1 << int(bit)
            keys.append(np.uint64(k))
    keys = np.unique(np.array(keys, np.uint64))
    u, v = simhash.trie_pairs(keys, np.array([[0, len(keys), 0, len(keys)]]), 0, budget)
    got = {tuple(sorted(x)) for x in zip(u.tolist(), v.tolist(), strict=True)}
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= budget
    assert len(got) == len(u) and got == {(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a < b}


@pytest.mark.parametrize(("budget", "subtrie"), [(2, 50_000), (2, 20), (5, 30)])
def test_components_of_fingerprints(spark, budget, subtrie):
    """subtrie: also so small that subtries are divided."""
    r = random.Random(budget + subtrie)
    fps = {0, (1 << 64) - 1}
    for _ in range(30):
        base = r.getrandbits(64) & (0xFFFF if r.random() < 0.5 else (1 << 64) - 1)
        for _ in range(12):
            k = base
            for _ in range(r.randint(0, budget + 1)):
                k ^= 1 << r.randrange(64)
            fps.add(k)
    fps = sorted(fps)
    ids = {f: i * 7 % 1009 for i, f in enumerate(fps)}
    rows = [(f - (1 << 64) if f >> 63 else f, ids[f]) for f in fps]
    got = {r.fp: r.component for r in simhash.components(spark.createDataFrame(rows, "fp long, doc_id long"), budget, subtrie).collect()}
    links = [(ids[a], ids[b]) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= budget]
    want = reach(ids.values(), links)
    assert got == {s: want[i] for s, i in rows}


def test_deduplicate_documents(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    got = simhash.deduplicate(documents, 3).collect()
    assert len(got) == len(rows)
    fp = {}
    for r in rows:
        fp.setdefault(r.doc_id, set()).add(plain_fingerprint(r.text, 3))
    for r in got:
        assert r.fp % (1 << 64) in fp[r.doc_id]
    every = sorted({f for x in fp.values() for f in x})
    least = {f: min(d for d, x in fp.items() if f in x) for f in every}
    links = [(least[a], least[b]) for i, a in enumerate(every) for b in every[:i] if (a ^ b).bit_count() <= 2]
    want = reach(set(least.values()), links)
    assert {(r.doc_id, r.component_id) for r in got} == {(d, want[least[f]]) for d, x in fp.items() for f in x}


def test_null_ids_and_empty_table(spark, nothing):
    df = spark.createDataFrame([(None, ""), (5, ""), (3, None), (None, "only here with words")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.deduplicate(df, 3).collect()), key=str)
    assert got == sorted([(None, 3), (5, 3), (3, 3), (None, None)], key=str)
    assert simhash.deduplicate(nothing).count() == 0


def test_roots_of_a_long_chain_and_a_star(spark):
    r = random.Random(1)
    order = list(range(300))
    r.shuffle(order)
    links = list(zip(order, order[1:], strict=False)) + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000), (None, 3)]
    got = {x.node: x.root for x in components.roots(spark.createDataFrame(links, "u long, v long"), "test").collect()}
    want = reach(range(300), zip(order, order[1:], strict=False)) | {1000 + k: 1000 for k in range(200)}
    assert got == {n: w for n, w in want.items() if n != w}


def plain_links(rows, threshold):
    ok = {}
    for k, (_, e, label) in enumerate(rows):
        if e and label is not None and all(x is not None and np.isfinite(x) for x in e) and any(e):
            ok[k] = np.array(e, np.float64)
    out = []
    for i in ok:
        for j in ok:
            if j < i and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                a, b = ok[i], ok[j]
                if float(a @ b) / (np.sqrt(float(a @ a)) * np.sqrt(float(b @ b))) >= threshold:
                    out.append((i, j))
    return out


@pytest.mark.parametrize(("tile", "dims"), [(2048, 16), (16, 16), (7, 2)])
def test_embedding_links(spark, tile, dims):
    r = np.random.default_rng(tile)
    vectors = []
    for _ in range(25):
        base = r.normal(size=dims)
        for _ in range(6):
            vectors.append((base + r.normal(size=dims) * r.choice([0.0, 0.02, 0.05, 0.1])) * r.choice([0.5, 1, 3]))
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3) if i % 11 else None) for i, v in enumerate(vectors)]
    rows += [(500, None, 1), (501, [0.0] * dims, 1), (502, [float("nan")] * dims, 1), (503, [1.0, None] * (dims // 2), 1), (504, [], 1), (505, rows[0][1][: dims // 2], 0), (506, [float("inf")] + [0.0] * (dims - 1), 2)]
    rows += [(600 + k, rows[4][1], rows[4][2]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embeddings.near_duplicates(df, tile=tile).collect()}
    links = plain_links(rows, 0.98)
    ids = [x[0] for x in rows]
    root = reach(ids, [(ids[i], ids[j]) for i, j in links])
    count = dict.fromkeys(ids, 0)
    for i, j in links:
        count[ids[i]] += 1
        count[ids[j]] += 1
    assert got == {i: (count[i], root[i], root[i] == i) for i in ids}


def test_quantisation_bound():
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale, error = embeddings.quantised(x)
    about = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale[None, :]
    assert (np.abs(x @ x.T - about) <= error[:, None] + (1 + error)[:, None] * error[None, :]).all()
    assert np.abs(codes).max() <= 127 and (codes == np.rint(codes)).all()


def test_embeddings_repeated_ids_and_empty(spark):
    one, two = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(1, one, 0), (1, two, 0), (2, one, 0), (3, two, 0), (None, one, 0), (4, one, 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(((x.vec_id, x.n_links, x.component_id) for x in embeddings.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (None, 0, None), (4, 0, 4)], key=str)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_similar_documents(spark, nothing):
    """Copies with a few words changed are one group; texts that share a passage are not."""
    r = random.Random(8)

    def prose(n):
        return [f"w{r.randrange(5000)}" for _ in range(n)]

    rows, want = [], {}
    for g in range(40):
        words = prose(300)
        for k in range(5):
            copy = list(words)
            for _ in range(k):
                copy[r.randrange(300)] = "changed"
            rows.append((100 * g + k, " ".join(copy)))
            want[100 * g + k] = 100 * g
    passage = prose(60)
    for k in range(60):
        rows.append((10_000 + k, " ".join(prose(150) + passage)))
        want[10_000 + k] = 10_000 + k
    got = {x.doc_id: x.component_id for x in simhash.deduplicate_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[d] != c for d, c in want.items()) <= 2
    assert all(got[d] == d for d in want if d >= 10_000)
    assert simhash.deduplicate_similar(nothing).count() == 0
    some = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "x")], "doc_id long, text string")
    assert sorted(((x.doc_id, x.component_id) for x in simhash.deduplicate_similar(some).collect()), key=str) == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, 3)], key=str)


def test_a_large_group_of_near_fingerprints_is_walked_in_bounded_pieces():
    """All within the budget of each other: most node pairs are done before they are compared."""
    r = np.random.default_rng(3)
    keys = np.unique(np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (6000, 6)).astype(np.uint64), axis=1))
    forest = simhash.Forest(keys)
    compared = 0
    for u, v in simhash.trie_walk(keys, np.array([[0, len(keys), 0, len(keys)]]), 0, 12, forest.done):
        compared += len(u)
        assert len(u) <= simhash.CHUNK * simhash.LEAF_PAIRS
        forest.link(u, v)
    assert (forest.root == 0).all() and compared < len(keys) ** 2 / 10


def jaccard(a, b):
    a, b = (set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def altered(words, r, low, high):
    """A copy whose similarity to words is in [low, high): single words are changed until it is."""
    copy = list(words)
    while jaccard(" ".join(words), " ".join(copy)) >= high:
        copy[r.randrange(len(copy))] = f"new{r.randrange(10**9)}"
    return copy if jaccard(" ".join(words), " ".join(copy)) >= low else altered(words, r, low, high)


def test_similar_links_are_verified(spark):
    """Pairs below a similarity of 0.8 stay apart, also where their fingerprints are close; chains join only by links of 0.8."""
    r = random.Random(21)
    rows = []
    for g in range(150):
        words = [f"w{r.randrange(50_000)}" for _ in range(400)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(altered(words, r, 0.7, 0.79)))]
    chain = [f"w{r.randrange(50_000)}" for _ in range(400)]
    for k in range(5):
        rows.append((5000 + k, " ".join(chain)))
        chain = altered(chain, r, 0.88, 0.93)
    found = simhash.deduplicate_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {x.doc_id: x.component_id for x in found}
    assert all(got[d] == d for d, _ in rows if d < 5000)
    assert {got[5000 + k] for k in range(5)} == {5000}


def test_pairs_near_the_least_similarity_are_found(spark):
    """Near copies with one partner only, at 0.80 to 0.85."""
    r = random.Random(22)
    rows = []
    for g in range(300):
        words = [f"w{r.randrange(50_000)}" for _ in range(400)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(altered(words, r, 0.8, 0.85)))]
    got = {x.doc_id: x.component_id for x in simhash.deduplicate_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[10 * g + 1] != 10 * g for g in range(300)) <= 6
    assert all(got[10 * g] == 10 * g for g in range(300))


def test_a_vec_id_of_several_labels_counts_the_links_of_each_row(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 1), (4, [0.0, 1.001], 1), (5, [1.0, 0.0], 1)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 as gid", "2 as raw", "3 as root")
        got = sorted(tuple(r) for r in embeddings.near_duplicates(df).collect())
        assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True)]
