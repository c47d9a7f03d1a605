"""Each stage against a plain version of its decision, over all that the stage before kept."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from threadloom.llm import bpe, mixing, rules, secrets, shared, simhash

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def stages(spark):
    """Rows in and out of each stage."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = docs.limit(20).selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(None, "w " * 80, None, None, None), (7000, None, "en", "s", 0), (7001, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(copies).unionByName(odd)
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = shared.materialise(stage(spark, docs, sf), f"test-{name}")
        found[name] = (docs.collect(), out.collect(), out.columns)
        docs = out
    return found


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scan", "mixing", "bpe_encoding"]
    assert all(c == COLUMNS for n, (_, _, c) in stages.items() if n != "bpe_encoding")


def test_rules(stages, spark):
    before, after, _ = stages["quality_rules"]
    kept = {r.doc_id for r in rules.ledger(spark.createDataFrame(before)).filter(rules.passes(rules.STRICT)).collect()}
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if r.doc_id in kept)
    assert {7000, 7001, None}.isdisjoint(r.doc_id for r in after)


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["simhash_near_dedup"]
    hashes = [simhash.shingle_hashes((r.text or "").encode(), 5) for r in before]
    fps = [simhash.majority(h) for h in hashes]
    keys = [set(enumerate(simhash.samples(h, simhash.CLASSES, simhash.LEAST))) for h in hashes]
    root = list(range(len(before)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(before)):
        for j in range(i):
            if fps[i] == fps[j] or (fps[i] ^ fps[j]).bit_count() <= simhash.SIMILAR and keys[i] & keys[j]:
                root[find(i)] = find(j)
    groups = {}
    for k, r in enumerate(before):
        groups.setdefault(find(k), []).append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(min(g) for g in groups.values())
    assert len({r.text for r in after}) == len(after)


def test_groups_hang_together_by_exact_similarity(stages):
    """Against the Jaccard similarity of all pairs of texts."""
    before, after, _ = stages["simhash_near_dedup"]
    sets = [frozenset(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for r in before]
    root = list(range(len(before)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for k, r in enumerate(before):
        groups.setdefault(find(k), []).append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(min(g) for g in groups.values())


def test_secrets_are_gone(stages):
    before, after, _ = stages["secret_scan"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        spans = [s for s in secrets.scan(texts[r.doc_id]) if s[1] < len(secrets.BASE)]
        assert all(s[5] not in r.text for s in spans) and (spans or r.text == texts[r.doc_id] or "<" in r.text)
        assert r.n_chars == len(r.text)


def test_mixture_takes_whole_copies(stages, spark):
    before, after, _ = stages["mixing"]
    want = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before)).collect()}
    assert Counter(r.doc_id for r in after) == Counter({d: c for d, c in want.items() if c})


def test_encoding_round_trip(stages):
    before, after, _ = stages["bpe_encoding"]
    vocabulary, _ = bpe.coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = {r.doc_id: r.text for r in before}
    assert len(before) == len(after)
    for r in after:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.n_tokens and vocabulary.decode(ids).decode() == texts[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_odd_rows_pass_every_stage(spark):
    """Nulls in any column, empty and long texts, repeated rows and columns with names that operators use."""
    text = " ".join(f"word{k} and thing{k * 3}" for k in range(120))
    rows = [(1, text, "en", "s", 10), (1, text, "en", "s", 10), (None, text + " more", None, None, None), (2, None, None, "s", None), (3, "", "en", None, 0), (4, " ".join(f"longer{k}" for k in range(60_000)), "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.selectExpr("*", "1 as row", "2 as spans", "3 as node", "4 as keys", "5 as size", "6 as copies", "7 as fail_bits", "8 as component_id", "9 as _metadata")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, "").collect()
        if name == "quality_rules":
            assert sorted(r.doc_id or 0 for r in out) == [0, 1, 1, 4]
        elif name == "simhash_near_dedup":
            assert sorted(r.doc_id for r in out) == [1, 2, 4]
        elif name in ("secret_scan", "bpe_encoding"):
            assert len(out) == len(rows)
        else:
            assert out and {r.doc_id for r in out} <= {1, 2, 3, 4, None}
