import pytest

#: Texts that are hard on splitters: white space of all kinds, no words, ties, other scripts, special strings.
HARD = [
    "", " ", "  ", "\n", "a", " a", "a ", " a b ", "a  b", "a\nb", "a \n b", "a\n\n b\tc", "word word x", "　x 　 y", "x\x1cy z\x1f q", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>c",
    "▁a b▁ c", "<s> x </s>", "don't we'll I'm 's", "1234 56 ٣٤", "日本語 テキスト です", "\U0001f600 \U0001f468‍\U0001f469 x", "é é ñ", "a" * 5000, "ab " * 3000, "!?" * 500, "\x00 nul", "ſecret K Ａ",
]


@pytest.fixture(scope="session")
def hard():
    return HARD


@pytest.fixture(scope="session")
def documents(spark):
    """A small documents table: hard texts, nulls, repeated rows, columns with clashing names."""
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(HARD)]
    rows += [(1000, None, None, None, None), (1001, "tie text here", "en", "s0", 13), (1001, "tie text here", "en", "s0", 13), (1002, "same id other text", "de", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    # names that operators use inside
    return df.withColumns({c: F.lit(1) for c in ("size", "row", "spans", "shard", "fp", "rank", "words", "n_tokens", "component_id")}).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
