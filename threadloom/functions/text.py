"""Text measures as column expressions; all stay inside code generation.

Sentences and syllables follow documented rules of our own: a sentence ends at
[.!?]+ before white space or the end, and a text with any word has at least one;
a syllable is a run of vowels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: German vowels as a regex class, and function words that carry no topic.
VOWELS = "aeiouyäöü"
STOP_WORDS = ("aber als am an auch auf aus bei bin bis da das dass dem den der des die du durch ein eine einem einen einer es für hat ich im in ist ja kann mit nach nicht noch nur ob oder so sie sind um und von vor war was wenn wer wie wir zu zum zur").split()


def joined(*parts: str) -> Column:
    """Columns joined by one space, null as empty: heading and text, or title, subtitle and text."""
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def punctuation(c: str) -> Column:
    """Number of Unicode punctuation characters, symbols not among them."""
    return F.regexp_count(c, F.lit(r"\p{P}")).cast("long")


def space_words(c: str) -> Column:
    """The parts between single spaces: empty ones count but for one at the end; none of the empty text."""
    parts = F.split(c, " ", -1)
    return F.when(F.length(c) == 0, F.slice(parts, 1, 0)).when(F.col(c).endswith(" "), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def words(c: str) -> Column:
    return F.size(space_words(c)).cast("long")


def unique_words(c: str) -> Column:
    return F.size(F.array_distinct(space_words(c))).cast("long")


def sentences(c: str) -> Column:
    found = F.regexp_count(c, F.lit(r"[.!?]+(\s|$)"))
    return F.when(F.col(c).rlike(r"\S"), F.greatest(found, F.lit(1))).otherwise(0).cast("long")


def characters(c: str) -> Column:
    return F.char_length(c).cast("long")


def second_person(c: str) -> Column:
    """Whether the reader is addressed: Du, du or the capital Sie as a word of its own."""
    return F.col(c).rlike(r"(^|[^\p{L}\p{N}_])(Du|Sie|du)([^\p{L}\p{N}_]|$)")


def tokens(c: str | Column, stop: list[str] | None = None, stemmer=None) -> Column:
    """Lower-case runs of letters without stop words; stemmer: a column function on each token."""
    stop = STOP_WORDS if stop is None else stop
    # stop words go in the same pass of the pattern: testing each token against a list is interpreted
    by_first = {w[0]: sorted(x[1:] for x in stop if x[0] == w[0]) for w in stop}
    listed = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_first.items())
    skipped = rf"(?<!\p{{L}})(?!(?:{listed})(?!\p{{L}}))" if stop else ""
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"{skipped}\p{{L}}+"), F.lit(0))
    return F.transform(found, stemmer) if stemmer else found


def cttr(token_array: Column) -> Column:
    """Corrected type-token ratio: types / sqrt(2 * tokens); 0 for fewer than two tokens."""

    def ratio(t: Column) -> Column:
        return F.when(F.size(t) < 2, F.lit(0.0)).otherwise(F.size(F.array_distinct(t)) / F.sqrt(2.0 * F.size(t)))

    # a list of one, so that the tokens are found once and not once a use
    return F.transform(F.array(token_array), ratio)[0]


def polysyllables(c: str) -> Column:
    """Words of three or more runs of vowels, in one pass that never goes back."""
    vowels, others = f"[{VOWELS}]++", rf"[\p{{L}}&&[^{VOWELS}]]"
    return F.regexp_count(F.lower(c), F.lit(rf"(?<!\p{{L}}){others}*+{vowels}{others}++{vowels}{others}++{vowels}\p{{L}}*+")).cast("long")


def smog(c: str) -> Column:
    """German SMOG: sqrt(30 * polysyllables / sentences) - 2; -2 without sentences."""
    return F.coalesce(F.sqrt(30.0 * polysyllables(c) / F.nullif(sentences(c), F.lit(0))) - 2, F.lit(-2.0))


def with_features(df: DataFrame, c: str = "text") -> DataFrame:
    """All text features of a comment; ratios are null without sentences."""
    out = df.withColumns({"num_punct": punctuation(c), "num_words": words(c), "num_words_unique": unique_words(c), "num_sentences": sentences(c), "num_char": characters(c), "second_person": second_person(c), "smog": smog(c), "cttr": cttr(tokens(c))})
    by = F.nullif(F.col("num_sentences"), F.lit(0))
    return out.withColumns({"char_to_sent": F.col("num_char") / by, "word_to_sent": F.col("num_words") / by})


def cosine_to_first(df: DataFrame, least: int = 2, stop: list[str] | None = None, stemmer=None) -> DataFrame:
    """(article, comment_id, cosine): tf-idf cosine of each comment with its article's text.

    df: article, comment_id, text, is_article. Terms with fewer than least
    occurrences in an article's texts go; weights are tf * log10(documents /
    documents with the term); 0 where either side has no weight. stop: words left
    out, by default none. Terms are counted once. What is joined to them is a row
    per term of an article, which holds the article's own count too, so that a
    term of a hot article is split as any skewed side of a join.
    """
    terms = df.select("article", "comment_id", "is_article", F.explode(tokens("text", stop or [], stemmer)).alias("term")).groupBy("article", "comment_id", "is_article", "term").agg(F.count("*").alias("tf"))
    own = F.sum(F.when(F.col("is_article"), F.col("tf")).otherwise(0))
    corpus = terms.groupBy("article", "term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"), own.alias("tf_article")).filter(F.col("total") >= least)
    sizes = df.groupBy("article").agg(F.count("*").alias("n"))
    idf = corpus.join(sizes, "article").select("article", "term", "tf_article", F.log10(F.col("n") / F.col("df")).alias("idf"))
    w, w_article = F.col("tf") * F.col("idf"), F.col("tf_article") * F.col("idf")
    sums = terms.join(idf, ["article", "term"]).groupBy("article", "comment_id", "is_article").agg(F.sqrt(F.sum(w * w)).alias("norm"), F.sum(w * w_article).alias("dot"))
    lengths = sums.filter("is_article").select("article", F.col("norm").alias("norm_article"))
    every = df.filter("not is_article").select("article", "comment_id")
    found = every.join(sums.filter("not is_article").drop("is_article"), ["article", "comment_id"], "left").join(lengths, "article", "left")
    return found.select("article", "comment_id", F.coalesce(F.col("dot") / F.nullif(F.col("norm") * F.col("norm_article"), F.lit(0.0)), F.lit(0.0)).alias("cosine"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def three_decimals(x: Column) -> Column:
    """A number with three decimals, rounded by its exact binary value, ties to even; "-" for null and NaN.

    Java rounds the shortest decimal spelling half up instead: 2.0625 is 2.062 here and 2.063 there. Thousandths
    of the fraction are a product and its error, from a fraction cut at 26 bits.
    """
    size = F.abs(x)
    whole = F.floor(size)
    part = size - whole
    high = F.floor(part * 2**26) / 2**26
    product = part * 1000
    error = (high * 1000 - product) + (part - high) * 1000
    below = F.floor(product)
    # what is left over a half: the difference is exact, and a tie of the product is decided by its error
    over = (product - below) - 0.5
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & (below % 2 == 1))))
    thousandths = below + up.cast("long")
    carried = whole + (thousandths == 1000).cast("long")
    sign = F.when(F.signum(x) < 0, F.lit("-")).when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    shown = F.concat(sign, carried.cast("string"), F.lit("."), F.lpad((thousandths % 1000).cast("string"), 3, "0"))
    return F.when(x.isNull() | F.isnan(x), F.lit("-")).when(size < 2**53, shown).otherwise(F.format_string("%.3f", x))
