"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words: its weight's share of all words, at most
LIMIT times its own words, the excess shared again by weight. Target over size
is the copies that a document of the source is due on average. Its whole part is
given to every document. The rest is drawn: each document has an inclusion
chance, a fixed uniform number u of its own, and the rank
(u / (1 - u)) / (chance / (1 - chance)); documents are taken in ascending rank
as far as the words still due last, and never beyond.

A document longer than the words still due can't be drawn and is passed over; a
second and a third pass fill what the passes before left. So a source's words
miss its target by less than its shortest documents, as far as three passes get.

Ranks are cut without sorting a source in one place: words are summed by source
and rank bin, bins are cut by running sums, and only the one bin where a
source's words run out is ordered by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.shared import materialise, renamed

#: Weights of the sources in their order, again and again.
WEIGHTS = (5, 2, 1)
LIMIT, PASSES = 3, 3
#: Most sources whose table, some hundred bytes a row, is broadcast; more are joined by an exchange.
SMALL = 10_000
#: Bins of a source's ranks; the rows of one are ordered in one task.
BINS = 1 << 14


def words(text: Column) -> Column:
    """Number of words of a text, divided by ASCII white space; null: 0."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number inside (0, 1) that depends on key and seed only: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"-{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: list[tuple[str | None, int]], weights: tuple = WEIGHTS, limit: int = LIMIT) -> dict:
    """Target words by source. sizes: each source's words, in the order of the weights.

    Sources meet their limit in the order of limit * words / weight. What is
    left over those that do, by the weight of those that don't, is the scale;
    up to that quotient all is in whole numbers.
    """
    total = sum(n for _, n in sizes)
    weighted = [(s, weights[k % len(weights)], n) for k, (s, n) in enumerate(sizes)]
    weighted.sort(key=lambda x: limit * x[2] / x[1])
    left, weight = total, sum(w for _, w, _ in weighted)
    due: dict = {}
    for at, (s, w, n) in enumerate(weighted):
        if left * w <= limit * n * weight:  # neither this source nor a later one is above its limit
            due |= {s: w * (left / weight) for s, w, _ in weighted[at:]}
            break
        due[s] = float(limit * n)
        left, weight = left - limit * n, weight - w
    return due


def pareto_rank(u: Column, chance: Column) -> Column:
    """Random odds over inclusion odds; a chance of one ranks first."""
    return F.when(chance >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (chance / (1 - chance)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _cut(rows: DataFrame, due: DataFrame) -> DataFrame:
    """The rows that the words due to their source last for, in ascending rank.

    rows: rid, source_no, size, rank, part (a bin that ascends with the rank);
    due: source_no, due. Rows longer than what is due are passed over.
    """
    fits = rows.join(due, "source_no").filter("size <= due")
    bins = fits.groupBy("source_no", "part").agg(F.sum("size").alias("words"), F.max("due").alias("due"))
    up_to = Window.partitionBy("source_no").orderBy("part")
    bins = bins.withColumn("upto", F.sum("words").over(up_to)).withColumn("from", F.col("upto") - F.col("words"))
    state = bins.filter("from <= due").select("source_no", "part", "from", (F.col("upto") <= F.col("due")).alias("whole"))
    marked = fits.join(state, ["source_no", "part"])
    inside = Window.partitionBy("source_no", "part").orderBy("rank", "rid").rowsBetween(Window.unboundedPreceding, 0)
    partly = marked.filter("not whole").withColumn("sum", F.col("from") + F.sum("size").over(inside)).filter("sum <= due")
    return marked.filter("whole").select("rid", "source_no", "size").unionByName(partly.select("rid", "source_no", "size"))


def mix(docs: DataFrame, seed: int = 7, weights: tuple = WEIGHTS, limit: int = LIMIT, bias: str | None = None, row: str | None = None) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies, taken) for every row of docs.

    row: a column with a unique number of each row; by default the place in the
    scan. docs: doc_id, text, source and, if bias names it, a positive column by which
    a document's odds of inclusion are multiplied (null: 1). taken is copies *
    size. Sources are ordered by code point, null last; a null text has no
    words, and documents without words are taken as often as the whole part
    tells, and never drawn. Rows draw by doc_id, those without one by their
    text; rows of equal draw are ordered by their place in the table. Texts of any length are handled whole; columns other than those named are ignored, whatever their names.
    An empty table gives no rows.

    The driver holds one row per source (a named collection, not a document):
    its words, and the words still due. Each target depends on all of them.
    """
    spark = docs.sparkSession
    columns = ["doc_id", "text", "source"] + [c for c in (bias, row) if c]
    text = renamed(docs, *columns)
    number = F.col(f"`{row}`") if row else F.monotonically_increasing_id()
    factor = F.coalesce(F.col(f"`{bias}`").cast("double"), F.lit(1.0)) if bias else F.lit(1.0)
    salt = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text"), F.xxhash64("text")))
    rows = materialise(text.select(number.alias("row"), "doc_id", "source", words(F.col("text")).alias("size"), factor.alias("factor"), uniform(salt, seed).alias("u")), "mixing-sizes")
    sizes = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    sizes.sort(key=lambda x: (x[0] is None, x[0] or ""))
    due = targets(sizes, weights, limit)
    whole = {s: int(min(limit, due[s] / n)) if n else 0 for s, n in sizes}
    rest = {k: due[s] - whole[s] * n for k, (s, n) in enumerate(sizes)}
    plan = spark.createDataFrame([(k, s, n, due[s], whole[s], rest[k]) for k, (s, n) in enumerate(sizes)], "source_no int, name string, source_size long, target double, whole int, rest double")
    full = rows.join(_small(plan, len(sizes)), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # a document's chance: the words to draw, over the words that could be drawn
    could = {r[0]: r[1] for r in full.filter("size > 0 and size <= rest").groupBy("source_no").agg(F.sum("size")).collect()}
    chances = spark.createDataFrame([(k, min(1 - 1e-9, rest[k] / n)) for k, n in could.items()], "source_no int, chance double")
    odds = F.col("chance") / (1 - F.col("chance")) * F.col("factor")
    pool = full.filter("size > 0 and size <= rest").join(_small(chances, len(could)), "source_no").withColumn("rank", pareto_rank(F.col("u"), odds / (1 + odds)))
    # the bin ascends with the rank: rank / (1 + rank) is in [0, 1)
    pool = pool.select(F.struct("u", "doc_id", "row").alias("rid"), "row", "source_no", "size", "rank", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int").alias("part"))
    left, owed, drawn = pool, dict(rest), None
    for _ in range(PASSES):
        open_ = _small(spark.createDataFrame([(k, x) for k, x in owed.items() if x > 0], "source_no int, due double"), len(owed))
        got = materialise(_cut(left, open_).select(F.col("rid.row").alias("row"), "source_no", "size"), "mixing-drawn")
        for r in got.groupBy("source_no").agg(F.sum("size").alias("used")).collect():
            owed[r["source_no"]] -= r["used"]
        drawn = got if drawn is None else drawn.unionByName(got)
        left = left.join(got.select("row"), "row", "left_anti")
    out = full.join(drawn.select("row", F.lit(1).alias("one")), "row", "left")
    copies = (F.col("whole") + F.coalesce("one", F.lit(0))).cast("int")
    return out.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
