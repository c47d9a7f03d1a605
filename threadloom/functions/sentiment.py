"""Sentiment classes and probabilities from an injectable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A scorer takes texts and gives (positive, negative, neutral) probabilities of each.
Scorer = Callable[[list[str]], list[tuple[float, float, float]]]

#: A few German and English words of either kind, for the scorer that needs no model.
POSITIVE = "gut super toll danke schön richtig good great thanks right".split()
NEGATIVE = "schlecht falsch leider dumm schlimm nein bad wrong sad stupid".split()


def lexicon(texts: list[str]) -> list[tuple[float, float, float]]:
    """Probabilities from counts of listed words, each class one up front."""
    out = []
    for t in texts:
        words = t.lower().split()
        p, n = (1 + sum(w.strip(".,!?") in kind for w in words) for kind in (POSITIVE, NEGATIVE))
        total = p + n + 1
        out.append((p / total, n / total, 1 / total))
    return out


def with_sentiment(df: DataFrame, c: str = "text", make: Callable[[], Scorer] = lambda: lexicon, batch: int = 100) -> DataFrame:
    """sentiment_prob_pos, _neg, _neu, _class (the most likely) and _class_c (0, 1, 2).

    make is called once a worker and stream of batches, to load a model; the
    scorer gets batch texts at once, null as empty.
    """

    @F.pandas_udf("struct<pos: double, neg: double, neu: double>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for texts in parts:
            rows = []
            values = texts.fillna("").tolist()
            for at in range(0, len(values), batch):
                rows += scorer(values[at : at + batch])
            yield pd.DataFrame(rows, columns=["pos", "neg", "neu"])

    out = df.withColumn("_s", score(c)).withColumns({f"sentiment_prob_{k}": F.col(f"_s.{k}") for k in ("pos", "neg", "neu")}).drop("_s")
    return out.withColumns(classes())


def classes() -> dict[str, Column]:
    p, n, u = (F.col(f"sentiment_prob_{k}") for k in ("pos", "neg", "neu"))
    name = F.when((p >= n) & (p >= u), "positive").when(n >= u, "negative").otherwise("neutral")
    return {"sentiment_class": name, "sentiment_class_c": F.when(name == "negative", 0).when(name == "neutral", 1).when(name == "positive", 2), "sentiment_compound": p - n + 1}
