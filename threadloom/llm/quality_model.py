"""A quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of the whole text stand for a document. Cosines of random
projections of them approximate a Gaussian kernel. Each partition of the
training rows sums its own normal equations; these are added in groups, and the
driver gets a few of them and solves for the ridge weights. Scores of a fold that
the ridge fit did not see are counted in fixed bins, and pool-adjacent-violators
over the bins calibrates all scores to 0..1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.sums import partition_sum
from threadloom.llm.shared import by_bytes, in_arrow, materialise, renamed, whole_texts

#: Random cosines, the kernel's width over the root of the statistics' number, and the ridge penalty.
COSINES, WIDTH, PENALTY = 256, 1.0, 1e-2
#: Least partitions that sum normal equations, and labelled rows of one where there are more.
PARTS, ROWS = 16, 20_000
#: Bins of ridge scores for the calibration, over LOW..HIGH.
BINS, LOW, HIGH = 1000, -0.5, 1.5
STATS = 22


def statistics(text: str) -> np.ndarray:
    """STATS numbers about a whole text; of an empty text all but the first are finite constants too."""
    raw = text.encode("utf-8", "replace")
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(1, len(raw))
    words = text.split()
    low = [w.lower() for w in words]
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    windows = max(1, len(words) - 2)
    return np.array([
        np.log1p(len(words)),
        sum(map(len, words)) / n / 10,
        share[65:91].sum(),
        share[97:123].sum(),
        share[48:58].sum(),
        share[33],
        share[[35, 36, 37, 38, 42]].sum(),
        share[124],
        share[[44, 46]].sum(),
        share[10],
        share[[40, 41, 59, 60, 61, 62, 123, 125]].sum(),
        share[128:].sum(),
        share[[47, 58, 64]].sum(),
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        sum(w[0].isupper() for w in words) / n,
        sum(w[-1] in ".!?" for w in words) / n,
        len(set(low)) / n,
        1 - len(set(zip(low, low[1:], low[2:], strict=False))) / windows,
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
    ], np.float64)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        found = [statistics(t).astype("<f4").tobytes() for t in whole_texts(batch, "text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "stats"])


def _matrix(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<f4").reshape(-1, STATS).astype(np.float64)


@dataclass
class Model:
    """All that scores a document; a few hundred kB."""

    centre: np.ndarray
    spread: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.centre) / self.spread, -6, 6)
        waves = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.projection + self.phase)
        return np.hstack([waves, z / 10, np.ones((len(z), 1))])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        raw = self.ridge(stats)
        return np.clip(raw if self.knots is None else np.interp(raw, self.knots, self.values), 0.0, 1.0)


def _moments(batch: pa.RecordBatch) -> np.ndarray:
    x = _matrix(batch.column("stats"))
    return np.concatenate([np.full(STATS, len(x)), x.sum(axis=0), (x * x).sum(axis=0)])


def _equations(model: Model) -> Callable[[pa.RecordBatch], np.ndarray]:
    def step(batch: pa.RecordBatch) -> np.ndarray:
        label = np.asarray(batch.column("label").to_numpy(zero_copy_only=False), np.float64)
        x = np.hstack([model.features(_matrix(batch.column("stats"))), label[:, None]])
        return (x.T @ x).ravel()

    return step


def _binned(model: Model) -> Callable[[pa.RecordBatch], np.ndarray]:
    def step(batch: pa.RecordBatch) -> np.ndarray:
        raw = model.ridge(_matrix(batch.column("stats")))
        at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, batch.column("label").to_numpy(zero_copy_only=False), minlength=BINS)])

    return step


def isotonic(n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the calibration: pool-adjacent-violators over score bins.

    A block's knot is its mean score; half a case of either class keeps its
    value off 0 and 1, and values between knots are interpolated.
    """
    middle = LOW + (np.arange(BINS) + 0.5) / BINS * (HIGH - LOW)
    blocks: list[list[float]] = []
    for m, k, one in zip(middle, n, ones, strict=True):
        if not k:
            continue
        blocks.append([k, one, k * m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    knots = np.array([s / k for k, _, s in blocks])
    values = np.maximum.accumulate(np.array([(one + 0.5) / (k + 1) for k, one, _ in blocks]))
    return knots, values


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(rows: DataFrame, seed: int = 11) -> Model:
    """rows: doc_id, stats, label (0 or 1), calibrate (boolean: the fold for the calibration).

    Without rows all scores are 0.5; without a calibration fold that holds both
    labels the ridge scores are only clipped. Rows are dealt by a hash of their id
    and ordered before they are summed, so that reruns add in the same order.
    """
    rows = materialise(rows, "quality-training")
    parts = max(PARTS, -(-rows.count() // ROWS))

    def dealt(wanted: str) -> DataFrame:
        return rows.filter(wanted).repartition(parts, "doc_id").sortWithinPartitions("doc_id", "stats", "label").select("stats", "label")

    n, first, second = partition_sum(dealt("not calibrate"), _moments, 3 * STATS, parts).reshape(3, STATS)
    count = max(1.0, n[0])
    centre = first / count
    random = np.random.default_rng(seed)
    model = Model(centre, np.sqrt(np.maximum(0, second / count - centre**2)) + 1e-4, random.normal(size=(STATS, COSINES)) * WIDTH / np.sqrt(STATS), random.uniform(0, 2 * np.pi, COSINES))
    if not n[0]:
        return model
    size = COSINES + STATS + 2
    sums = partition_sum(dealt("not calibrate"), _equations(model), size * size, parts).reshape(size, size)
    gram, right = sums[:-1, :-1], sums[:-1, -1]
    model.weights = np.linalg.solve(gram + PENALTY * np.eye(size - 1), right)
    total, ones = partition_sum(dealt("calibrate"), _binned(model), 2 * BINS, parts).reshape(2, BINS)
    if 0 < ones.sum() < total.sum():
        model.knots, model.values = isotonic(total, ones)
    return model


def _scored(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(_matrix(batch.column("stats"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: int = 0, calibrate: int = 1, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    labels: doc_id and the label column; other values than 0 and 1 are left
    out. Rows of fold held_out are never learnt from, those of fold calibrate
    only calibrate. Null and empty texts are scored by their statistics, texts of any length by all of theirs; a null
    id is in no fold, so not held out, and has no label. Rows of docs that share an id are scored and learnt from each on
    its own; repeated labels count as often as they stand, null ones not at all. Columns other than those named are
    ignored, whatever their names. An empty table gives no rows.
    """
    rows = renamed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = materialise(in_arrow(rows, _measured, "doc_id long, stats binary"), "quality-statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("label")).filter(f"label in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 5 <> {held_out}")
    training = stats.join(known, "doc_id").select("doc_id", "stats", "label", (fold(F.col("doc_id")) == calibrate).alias("calibrate"))
    model = fit(training)
    scored = in_arrow(stats, _scored(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
