"""Near duplicates among embeddings: int8 tile products with error bounds.

Equal vectors of a label are one row with a weight. Rows of a label are dealt
into tiles of about TILE, ordered by their projection on one direction; two
tiles whose ranges are farther apart than two linked vectors can be are never
paired. A task takes one pair of tiles: it quantises each unit vector x to
s*q + e with int8 q, multiplies the tiles' q, and bounds the error rigorously by
|e_x| + (1 + |e_x|) |e_y| from each vector's own measured |e|. Only pairs that
the bound leaves possible are recomputed in double precision.

What leaves a task is a count per vector and the fewest links that connect the
same vectors; so a group of n close vectors sends n rows, not n^2.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.components import local_roots, roots
from threadloom.llm.shared import in_arrow, materialise, renamed

TILE = 2048
#: int8 dot products of more dimensions than this don't stay exact in float32.
EXACT_DIMS = 1024
#: Possible pairs recomputed at once.
EXACT_PAIRS = 1 << 15


def _prepared(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row: digest and bytes (of numbers of a kind) of the vector, null where it links with nothing, and its projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, vectors = batch.num_rows, batch.column("embedding")
            values = pc.fill_null(vectors.values.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
            starts, lengths = vectors.offsets.to_numpy()[:-1].astype(np.int64), np.diff(vectors.offsets.to_numpy()).astype(np.int64)
            lengths[vectors.is_null().to_numpy(zero_copy_only=False)] = 0
            raws: list[bytes | None] = [None] * n
            shadows: list[float | None] = [None] * n
            for dims in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero(lengths == dims)
                x = values[starts[rows][:, None] + np.arange(dims)] + 0.0  # zeros have one sign
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                fine = np.isfinite(norm) & (norm > 0)
                x, rows = x[fine], rows[fine]
                shadow = x @ _direction(dims) / norm[fine]
                for k, row, place in zip(rows.tolist(), x.astype(kind), shadow.tolist(), strict=True):
                    raws[k], shadows[k] = row.tobytes(), place
            keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raws]
            dims = pa.array(lengths, pa.int32(), mask=np.array([r is None for r in raws], bool))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(raws, pa.binary()), dims, pa.array(shadows, pa.float64())], ["vec_id", "label", "key", "raw", "dims", "shadow"])

    return run


def _direction(dims: int) -> np.ndarray:
    """A unit direction that depends on the number of dimensions only."""
    x = np.cos(np.arange(1, dims + 1, dtype=np.float64) ** 2)
    return x / math.sqrt(float(x @ x))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (held as float32), scale and measured error norm of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1) + 1e-12
    return codes.astype(np.float32), scale, error


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, at : at + EXACT_DIMS] @ b[:, at : at + EXACT_DIMS].T
    return out


def linked(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with cosine of x[i] and y[j] >= threshold; y None: of x, i < j."""
    norm_x = np.sqrt(np.einsum("ij,ij->i", x, x))
    code_x, scale_x, error_x = quantised(x / norm_x[:, None])
    if y is None:
        z, norm_y, code_y, scale_y, error_y = x, norm_x, code_x, scale_x, error_x
    else:
        z, norm_y = y, np.sqrt(np.einsum("ij,ij->i", y, y))
        code_y, scale_y, error_y = quantised(y / norm_y[:, None])
    about = _product(code_x, code_y) * scale_x[:, None] * scale_y[None, :]
    bound = error_x[:, None] + (1 + error_x)[:, None] * error_y[None, :]
    possible = about + bound >= threshold - 1e-9
    if y is None:
        possible = np.triu(possible, 1)
    i, j = np.nonzero(possible)
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), EXACT_PAIRS):
        p, q = i[at : at + EXACT_PAIRS], j[at : at + EXACT_PAIRS]
        keep[at : at + EXACT_PAIRS] = np.einsum("ij,ij->i", x[p], z[q]) / (norm_x[p] * norm_y[q]) >= threshold
    return i[keep], j[keep]


def _pairs(threshold: float, kind: str) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        gid = group.column("gid").to_numpy()
        weight = group.column("weight").to_numpy()
        x = np.frombuffer(b"".join(group.column("raw").to_pylist()), kind).reshape(len(gid), -1).astype(np.float64)
        side = group.column("side").to_numpy()
        if group.column("i")[0].as_py() == group.column("j")[0].as_py():
            u, v = linked(x, None, threshold)
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                u = v = np.zeros(0, np.int64)
            else:
                u, v = linked(x[left], x[right], threshold)
                u, v = left[u], right[v]
        count = np.bincount(u, weight[v], len(gid)) + np.bincount(v, weight[u], len(gid))
        root = gid[local_roots(len(gid), u, v)]
        has = count > 0
        return pa.table({"gid": pa.array(gid[has]), "links": pa.array(count[has].astype(np.int64)), "root": pa.array(root[has])})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Rows link if labels are equal and not null and the cosine in double
    precision is at least threshold; vectors of other lengths never link.
    Vectors that are null, empty, zero or not finite link with nothing and are
    their own components. Equal vec_ids with other vectors, of one label or of several, are one node: the
    component joins their links, and each row has its own vector's number of links. Rows of null
    vec_id are neither linked nor counted. Vectors of any length are whole; columns other than the three are ignored,
    whatever their names. An empty table gives no rows.
    """
    rows = renamed(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    kind = "<f4" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = materialise(in_arrow(rows, _prepared(kind), f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, key binary, raw binary, dims int, shadow double"), "embedding-rows")
    group = ["label", "dims", "key"]
    valid = rows.filter("key is not null and label is not null and vec_id is not null")
    # equal vectors of a label are one group; the written number stands for it from here on
    groups = valid.groupBy(*group).agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.min("shadow").alias("shadow"))
    groups = materialise(groups.withColumn("gid", F.monotonically_increasing_id()), "embedding-groups")
    # one row carries each group's bytes
    full = valid.select(*group, F.col("vec_id").alias("least"), "raw").dropDuplicates([*group, "least"]).join(groups, [*group, "least"])
    sizes = groups.groupBy("label", "dims").agg(F.count("*").alias("n"))
    # tiles by a label's projection quantiles; each tile with the range that it covers
    spans = groups.join(sizes, ["label", "dims"]).withColumn("tiles", F.ceil(F.col("n") / tile))
    step = 1 << 14  # fine bins of the projection, of which runs make up tiles
    binned = spans.withColumn("bin", F.floor((F.col("shadow") + 1) / 2 * step).cast("int"))
    bins = binned.groupBy("label", "dims", "bin").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.min("shadow").alias("low"), F.max("shadow").alias("high"))
    before = Window.partitionBy("label", "dims").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))
    # rows of a bin larger than a tile are dealt on by a hash
    placed = bins.select("label", "dims", "bin", F.floor(F.col("start") / tile).alias("first"), F.greatest(F.lit(1), F.ceil(F.col("c") / tile)).alias("parts"), "low", "high")
    limits = materialise(placed.withColumn("tile", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1))).groupBy("label", "dims", "tile").agg(F.min("low").alias("low"), F.max("high").alias("high")), "embedding-tiles")
    gap = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    a = limits.select("label", "dims", F.col("tile").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"))
    b = limits.select("label", "dims", F.col("tile").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    pairs = a.join(b, ["label", "dims"]).filter(f"i <= j and low_j - high_i <= {gap!r} and low_i - high_j <= {gap!r}").select("label", "dims", "i", "j")
    partners = pairs.select("label", "dims", F.col("i").alias("tile"), "i", "j", F.lit(0).alias("side")).unionByName(pairs.filter("i < j").select("label", "dims", F.col("j").alias("tile"), "i", "j", F.lit(1).alias("side")))
    tiled = full.withColumn("bin", F.floor((F.col("shadow") + 1) / 2 * step).cast("int")).join(placed.drop("low", "high"), ["label", "dims", "bin"]).withColumn("tile", F.col("first") + F.pmod(F.xxhash64("gid"), F.col("parts")))
    dealt = tiled.select("label", "dims", "tile", "gid", "weight", "raw").join(partners, ["label", "dims", "tile"]).select("label", "dims", "i", "j", "side", "gid", "weight", "raw")
    found = materialise(dealt.groupBy("label", "dims", "i", "j").applyInArrow(_pairs(threshold, kind), "gid long, links long, root long"), "embedding-links")
    counts = found.groupBy("gid").agg(F.sum("links").alias("links"))
    # groups that hold the same vec_id hang together by it
    mapped = materialise(valid.select("vec_id", *group).join(groups.select(*group, "gid", "weight"), group).select("vec_id", "gid", "weight"), "embedding-members")
    held = mapped.groupBy("vec_id").agg(F.min("gid").alias("low"), F.max("gid").alias("high"))
    twice = mapped.join(held.filter("low <> high"), "vec_id").select(F.col("gid").alias("u"), F.col("low").alias("v"))
    moved = roots(found.filter("gid <> root").select(F.col("gid").alias("u"), F.col("root").alias("v")).unionByName(twice), "embedding-components").select(F.col("node").alias("gid"), "root")
    # the smallest vec_id of a component, summed up before any exchange by root
    inside = moved.unionByName(moved.select(F.col("root").alias("gid"), "root").distinct())
    least = materialise(inside.join(groups.select("gid", "least"), "gid").groupBy("root").agg(F.min("least").alias("component")), "embedding-least")
    named = groups.select("gid", "least").join(inside, "gid", "left").join(least, "root", "left").select("gid", F.coalesce("component", "least").alias("component_id"))
    done = mapped.join(counts, "gid", "left").join(named, "gid").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    alone = rows.filter("key is null or label is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
