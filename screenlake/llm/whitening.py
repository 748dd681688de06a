"""Whitening of embedding vectors by the covariance of their distinct quantised forms.

Vectors become 64-bit integers x = floor(scale * component). Identical x are one group with its number of
rows; the fit weighs a group by that number or by one. Tasks sum the weighted vectors, then multiply
(GEMM) vectors that are centred by the mean; their sums meet in Spark by matrix entry, so only a vector's
and a matrix's worth of numbers reaches the driver, which finds the eigenvectors. Each distinct x is projected
once, and its row numbers join it back, by x and a hash of it that sorts quickly. A group with very many
rows is one row on the fitted side, so Spark splits it as a skewed join.

Cases: vectors that are null, or hold null or non-finite components, are left out; null ids, repeated ids
and all other columns don't matter; shorter vectors are filled up with zeros. A component without
variance beyond rounding (all of them, with one distinct vector) has null ``whitened``, and null ``explained``
where there is no variance at all; components beyond the dimension aren't returned. A deviation beyond
64 bits is null. An empty table, or vectors without components only, give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, staged

SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
ROWS = 4096


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x): floor(scale * component) of every usable vector."""
    v = column(vector_col)
    usable = v.isNotNull() & F.forall(v, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where(usable).select(column(id_col).cast("bigint").alias("vec_id"), F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint")).alias("x"))


def matrix(x: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of 64-bit integers, filled up with zeros."""
    lengths = x.value_lengths().to_numpy(zero_copy_only=False)
    flat = x.flatten().to_numpy(zero_copy_only=False)
    if len(x) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(x), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, weights) of at most ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield matrix(part.column("x"), width), part.column("weight").to_numpy()


def fit_sums(groups: DataFrame, width: int) -> np.ndarray:
    """The weighted sum of the vectors, exact in 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for x, weight in blocks(batches, width):
            total += weight @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["i", "s"])

    sums = groups.select("x", "weight").mapInArrow(run, "i bigint, s bigint").groupBy("i").agg(F.sum("s").alias("s"))
    return sums.toPandas().sort_values("i")["s"].to_numpy(dtype=np.int64)


def fit_covariance(groups: DataFrame, width: int, mean: np.ndarray, n: int) -> np.ndarray:
    """The weighted covariance with divisor n: each task centres its vectors and multiplies them with themselves."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for x, weight in blocks(batches, width):
            centred = x - mean
            total += centred.T @ (centred * weight[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), pa.array(total[upper])], ["i", "j", "s"])

    sums = groups.select("x", "weight").mapInArrow(run, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros((width, width))
    i, j = sums["i"].to_numpy(dtype=np.int64), sums["j"].to_numpy(dtype=np.int64)
    out[i, j] = out[j, i] = sums["s"].to_numpy() / n
    return out


def project(groups: DataFrame, width: int, sums: np.ndarray, n: int, axes: np.ndarray) -> DataFrame:
    """``groups`` with deviation and w, the projection on each row of ``axes`` (already divided by the root of its variance)."""
    mean = sums / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = matrix(part.column("x"), width)
                with np.errstate(over="ignore"):
                    apart = np.int64(n) * x - sums  # wraps, as does the sum of squares, so it is exact if it fits
                    deviation = (apart * apart).sum(axis=1)
                rough = ((n * (x - mean)) ** 2).sum(axis=1)
                w = np.ascontiguousarray((x - mean) @ axes.T)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), len(axes)).cast(pa.list_(pa.float64())) if len(axes) else pa.array([[]] * len(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("x"), part.column("weight"), pa.array(deviation, mask=rough >= 2.0**63 * (1 - 1e-9)), lists], ["x", "weight", "deviation", "w"])

    return groups.select("x", "weight").mapInArrow(run, "x array<bigint>, weight bigint, deviation bigint, w array<double>")


def identity_error(projected: DataFrame, k: int, n: int) -> float:
    """The largest absolute entry of the whitened vectors' weighted covariance minus the identity, measured."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = [F.col("w")[i] for i in range(k)]
    means = projected.agg(*(F.sum(F.col("weight") * x) / n for x in w)).first()
    got = projected.agg(*(F.sum(F.col("weight") * (w[i] - F.lit(means[i])) * (w[j] - F.lit(means[j]))) / n for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(got, pairs))


def whiten(vectors: DataFrame, components: int = 4, weigh_copies: bool = False, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """A row for each usable vector and component: SCHEMA.

    ``weigh_copies``: identical vectors count as often as they occur in the fit, not once; ``n`` is the sum of
    the weights and ``deviation`` the sum over dimensions of (n * x - S)^2, S being the weighted sum.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, scale)
    weight = F.count(F.lit(1)) if weigh_copies else F.lit(1).cast("bigint")
    groups = staged(rows.groupBy("x").agg(weight.alias("weight")), "groups")
    size = groups.agg(F.sum("weight").alias("n"), F.max(F.size("x")).alias("width")).first()
    if not size["width"]:
        return spark.createDataFrame([], SCHEMA)
    n, width = size["n"], size["width"]
    sums = fit_sums(groups, width)
    covariance = fit_covariance(groups, width, sums / n, n)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1].T
    top = min(components, width)
    firm = int((values[:top] > width * np.finfo(float).eps * max(values[0], 0.0)).sum())
    projected = staged(project(groups, width, sums, n, axes[:firm] / np.sqrt(values[:firm])[:, None]), "projected")
    discard(groups)
    error, trace = identity_error(projected, firm, n) if firm else None, float(np.trace(covariance))
    share = [float(max(v, 0.0) / trace) if trace > 0 else None for v in values[:top]]
    parts = F.array(*(F.struct(F.lit(c + 1).alias("component"), (F.col("w")[c] if c < firm else F.lit(None).cast("double")).alias("whitened"), F.lit(share[c]).cast("double").alias("explained")) for c in range(top)))
    back = rows.withColumn("h", F.xxhash64("x")).join(projected.drop("weight").withColumn("h", F.xxhash64("x")), ["h", "x"])
    out = back.select("vec_id", F.lit(n).cast("bigint").alias("n"), "deviation", F.lit(error).cast("double").alias("identity_error"), F.inline(parts))
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
