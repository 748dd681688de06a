"""Whitening against numpy over distinct vectors, and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from screenlake.llm import queries as q
from screenlake.llm import whitening

KIND = "vec_id long, embedding array<float>, Embedding2 int"


def brute(x, weights):
    n = int(weights.sum())
    s = weights @ x
    centred = x - s / n
    values, axes = np.linalg.eigh((centred * weights[:, None]).T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, s, centred @ axes / np.sqrt(values), values / values.sum()


def compare(got, ids, vectors, copies):
    x = np.floor(256 * np.asarray(vectors, dtype=np.float32).astype(float)).astype(np.int64)
    distinct, back, counts = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    n, s, white, share = brute(distinct, counts if copies else np.ones(len(distinct), dtype=np.int64))
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(by) == 4 * len(ids)
    for c in range(1, 5):
        mine = np.array([by[i, c]["whitened"] for i in ids])
        want = white[back, c - 1]
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert abs(by[ids[0], c]["explained"] / share[c - 1] - 1) < 1e-9
    for i, row in zip(ids, x):
        assert by[i, 1]["n"] == n and by[i, 1]["identity_error"] < 1e-9
        assert by[i, 1]["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))


def test_query_equals_numpy(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    compare(q.op11_whitening(spark, small).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows], False)


@pytest.mark.parametrize("copies", [False, True])
def test_copies_and_odd_rows(spark, copies):
    rng = np.random.default_rng(1)
    some = rng.normal(size=(60, 6)).round(2)
    vectors = [*some, *[some[0]] * 40, *some[:5]]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (902, [float("nan")] + [0.0] * 5, 1), (903, [float("inf")] + [0.0] * 5, 1)]
    df = spark.createDataFrame(rows + odd, KIND).withColumnRenamed("Embedding2", "a.b").withColumn("x", F.lit("mine"))
    compare(whitening.whiten(df, weigh_copies=copies).collect(), list(range(len(rows))), vectors, copies)


def test_without_variance(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], KIND)).collect()
    assert len(got) == 6 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is r["explained"] is None for r in got)
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0), (3, [3.0], 0), (4, [], 0)], KIND)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in line) == [(i, c) for i in range(1, 5) for c in (1, 2)]
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0)], KIND)).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True}
    assert abs(sum(r["explained"] for r in flat if r["vec_id"] == 1) - 1) < 1e-12
    assert whitening.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], KIND)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], KIND)).count() == 0


def test_deviation_beyond_64_bits_is_null(spark):
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame([(1, [3.0e7], 0), (2, [-3.0e7], 0), (3, [0.0], 0)], KIND)).collect()}
    assert got[1] is None and got[2] is None and got[3] == 0
