"""Running sums and quantiles against plain Python, on skewed keys, ties and odd values."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from screenlake.operators import breakdowns, ranks, runs


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """One queue holds nine tenths of the rows."""
    rng = random.Random(1)
    rows = [("big" if rng.random() < 0.9 else rng.choice(["a", "b", None]), i, rng.choice([None, 1, 5, 70])) for i in rng.sample(range(10**6), 4000)]
    return rows, spark.createDataFrame(rows, "prompt string, run_id long, tokens long").repartition(7)


@pytest.mark.parametrize("ranges", [1, 2, 37, 256])
def test_running_sums(skewed, ranges):
    rows, df = skewed
    got = {r["run_id"]: (r["total"], r["rn"]) for r in ranks.running_sums(df, ["prompt"], "run_id", {"total": F.coalesce("tokens", F.lit(0)), "rn": F.lit(1)}, ranges=ranges).collect()}
    totals = defaultdict(lambda: [0, 0])
    assert len(got) == len(rows)
    for prompt, i, tokens in sorted(rows, key=lambda r: r[1]):
        totals[prompt][0] += tokens or 0
        totals[prompt][1] += 1
        assert got[i] == tuple(totals[prompt])


def test_a_large_queue_is_many_tasks(skewed):
    _, df = skewed
    cuts = ranks.range_cuts(df, "run_id", 64)
    per = df.where("prompt = 'big'").groupBy(ranks.range_number(F.col("run_id"), cuts)).count().collect()
    assert len(per) == 64 and max(r["count"] for r in per) < 2 * 3700 / 64
    for out in (runs.packed(df, 100), runs.submittable(df.select(F.col("prompt").alias("queue"), F.col("run_id").alias("batch_id"), F.lit("pending").alias("status"), "tokens"), 50, ("live",))):
        text = plan(out)
        windows = [line for line in text.splitlines() if "Window [" in line]
        assert windows and all("_range" in line for line in windows)


def test_packing_keeps_one_at_least(spark):
    df = spark.createDataFrame([("p", 1, 500), ("p", 2, 1), ("q", 3, 10), ("q", 4, 90), ("q", 5, 1), (None, 6, 7)], "prompt string, run_id long, tokens long")
    assert sorted(r["run_id"] for r in runs.packed(df, 100).where("kept").collect()) == [1, 3, 4, 6]
    assert runs.packed(df.where("false"), 100).count() == 0


def test_entity_batches(spark):
    r = spark.createDataFrame([("p", 1, 10), ("p", 1, None), ("p", 2, None), ("p", 3, 95), ("q", 2, 1)], "prompt string, doc_id long, tokens long")
    docs = spark.createDataFrame([(1, 40), (3, 380)], "doc_id long, n_chars long")
    got = {(x["prompt"], x["doc_id"]): x for x in runs.entity_batches(r, docs, "doc_id", 10, 100).collect()}
    assert set(got) == {("p", 1), ("p", 3), ("q", 2)}  # nothing to send for p, 2
    assert (got["p", 1]["n_intended"], got["p", 1]["n_sent"], got["p", 1]["n_missing"], got["p", 1]["n_tokens"], got["p", 1]["batch_no"]) == (2, 1, 1, 20, 1)
    assert (got["p", 3]["n_over"], got["p", 3]["batch_no"], got["p", 3]["n_chars"]) == (1, 2, 380) and got["q", 2]["n_chars"] == 0


SHARES = [0.0, 0.001, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("few", [1, 40, 10**6])
@pytest.mark.parametrize("kind", ["even", "ties", "wide", "one", "two"])
def test_quantiles_are_exact(spark, few, kind):
    rng = np.random.default_rng(3)
    x = {"even": rng.normal(size=3000), "ties": np.where(rng.random(3000) < 0.97, 5.0, rng.normal(size=3000)), "wide": np.exp(rng.normal(size=3000) * 200), "one": np.array([4.0]), "two": np.array([1.0, 2.0] * 900 + [3.0])}[kind]
    rows = [(float(v), None) for v in x] + [(None, None), (float("nan"), None)] * 20
    df = spark.createDataFrame(rows, "v double, w double").repartition(5)
    got = ranks.quantiles(df, {"v": SHARES, "w": [0.5]}, few=few)
    assert got["w"] == [None]
    assert np.allclose(got["v"], np.quantile(x, SHARES), rtol=1e-12, atol=0)


def test_no_plan_sorts_all_values_in_one_task(spark, small):
    from screenlake.plans.catalog import QUERIES

    for name in ("quantile_bin_rates", "continuous_summary", "coverage_stats"):
        assert " percentile(" not in plan(QUERIES[name](spark, small))


def test_bins_with_equal_edges(spark):
    df = spark.createDataFrame([(1.0,)] * 50 + [(2.0,), (3.0,), (None,), (float("nan"),)], "v double")
    assert {r["bin"] for r in breakdowns.quantile_bins(df, "v", 4).where("v = 1").collect()} == {1}
    assert breakdowns.quantile_bins(df, "v", 4).where("bin IS NULL").count() == 2
