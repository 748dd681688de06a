"""Code trees: parents, most specific codes, names of the unlisted, order, membership by what a table has."""

import random

from pyspark.sql import functions as F
from screenlake.operators import breakdowns, codes
from screenlake.plans.catalog import QUERIES

NAMES = [("naics", 2, "31", "makers"), ("naics", 4, "3111", "pet food"), ("naics", 3, "3111", "vague"), ("naics", 6, "311111", "dogs"), ("sic", 2, "01", "crops"), ("sic", 3, "016", "greens"), ("gics", 2, "10", "energy"), ("gics", 8, "10101010", "drilling")]
KIND = "system string, level int, code string, name string"


def test_tree(spark):
    got = {(r["system"], r["code"]): (r["level"], r["name"], r["parent"]) for r in codes.tree(spark.createDataFrame(NAMES, KIND)).collect()}
    assert got["naics", "3111"] == (4, "pet food", "31") and got["naics", "311111"] == (6, "dogs", "3111")
    assert got["naics", "31"] == (2, "makers", None) and got["gics", "10101010"] == (8, "drilling", "10") and len(got) == 7


def brute(rows, listed):
    out = {}
    for system, column in (("gics", 0), ("naics", 1), ("sic", 2)):
        for r in rows:
            full, flag = r[column], r[3]
            if full is None:
                continue
            own = max((c for s, c in listed if s == system and full.startswith(c) and not full[len(c) :].strip("0")), key=len, default=full)
            for level in codes.LEVELS[system]:
                if level <= len(own):
                    n, hits = out.get((system, level, own[:level]), (0, 0))
                    out[system, level, own[:level]] = (n + (flag is not None), hits + bool(flag))
    return out


def test_rates_names_and_order(spark):
    rng = random.Random(2)
    pick = lambda kinds: rng.choice(kinds)
    rows = [(pick(["10101010", "10202020", "10000000", None]), pick(["311111", "311100", "311999", "310000", "999999", None]), pick(["0161", "0160", "0100", "0199", "7000", "01"]), pick([True, False, None])) for _ in range(500)]
    df = spark.createDataFrame(rows, "gics string, naics string, sic string, flag boolean")
    got = codes.hierarchy_rates(df, {c: c for c in codes.LEVELS}, spark.createDataFrame(NAMES, KIND)).collect()
    assert {(r["system"], r["level"], r["code"]): (r["n"], r["hits"]) for r in got} == brute(rows, {(s, c) for s, _, c, _ in NAMES})
    assert [tuple(r)[:3] for r in got] == [tuple(r)[:3] for r in sorted(got, key=lambda r: (r["system"], r["level"], -(r["pct"] or 0), r["code"]))]
    names = {(r["system"], r["code"]): r["name"] for r in got}
    assert names["naics", "3111"] == "pet food" and names["naics", "311999"] == "makers (code: 311999)" and names["naics", "311"] == "NAICS 311"
    assert names["naics", "999999"] == "NAICS 999999" and names["sic", "016"] == "greens" and names["gics", "10202020"] == "energy (code: 10202020)"
    assert ("naics", "311100") not in names and ("sic", "0160") not in names and ("gics", "10000000") not in names


def test_sorted_output_is_ranges_not_one_task(spark, small):
    plan = QUERIES["hierarchy_rates"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(system" in plan and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


def test_memberships(spark):
    rows = [(1, "1000", "311111", "10101010"), (2, None, "120600", "99"), (3, "20", None, None)]
    df = spark.createDataFrame(rows, "id int, sic string, naics string, gics string")
    samples = {"a": {"sic": ["10"], "naics": ["12"]}, "b": {"naics": ["1206", "3"], "gics": ["10"]}, "c": {"gics": ["10"]}}
    got = [tuple(r)[4:] for r in codes.memberships(df, samples).orderBy("id").collect()]
    assert got == [(True, True, True), (None, True, False), (False, None, None)]
    without = df.withColumn("sic", F.lit(None).cast("string"))
    assert [r["a"] for r in codes.memberships(without, samples).orderBy("id").collect()] == [False, True, None]  # by NAICS now
    none = without.withColumn("naics", F.lit(None).cast("string"))
    assert [r["a"] for r in codes.memberships(none, samples).collect()] == [None] * 3


def test_one_point_bins_have_no_gaps(spark):
    got = breakdowns.histogram_one_point(spark.createDataFrame([(0.5,), (0.7,), (3.0,), (-1.2,), (None,)], "v double"), "v").orderBy("bin").collect()
    assert [tuple(r) for r in got] == [(-2, 1), (-1, 0), (0, 2), (1, 0), (2, 0), (3, 1)]
    assert breakdowns.histogram_one_point(spark.createDataFrame([], "v double"), "v").count() == 0
