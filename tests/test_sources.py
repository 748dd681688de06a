"""Database scans on the engine that Spark ships, and profiles merged from sketches."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from screenlake.sources import database, profiles

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


@pytest.fixture(scope="module")
def url(spark):
    """A table of 3000 rows, most of whose keys are crowded at one end, 7 of them NULL."""
    address = f"jdbc:derby:memory:{uuid.uuid4().hex}"
    rows = [(i, float(i)) for i in range(2500)] + [(10**6 + 1000 * i, -1.0) for i in range(493)] + [(None, 0.5)] * 7
    spark.createDataFrame(rows, "k long, v double").write.format("jdbc").options(url=f"{address};create=true", dbtable="t", driver=DRIVER).save()
    return address


def test_even_partitions_with_pushed_filters(spark, url):
    t = database.table(spark, url, "t", '"k"', rows_per_part=300, counted=5000, driver=DRIVER)
    sizes = [r["count"] for r in t.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 600 and t.rdd.getNumPartitions() >= 10
    plan = t.where("k < 100 AND v > 10").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "*LessThan(k,100)" in plan.replace("K", "k") and "*GreaterThan(v,10.0)" in plan.replace("V", "v") and "struct<v:double>" in plan.lower()
    assert t.where("k < 100 AND v > 10").count() == 89 and t.where("k IS NULL").count() == 7


def test_small_and_empty_tables_are_one_partition(spark, url):
    assert database.table(spark, url, "t", '"k"', driver=DRIVER).rdd.getNumPartitions() == 1
    spark.createDataFrame([], "k long").write.format("jdbc").options(url=url, dbtable="nothing", driver=DRIVER).save()
    assert database.table(spark, url, "nothing", '"k"', rows_per_part=0, driver=DRIVER).count() == 0


def test_even_ranges():
    assert database.even_ranges([(0, 5), (1, 5), (7, 20), (9, 1)], 100, 10, 10) == [(None, 170), (170, 190), (190, None)]
    assert database.even_ranges([], 0, 1, 10) == [(None, None)]


def test_parts_add_up(spark, tmp_path):
    """Parts are profiled as they come, one of them again; the merged profile is that of all rows."""
    rng = np.random.default_rng(5)
    x = np.exp(rng.normal(size=6000)) + 1e6
    rows = [(2000 + i % 4, float(v) if i % 50 else None, ["a", "b", "b", None, "c b"][i % 5], float("nan")) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "year int, v double, s string, `n.o` double")
    for years in ([2000], [2001, 2002], [2003], [2001]):
        profiles.update(df.where(F.col("year").isin(years)), F.col("year"), str(tmp_path / "p"))
    parts = profiles.held(spark, str(tmp_path / "p"))
    assert parts.select("part").distinct().count() == 4
    got = {r["column_name"]: r for r in profiles.merged(parts).collect()}
    known = np.array([v for _, v, _, _ in rows if v is not None])
    v = got["v"]
    assert (v["n"], v["n_null"]) == (len(known), 120) and abs(v["mean"] / known.mean() - 1) < 1e-12 and abs(v["sd"] / known.std(ddof=1) - 1) < 1e-6
    assert float(v["low"]) == known.min() and float(v["high"]) == known.max()
    for q, share in profiles.QUARTILES.items():
        assert abs((known <= v[q]).mean() - share) < 0.01
    assert abs(v["n_distinct"] / len(set(known)) - 1) < 0.05 and v["top"] is None
    assert (got["s"]["top"], got["s"]["n_top"], got["s"]["n"], got["s"]["n_distinct"], got["s"]["low"], got["s"]["high"]) == ("b", 2400, 4800, 3, "a", "c b")
    assert (got["n.o"]["n"], got["n.o"]["median"], got["n.o"]["sd"]) == (0, None, None)
