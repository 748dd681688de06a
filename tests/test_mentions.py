"""Mentions of very many targets against plain comparison."""

import random

from pyspark.sql import functions as F
from screenlake.operators import mentions


def test_ten_thousand_targets(spark):
    rng = random.Random(7)
    name = lambda k: "".join(rng.choice("abAB ÉéİıſSßΣσ#1") for _ in range(k))
    rows = [name(rng.randint(0, 14)) for _ in range(3000)] + [None, "", "Coca-Cola Bottlers Japan Inc.", "coca-cola bottlers japan"]
    targets = [name(rng.choice([1, 2, 3, 4, 5, 7, 9])) for _ in range(10_000)] + rows[:500] + ["Coca-Cola Bottlers Japan", "Bottlers", "x" * 300, None]
    targets = [t for t in targets if t != ""]
    df, t = spark.createDataFrame([(r,) for r in rows], "name string"), spark.createDataFrame([(x,) for x in targets], "target string")
    out = mentions.hits(df, "name", t)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r["target"]: r["hits"] for r in out.collect()}
    java = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in set(rows + targets) if x is not None], "x string").select("x", F.lower("x")).collect()}
    low = [java[r] for r in rows if r is not None]
    want = {}
    for x in {x for x in targets if x is not None}:
        equal = sum(r == java[x] for r in low)
        want[x] = equal or sum(java[x] in r for r in low)
    assert got == want


def test_few_and_odd_targets(spark):
    df = spark.createDataFrame([("Norske Skog",), ("norske skog asa",), ("NORSKE SKOG",), (None,), ("",)], "name string")
    ask = lambda *ts: {r["target"]: r["hits"] for r in mentions.hits(df, "name", spark.createDataFrame([(x,) for x in ts], "target string")).collect()}
    assert ask("Norske Skog", "SKOG", "k", "nobody", "norske skog asa b", "", None, "SKOG") == {"Norske Skog": 2, "SKOG": 3, "k": 3, "nobody": 0, "norske skog asa b": 0, "": 0}
    assert ask() == {}


def test_documents_holding_pieces_of_others(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    items = spark.read.parquet(f"{small}/benchmark.parquet").select(F.lower(F.substring("text", 30, 12)).alias("target"))
    texts, targets = docs.collect(), {r["target"] for r in items.collect()}
    got = {tuple(r) for r in mentions.holding(docs.withColumnRenamed("doc_id", "key"), items).collect()}
    assert got == {(r["doc_id"], t) for r in texts for t in targets if t and r["text"] and t in r["text"]} and got
