"""Operators on small hand-written frames: ties, NULLs, thresholds, empty frames."""

import random

from pyspark.sql import functions as F
from screenlake.functions import expr
from screenlake.operators import breakdowns, documents, entities, metrics, runs
from screenlake.streaming import ingest

RUN = "run_id long, doc_id long, prompt string, model string, run_at timestamp, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, d, "p", "m", None, s) for i, d, s in rows], RUN)


def test_repeat_aggregate_needs_eleven_rows(spark):
    rows = [(i, 1, 50.0) for i in range(10)] + [(100 + i, 2, 50.0 if i else None) for i in range(11)] + [(200 + i, 3, float(i)) for i in range(12)]
    got = {r["doc_id"]: r for r in runs.repeat_aggregate(frame(spark, rows)).collect()}
    assert got[1]["repeat_mean"] is None and got[2]["repeat_mean"] == 50.0 and got[2]["first_score"] is None
    assert got[3]["repeat_mean"] == 5.0 and got[3]["first_scores"] == [float(i) for i in range(11)] and got[3]["n_runs"] == 12
    assert runs.repeat_aggregate(frame(spark, [])).count() == 0


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 1), (None, 1), (0, 0)], "truth int, guess int")
    r = metrics.confusion_metrics(df, []).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"], r["precision"], r["recall"], r["f1"], r["specificity"]) == (0, 1, 1, 0, 0.0, 0.0, 0.0, 0.5)


def test_preferred_version_overrides_column_wise(spark):
    df = spark.createDataFrame([(1, 1, "2020-01-01", "a", True), (1, 2, "2020-01-02", "b", False), (2, 3, "2020-01-01", None, True), (2, 4, "2020-01-01", "d", False)], "event long, version long, created string, x string, best boolean")
    got = {r["event"]: (r["version"], r["x"]) for r in entities.dedup_with_preferred(df, F.col("best")).collect()}
    assert got == {1: (1, "a"), 2: (3, "d")}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 10)] + [(None,)], "v double")
    assert [r["n"] for r in breakdowns.histogram(df, "v", 10).orderBy("bin").collect()] == [1, 1, 1, 0, 0, 0, 0, 0, 0, 1]
    same = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert sum(r["n"] for r in breakdowns.histogram(same, "v", 3).collect()) == 2
    assert breakdowns.histogram(df.where("false"), "v", 3).count() == 0


def test_ingest_stream_holds_each_result_once(spark, tmp_path):
    line = '{"custom_id": "request-%d-1", "response": {"body": {"choices": [{"message": {"content": "c"}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2}}}}'
    source = tmp_path / "in"
    source.mkdir()
    for part in ([1, 2], [2, 3], [3]):
        (source / f"{len(list(source.iterdir()))}.txt").write_text("\n".join(line % i for i in part) + "\n{bad\n")
        ingest.ingest_available(spark, str(source), str(tmp_path / "t"), str(tmp_path / "c"))
    assert sorted(r["doc_id"] for r in ingest.results(spark, str(tmp_path / "t")).collect()) == [1, 2, 3]


def test_scorer_failures_become_errors(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    def scorer(texts):
        raise ValueError("no")
    assert {r["error"] for r in documents.scored(docs, scorer).collect()} == {"ValueError: no"}
    assert [r["score"] for r in documents.scored(docs, documents.lexicon_score(F.col("text"), ["a", "b"])).orderBy("doc_id").collect()] == [50.0, None]


def test_joins_with_short_lists_are_broadcast(spark):
    codes = spark.createDataFrame([("1005", 3, 1)], "code string, n long, hits long")
    plan = breakdowns.prefix_rates(codes, spark.createDataFrame([("a", "10")], "segment string, prefix string"))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_averages_number_runs_over_all_models(spark):
    """With two repeats wanted, each model's rows are those among the first two of the document, whoever made them."""
    rows = [(1, 1, "p", "a", 1, 10.0, "yes"), (2, 1, "p", "b", 2, 30.0, "no"), (3, 1, "p", "a", 3, 90.0, "no"), (4, 2, "p", "a", 1, 10.0, "true"), (5, 2, "p", "a", 2, None, "maybe"), (6, 2, "p", "b", 3, 5.0, "no")]
    df = spark.createDataFrame(rows, "run_id long, doc_id long, prompt string, model string, run_at long, score double, flag string")
    got = {(r["doc_id"], r["model"]): (r["mean_score"], r["mean_flag"], r["n"]) for r in runs.avg_first_n(df, repeats=2).collect()}
    assert got == {(1, "a"): (None, None, 1), (1, "b"): (None, None, 1), (2, "a"): (10.0, 1.0, 2)}
    loose = {(r["doc_id"], r["model"]): (r["mean_score"], r["mean_flag"]) for r in runs.avg_first_n(df, repeats=2, strict=False).collect()}
    assert loose[1, "a"] == (10.0, 1.0) and loose[1, "b"] == (30.0, 0.0)


def test_the_first_response_gives_reasoning_and_excerpts(spark):
    rows = [(2, 1, 5.0, '{"score": 5, "reasoning": "later"}'), (1, 1, None, '{"reasoning": "first", "excerpts": ["a", "b"]}'), (3, 2, 1.0, '{"score": 1, "reasoning": "cut o'), (4, 3, 1.0, None), (5, 4, 1.0, "")]
    df = spark.createDataFrame(rows, "run_id long, doc_id long, score double, response string")
    got = {r["doc_id"]: (r["first_reasoning"], r["first_excerpts"]) for r in runs.repeat_aggregate(df, response="response").collect()}
    assert got == {1: ("first", "a; b"), 2: ("cut o", ""), 3: (None, None), 4: (None, None)}


def test_versions_by_text_times(spark):
    rows = [(1, 1, "2020-01-02", "10:00:00"), (1, 2, "2020-01-02", "09:59:59"), (1, 3, "2020-01-02", "25:00:00"), (2, 4, None, "10:00:00"), (2, 5, "x", ""), (3, 6, "2020-1-2", "10:00:00"), (3, 7, "2019-12-31", "00:00:00")]
    df = spark.createDataFrame(rows, "event int, version int, d string, t string").withColumn("created", expr.moment(F.col("d"), F.col("t")))
    assert {r["event"]: r["version"] for r in entities.latest_version(df).collect()} == {1: 1, 2: 5, 3: 7}


def test_rankings_of_a_group_with_most_entities(spark):
    rng = random.Random(3)
    rows = [(rng.choice("AAAAAAAAAB"), rng.randint(1, 300), rng.random() < 0.3) for _ in range(3000)] + [("C", 1, None)]
    got = breakdowns.entity_rankings(spark.createDataFrame(rows, "g string, e int, f boolean"), "g", "e", "f", best=4, least=2).collect()
    per = {}
    for g, e, f in rows:
        n, k = per.get((g, e), (0, 0))
        per[g, e] = (n + 1, k + bool(f))
    for g in "ABC":
        mine = [(e, n, k) for (x, e), (n, k) in per.items() if x == g]
        orders = {"volume": lambda r: (-r[1], -r[2], r[0]), "rate": lambda r: (-r[2] / r[1], -r[1], r[0]), "tail": lambda r: (r[2] / r[1], -r[1], r[0])}
        for name, order in orders.items():
            want = sorted((r for r in mine if name == "volume" or r[1] >= 2), key=order)[:4]
            assert [(r["e"], r["n"], r["hits"]) for r in sorted(got, key=lambda r: r["rank"]) if (r["g"], r["ranking"]) == (g, name)] == want
        assert {r["n_entities"] for r in got if r["g"] == g} == {len(mine)}


def test_pairings_and_repeats(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2), (None, 3), ("c", 4)], "l string, r int")
    got = {r["side"]: tuple(r)[1:] for r in entities.pairing_report(df, "l", "r").collect()}
    assert got == {"l": (4, 1, 3, 1, 2), "r": (4, 2, 4, 1, 2)}
    assert tuple(entities.distinct_counts(df).first()) == (6, 5) and tuple(entities.distinct_counts(df.where("false")).first()) == (0, 0)


def test_odds_ratios(spark):
    rows = [(1, True, True)] * 3 + [(1, False, True)] + [(0, True, False)] * 1 + [(0, False, False)] * 3 + [(None, True, True)]
    got = {r["y"]: r for r in metrics.agreement(spark.createDataFrame(rows, "y int, f boolean, v boolean"), "y", ["f", "v"]).collect()}
    assert set(got) == {0, 1} and got[1]["f_odds_ratio"] == got[0]["f_odds_ratio"] == 9.0 and got[1]["f_pct"] == 75.0
    assert got[1]["v_odds_ratio"] is None and got[1]["n_v"] == 4  # class 1 always


def test_summary_of_a_grid(spark):
    grid = spark.createDataFrame([("m1", "x", "pooled", 0.4, 1.0, 1.0, 1.0), ("m1", "y", "pooled", 0.5, 0.5, 0.5, 0.5), ("m2", "x", "pooled", 0.1, 1.0, 1.0, 1.0), ("m2", "y", "other", 0.9, 1.0, 1.0, 1.0)], "model string, approach string, label_source string, f1 double, precision double, recall double, specificity double")
    assert tuple(metrics.grid_summary(grid, "m1", "x").first()) == (2, "m1", "y", 0.5, 0.5, 0.5, 0.5, "m2", 25.0)
    zero = metrics.grid_summary(grid.withColumn("f1", F.lit(0.0)), "m1", "x").first()
    assert zero["best_model"] is None and zero["improvement_pct"] == 0.0


def test_scorer_gets_texts_by_their_bytes(spark):
    """However many rows a batch has, and with columns of any type beside; failures and nulls stay with their rows."""
    docs = spark.range(400, numPartitions=1).select("id", F.repeat(F.lit("x"), F.when(F.col("id") % 7 > 0, 30_000 + F.col("id"))).alias("text"), F.array("id").alias("other"))

    def scorer(texts):
        sizes = texts.str.len().fillna(0)
        if sizes.sum() > 3 << 20:
            raise ValueError("too much")
        if (sizes % 5 == 0).any():
            raise ValueError("no score")
        return sizes

    seen = []
    for r in documents.scored(docs, lambda texts: [float(texts.str.len().sum())] * len(texts)).collect():
        seen.append(r["score"])
    assert max(seen) < 3 << 20
    for r in documents.scored(docs, scorer).collect():
        n = len(r["text"] or "")
        assert (r["score"], r["error"]) == ((None, "ValueError: no score") if n % 5 == 0 else (n, None)) and r["other"] == [r["id"]]
    assert documents.scored(docs.where("false"), scorer).count() == 0


def test_keys_of_grouped_pairs_are_counted_without_grouping_them_again(spark, small):
    from screenlake.plans import entities as plans

    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "a"), (None, "a"), (None, "c")], "key int, partner string")
    got = [sorted(map(tuple, entities.key_uniqueness(pairs, "key", "partner", unique=u).collect()), key=str) for u in (False, True)]
    assert got[0] == got[1] == [(1, 3, 2), (None, 2, 2)]
    plan = plans.key_uniqueness(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 4  # two of the pairs and two of the keys
