"""Streams that are killed and run again, and scorers that fail."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from screenlake.operators import documents
from screenlake.plans.documents import work_dir
from screenlake.streaming import ingest


def line(doc, seq, content="c", tokens=1):
    return json.dumps({"custom_id": f"request-{doc}-{seq}", "response": {"body": {"choices": [{"message": {"content": content}}], "usage": {"prompt_tokens": tokens, "completion_tokens": 2}}}})


def land(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def held(spark, root):
    return sorted((r["custom_id"], r["content"]) for r in ingest.results(spark, root).collect())


@pytest.mark.parametrize("cut", ["before", "after results", "after all"])
def test_killed_between_write_and_commit(spark, tmp_path, monkeypatch, cut):
    """A batch is cut off at several places; the next run repeats it and leaves each result once."""
    root, source = f"{tmp_path}/t", tmp_path / "in"
    land(source, "a", line(1, 1), line(1, 2), "{broken")
    ingest.ingest_available(spark, str(source), root, f"{tmp_path}/c")
    land(source, "b", line(1, 2, "late"), line(2, 1), line(2, 1, "b"), "also broken")
    write, seen = ingest.replace_parts, []

    def dies(df, path, *by):
        seen.append(path)
        if cut == "before":
            raise RuntimeError("killed")
        write(df, path, *by)
        if path.endswith("results" if cut == "after results" else "batches"):
            raise RuntimeError("killed")

    monkeypatch.setattr(ingest, "replace_parts", dies)
    with pytest.raises(Exception, match="killed"):
        ingest.ingest_available(spark, str(source), root, f"{tmp_path}/c")
    monkeypatch.setattr(ingest, "replace_parts", write)
    assert seen
    ingest.ingest_available(spark, str(source), root, f"{tmp_path}/c")
    assert held(spark, root) == [("request-1-1", "c"), ("request-1-2", "c"), ("request-2-1", "b")]
    assert sorted(r["value"] for r in spark.read.parquet(f"{root}/rejected").collect()) == ["also broken", "{broken"]
    batches = spark.read.parquet(f"{root}/batches").orderBy("batch").collect()
    assert [(r["n_lines"], r["n_rejected"]) for r in batches] == [(3, 1), (4, 1)]
    ingest.ingest_available(spark, str(source), root, f"{tmp_path}/c")  # nothing new
    assert len(held(spark, root)) == 3


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    root = f"{tmp_path}/t"
    first = spark.createDataFrame([(line(i, 1),) for i in range(400)], "value string")
    ingest.save_batch(first, 0, root, 16)
    schema = documents.ingested(first).schema
    one = spark.createDataFrame([(line(7, 1),)], "value string")
    bucket = one.select(ingest.bucket_of(F.get_json_object("value", "$.custom_id"), 16)).first()[0]
    read = ingest.held_results(spark, root, schema, [bucket], 1)
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert files and all(f"/bucket={bucket}/" in f for f in files)
    scan = read._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in scan.splitlines() if "PartitionFilters" in line).split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "bucket#" in filters and "batch#" in filters
    ingest.save_batch(one, 1, root, 16)
    assert len(held(spark, root)) == 400
    for k in range(2, 5):  # the table grows in other buckets; what a batch like this one reads doesn't
        more = spark.createDataFrame([(line(1000 * k + i, 1),) for i in range(300)], "value string")
        ingest.save_batch(more.where(ingest.bucket_of(F.get_json_object("value", "$.custom_id"), 16) != bucket), k, root, 16)
    later = ingest.held_results(spark, root, schema, [bucket], 9)
    assert {r[0] for r in later.select(F.input_file_name()).distinct().collect()} == files


def test_empty_and_null_lines(spark, tmp_path):
    ingest.save_batch(spark.createDataFrame([(None,), ("",), ("[]",)], "value string"), 0, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t/rejected").count() == 3
    assert spark.read.parquet(f"{tmp_path}/t/batches").first()["n_rejected"] == 3


def test_one_bad_row_loses_only_itself(spark):
    asked = []

    def scorer(texts):
        asked.append(len(texts))
        if texts.str.contains("bad").any():
            raise RuntimeError("no")
        return texts.str.len()

    texts = pd.Series(["aa", "b", "bad", "cccc", "dd", "bad one", "e"], index=[7, 1, 5, 0, 3, 2, 9])
    out = documents.halved(texts, scorer)
    assert out["score"].tolist()[:2] == [2, 1] and out["score"].isna().tolist() == [False, False, True, False, False, True, False]
    assert list(out.index) == list(texts.index) and out["error"][5] == "RuntimeError: no" and asked[0] == 7
    short = documents.halved(pd.Series(["a", "b"]), lambda t: [1])
    assert short["score"].tolist()[0] == 1 and short["score"].tolist()[1] == 1  # one text, one score


def test_a_stopped_scoring_run_goes_on(spark, tmp_path):
    """The run dies in its second batch; the next one scores the rest, and nothing twice."""
    for k in range(3):
        spark.createDataFrame([(10 * k + i, "x" * i) for i in range(4)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    flag = tmp_path / "die"
    flag.write_text("1")
    n_batches, replace = [], ingest.replace_parts

    def dies(df, path, *by):
        n_batches.append(path)
        replace(df, path, *by)
        if len(n_batches) == 2 and flag.exists():
            raise RuntimeError("stopped")

    ingest.replace_parts = dies
    try:
        with pytest.raises(Exception, match="stopped"):
            ingest.score_available(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/c", lambda t: t.str.len(), max_files=1)
        flag.unlink()
        ingest.score_available(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/c", lambda t: t.str.len(), max_files=1)
    finally:
        ingest.replace_parts = replace
    assert len(n_batches) == 4  # the second one twice, the first and third once
    got = sorted((r["doc_id"], r["score"], r["error"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(10 * k + i, float(i), None) for k in range(3) for i in range(4)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="share"):
        work_dir(Session())
