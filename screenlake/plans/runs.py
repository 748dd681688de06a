"""Queries over runs: selection, averaging, deficits, batches, parsing."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import expr, parsing
from ..functions.expr import as_count, rounded
from ..operators import breakdowns, documents, runs as ops
from . import standins as s
from .registry import query

R = f"WITH {s.RUNS} "
RN = "row_number() OVER (PARTITION BY {0} ORDER BY {1})"


@query(R + "SELECT run_id, doc_id, prompt, score FROM runs")
def parse_score_simple(spark, d):
    return s.runs(spark, d).select("run_id", "doc_id", "prompt", "score")


@query(R + "SELECT prompt, doc_id, run_id, score FROM (SELECT *, " + RN.format("prompt, doc_id", "run_at, run_id") + " AS rn FROM runs) WHERE rn = 1")
def first_run(spark, d):
    return ops.first_run(s.runs(spark, d)).select("prompt", "doc_id", "run_id", "score")


@query(R + "SELECT doc_id, prompt, run_id, score FROM (SELECT *, " + RN.format("prompt, doc_id", "run_at DESC, run_id DESC") + " AS rn FROM runs) WHERE rn = 1")
def latest_runs(spark, d):
    return ops.latest_runs(s.runs(spark, d)).select("doc_id", "prompt", "run_id", "score")


@query(R + "SELECT run_id, doc_id, score FROM runs WHERE score >= 75")
def flag_by_threshold(spark, d):
    return s.runs(spark, d).where(F.col("score") >= 75).select("run_id", "doc_id", "score")


@query(R + f", f AS (SELECT prompt, score >= 75 AS flag FROM (SELECT *, {RN.format('prompt, doc_id', 'run_at, run_id')} AS rn FROM runs) WHERE rn = 1), g AS (SELECT prompt, count(flag) AS n, sum(flag::INT)::BIGINT AS hits FROM f GROUP BY 1) SELECT prompt, n, hits, {s.wilson_sql()} FROM g")
def wilson_ci(spark, d):
    first = ops.first_run(s.runs(spark, d)).withColumn("flag", F.col("score") >= 75)
    return breakdowns.rates(first, ["prompt"]).orderBy("prompt")


@query(R + "SELECT run_id, prompt FROM runs WHERE prompt IN ('click', 'view')")
def runs_by_prompt(spark, d):
    return s.runs(spark, d).where(F.col("prompt").isin("click", "view")).select("run_id", "prompt")


@query(R + "SELECT doc_id, prompt, model, count(*) AS n FROM runs GROUP BY 1, 2, 3")
def run_counts(spark, d):
    return s.runs(spark, d).groupBy("doc_id", "prompt", "model").agg(as_count(F.count(F.lit(1))).alias("n"))


@query(R + ", f AS (SELECT doc_id, min(run_id) AS run_id FROM runs WHERE prompt = 'view' GROUP BY 1) SELECT r.doc_id, r.run_id, coalesce(score, 0) AS original_score FROM runs r JOIN f USING (doc_id, run_id) WHERE model = 'm1'")
def original_scores(spark, d):
    return ops.original_scores(s.runs(spark, d), "view", "m1")


@query(R + f", u AS (SELECT *, {RN.format('model, doc_id', 'run_at, run_id')} AS rn FROM runs WHERE score IS NOT NULL), a AS (SELECT model, doc_id, count(*) AS attempts FROM runs GROUP BY 1, 2) SELECT model, doc_id, run_id, score, attempts FROM u JOIN a USING (model, doc_id) WHERE rn = 1")
def first_usable_run(spark, d):
    return ops.first_usable_run(s.runs(spark, d))


@query(R + f", n AS (SELECT *, {RN.format('doc_id', 'run_id')} AS rn FROM runs WHERE prompt = 'click') SELECT doc_id, max(CASE WHEN rn = 1 THEN score END) AS first_score, CASE WHEN count(*) >= 11 THEN round(avg(CASE WHEN rn <= 11 THEN score END), 6) END AS repeat_mean, round(avg(score), 6) AS all_mean, list(score ORDER BY rn) FILTER (WHERE rn <= 11) AS first_scores, count(*) AS n_runs, 'run ' || chr(97 + (min(run_id) % 26)::INT) AS first_reasoning, CASE WHEN min(run_id) % 3 > 0 THEN 'q' || min(run_id) || '; s' ELSE '' END AS first_excerpts FROM n GROUP BY 1")
def repeat_aggregate(spark, d):
    i = F.col("run_id").cast("string")
    excerpts = F.when(F.col("run_id") % 3 > 0, F.concat(F.lit(', "excerpts": ["q'), i, F.lit('", "s"]'))).otherwise(F.lit(""))
    text = F.concat(F.lit('{"score": '), F.col("score").cast("int").cast("string"), F.lit(', "reasoning": "run '), F.char((F.col("run_id") % 26 + 97).cast("int")), F.lit('"'), excerpts, F.lit("}"))
    return ops.repeat_aggregate(s.runs(spark, d).where("prompt = 'click'").withColumn("response", text), response="response")


@query(f"WITH {s.FOLLOWUPS}, g AS (SELECT r.doc_id, round(avg(f.score), 6) AS followup_mean, count(*) AS n_followups FROM followups f JOIN runs r ON f.parent_id = r.run_id WHERE r.prompt <> 'error' GROUP BY 1) SELECT doc_id, followup_mean, coalesce(n_followups, 0) AS n_followups FROM (SELECT DISTINCT doc_id FROM runs WHERE prompt <> 'error') LEFT JOIN g USING (doc_id)")
def followup_aggregate(spark, d):
    return ops.followup_aggregate(s.runs(spark, d).where("prompt <> 'error'"), s.followups(spark, d))


@query(R + f", n AS (SELECT *, {RN.format('prompt, doc_id', 'run_at, run_id')} AS rn FROM runs) SELECT prompt, doc_id, model, CASE WHEN count(*) >= 2 THEN round(avg(score), 6) END AS mean_score, CASE WHEN count(*) >= 2 THEN round(avg(CASE run_id % 5 WHEN 0 THEN NULL ELSE run_id % 2 END), 6) END AS mean_flag, min(run_at) AS first_at, count(*) AS n FROM n WHERE rn <= 2 GROUP BY 1, 2, 3")
def avg_first_n(spark, d):
    said = F.element_at(F.array(*map(F.lit, ("no", "Yes"))), (F.col("run_id") % 2 + 1).cast("int"))
    flags = F.when(F.col("run_id") % 5 == 0, F.lit("maybe")).otherwise(said)
    return ops.avg_first_n(s.runs(spark, d).withColumn("flag", flags), repeats=2)


STAGES_SQL = f"WITH {s.FOLLOWUPS}, n AS (SELECT *, {RN.format('model, doc_id', 'run_id')} AS rn FROM runs WHERE score IS NOT NULL AND prompt = 'click'), a AS (SELECT model, doc_id, max(CASE WHEN rn = 1 THEN score END) AS flagged, avg(CASE WHEN rn <= 11 THEN score END) AS m, count(*) AS n, min(run_id) AS run_id FROM n GROUP BY 1, 2), v AS (SELECT *, CASE WHEN flagged >= 75 AND n > 1 THEN m ELSE flagged END AS validated FROM a), f AS (SELECT parent_id AS run_id, avg(score) AS follow FROM followups GROUP BY 1), stages AS (SELECT model, doc_id, flagged, round(validated, 6) AS validated, round(CASE WHEN validated >= 75 AND follow < 75 THEN 0 ELSE validated END, 6) AS with_followup FROM v LEFT JOIN f USING (run_id)) "


def stages(spark, d):
    return ops.screening_stages(s.runs(spark, d).where("prompt = 'click'"), s.followups(spark, d))


@query(STAGES_SQL + "SELECT * FROM stages")
def screening_stages(spark, d):
    return stages(spark, d)


@query(R + ", c AS (SELECT d.doc_id, count(r.run_id) AS n FROM documents d LEFT JOIN runs r ON r.doc_id = d.doc_id AND prompt = 'signup' GROUP BY 1), p AS (SELECT CASE WHEN min(n) = 0 THEN 1 ELSE 12 END AS goal FROM c) SELECT doc_id, unnest(range(1, goal - n + 1))::BIGINT AS missing_no FROM c, p WHERE goal > n")
def run_deficits(spark, d):
    return ops.run_deficits(s.runs(spark, d).where("prompt = 'signup'"), s.table(spark, d, "documents"), 12)


@query(R + "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, list_sort(list(DISTINCT prompt)) AS prompts, max(run_at) AS latest, count(*) FILTER (WHERE prompt = 'error') AS n_followups FROM runs")
def store_overview(spark, d):
    return s.runs(spark, d).agg(as_count(F.count(F.lit(1))).alias("n_rows"), as_count(F.count_distinct("doc_id")).alias("n_docs"), F.sort_array(F.collect_set("prompt")).alias("prompts"), F.max("run_at").alias("latest"), as_count(F.count_if(F.col("prompt") == "error")).alias("n_followups"))


def requests_of_runs(spark, d):
    docs = s.table(spark, d, "documents").select("doc_id", F.ceil(F.col("n_chars") / 4).cast("bigint").alias("tokens"))
    status = F.element_at(F.array(*map(F.lit, ("pending", "submitted", "completed", "failed"))), (F.col("run_id") % 4 + 1).cast("int"))
    return s.runs(spark, d).join(docs, "doc_id").select("prompt", "run_id", "doc_id", "tokens", status.alias("status"))


REQ = f"WITH {s.RUNS}, req AS (SELECT prompt, run_id, doc_id, ceil(n_chars / 4.0)::BIGINT AS tokens, ['pending', 'submitted', 'completed', 'failed'][run_id % 4 + 1] AS status FROM runs JOIN documents USING (doc_id)) "


@query(REQ + "SELECT prompt, run_id, tokens, running::BIGINT AS running, running <= 100000 OR rn = 1 AS kept FROM (SELECT *, sum(tokens) OVER w AS running, row_number() OVER w AS rn FROM req WINDOW w AS (PARTITION BY prompt ORDER BY run_id))")
def pack_batches(spark, d):
    return ops.packed(requests_of_runs(spark, d), 100_000)


@query(REQ + "SELECT prompt, count(*) AS n_requests, sum(tokens + 500)::BIGINT AS n_tokens, round(sum(tokens + 500) * 0.075 / 1e6, 6) AS input_cost, round(count(*) * 500 * 0.30 / 1e6, 6) AS output_cost FROM req GROUP BY 1")
def batch_cost(spark, d):
    return documents.batch_cost(requests_of_runs(spark, d), "prompt", 500, 0.075, 0.30, 500)


@query(REQ + "SELECT prompt, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, round(100.0 * count(*) FILTER (WHERE status = 'completed') / count(*), 6) AS pct, coalesce(sum(tokens) FILTER (WHERE status = 'submitted'), 0)::BIGINT AS queued_tokens FROM req GROUP BY 1")
def progress_summary(spark, d):
    n, done = F.count(F.lit(1)), F.count_if(F.col("status") == "completed")
    return requests_of_runs(spark, d).groupBy("prompt").agg(as_count(n).alias("n"), as_count(done).alias("completed"), as_count(F.count_if(F.col("status") == "failed")).alias("failed"), rounded(100.0 * done / n).alias("pct"), as_count(F.coalesce(F.sum(F.when(F.col("status") == "submitted", F.col("tokens"))), F.lit(0))).alias("queued_tokens"))


@query(REQ + "SELECT coalesce(sum(tokens) FILTER (WHERE status = 'submitted'), 0)::BIGINT AS in_flight, greatest(0, 10000000 - coalesce(sum(tokens) FILTER (WHERE status = 'submitted'), 0))::BIGINT AS free FROM req")
def queue_capacity(spark, d):
    live = F.coalesce(F.sum(F.when(F.col("status") == "submitted", F.col("tokens"))), F.lit(0))
    return requests_of_runs(spark, d).agg(as_count(live).alias("in_flight"), as_count(F.greatest(F.lit(0), 10_000_000 - live)).alias("free"))


def doc_batches(spark, d):
    return requests_of_runs(spark, d).groupBy(F.col("prompt").alias("queue"), F.col("doc_id").alias("batch_id"), "status").agg(as_count(F.sum("tokens")).alias("tokens"))


@query(REQ + ", b AS (SELECT prompt AS queue, doc_id AS batch_id, status, sum(tokens)::BIGINT AS tokens FROM req GROUP BY 1, 2, 3), u AS (SELECT queue, coalesce(sum(tokens) FILTER (WHERE status = 'submitted'), 0) AS used FROM b GROUP BY 1), p AS (SELECT *, sum(tokens) OVER (PARTITION BY queue ORDER BY batch_id) AS running FROM b WHERE status = 'pending') SELECT queue, batch_id, tokens, running::BIGINT AS running FROM p JOIN u USING (queue) WHERE running <= greatest(0, 600000 - used)")
def submittable_batches(spark, d):
    return ops.submittable(doc_batches(spark, d), 600_000, ("submitted",))


@query(REQ + ", w AS (SELECT prompt, doc_id, CASE WHEN run_id % 7 <> 0 THEN tokens END AS tokens, n_chars FROM req JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)), e AS (SELECT prompt, doc_id, count(*) AS n_intended, count(tokens) AS n_sent, count(*) - count(tokens) AS n_missing, sum(tokens + 500)::BIGINT AS n_tokens, max(tokens)::BIGINT AS largest, count(*) FILTER (WHERE tokens + 500 > 1000) AS n_over, coalesce(sum(n_chars) FILTER (WHERE tokens IS NOT NULL), 0)::BIGINT AS n_chars FROM w GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY doc_id) AS batch_no FROM e WHERE n_sent > 0")
def entity_batches(spark, d):
    """Every seventh request's document has no known size."""
    sized = requests_of_runs(spark, d).select("prompt", "doc_id", F.when(F.col("run_id") % 7 != 0, F.col("tokens")).alias("tokens"))
    return ops.entity_batches(sized, s.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 500, 1000)


@query(f"WITH {s.FOLLOWUPS} SELECT f.followup_id, f.parent_id, r.doc_id, r.prompt AS parent_prompt, r.score AS parent_score, f.score AS followup_score FROM followups f JOIN runs r ON f.parent_id = r.run_id WHERE r.prompt <> 'error'")
def followups_with_parent(spark, d):
    r = s.runs(spark, d).where("prompt <> 'error'").select(F.col("run_id").alias("parent_id"), "doc_id", F.col("prompt").alias("parent_prompt"), F.col("score").alias("parent_score"))
    return s.followups(spark, d).withColumnRenamed("score", "followup_score").join(r, "parent_id").select("followup_id", "parent_id", "doc_id", "parent_prompt", "parent_score", "followup_score")


@query(R + "SELECT run_id, doc_id, score, 'request-' || doc_id || '-1' AS custom_id FROM runs WHERE score >= 75 AND run_id % 5 <> 0")
def followup_requests(spark, d):
    excerpts = F.when(F.col("run_id") % 5 != 0, F.format_string('{"excerpts": ["a %s", "b"]}', F.col("run_id").cast("string")))
    chosen = s.runs(spark, d).withColumn("excerpts", parsing.excerpts(excerpts)).where((F.col("score") >= 75) & (F.trim("excerpts") != ""))
    return chosen.select("run_id", "doc_id", "score", F.concat(F.lit("request-"), F.col("doc_id").cast("string"), F.lit("-1")).alias("custom_id"))


def malformed(spark, d):
    """Runs with their score hidden in eight kinds of response."""
    k = F.col("score").cast("int").cast("string")
    kinds = [F.concat(F.lit('{"score": '), k, F.lit("}")), F.concat(F.lit('Sure. {"score": '), k, F.lit(', "reasoning": "x"} Done.')), F.concat(F.lit("Score: "), k), F.concat(k, F.lit("/100")), F.concat(k, F.lit(" out of 100")), F.concat(F.lit('{"severity_score": '), k, F.lit(', "reasoning": "why"}')), F.concat(F.lit('{"score": '), k, F.lit(', "reasoning": "cut off')), F.lit("no digits here")]
    return s.runs(spark, d).withColumn("response", F.element_at(F.array(*kinds), (F.col("run_id") % 8 + 1).cast("int")))


@query(R + "SELECT run_id, CASE WHEN run_id % 8 < 7 THEN score END AS score, CASE run_id % 8 WHEN 2 THEN 'pattern:2' WHEN 3 THEN 'pattern:5' WHEN 4 THEN 'pattern:6' WHEN 5 THEN 'json:severity_score' WHEN 6 THEN 'pattern:1' WHEN 7 THEN 'none' ELSE 'json:score' END AS stage FROM runs")
def parse_scores(spark, d):
    found = malformed(spark, d).select("run_id", parsing.cascade(F.col("response")).alias("found"))
    return found.select("run_id", F.col("found.score").alias("score"), F.coalesce("found.stage", F.lit("none")).alias("stage"))


SALVAGED = """SELECT run_id, CASE run_id % 6 WHEN 3 THEN 'about' WHEN 0 THEN 'why' WHEN 1 THEN 'cut  off' WHEN 4 THEN '' END AS reasoning,
    CASE WHEN run_id % 6 <> 5 THEN score::INT::VARCHAR END AS score_text, CASE run_id % 6 WHEN 0 THEN '"x' || run_id || '"' WHEN 3 THEN '"p", "q"' WHEN 4 THEN 'none }' END AS excerpts FROM runs"""


@query(R + SALVAGED)
def salvage_fields(spark, d):
    """Broken objects: a bracket not closed, cut off, a key before its turn, digits around the letters, no bracket, no key."""
    k, i = F.col("score").cast("int").cast("string"), F.col("run_id").cast("string")
    kinds = [F.concat(F.lit('{"score": '), k, F.lit(', "reasoning": "75% why '), k, F.lit('", "excerpts": ["x'), i, F.lit('"')), F.concat(F.lit('{"score":\n '), k, F.lit(',\n "reasoning": "cut \\\t off ')), F.concat(F.lit('{"reasoning": "early", "score": '), k, F.lit("}")), F.concat(F.lit('{"score": "about '), k, F.lit('", "reasoning": "9 about ...", "excerpts": [ "p", "q" ], }')), F.concat(F.lit('{"score": '), k, F.lit(', "reasoning": 12, "excerpts": none }')), F.lit("score: none")]
    found = parsing.salvaged(F.element_at(F.array(*kinds), (F.col("run_id") % 6 + 1).cast("int")), ["score", "reasoning", "excerpts"])
    return s.runs(spark, d).select("run_id", found.alias("f")).select("run_id", "f.reasoning", F.col("f.score").cast("string").alias("score_text"), "f.excerpts")


@query(R + "SELECT run_id, 'a ' || run_id || '; b' AS excerpts FROM runs")
def parse_excerpts(spark, d):
    i = F.col("run_id").cast("string")
    text = F.when(F.col("run_id") % 2 == 0, F.concat(F.lit('{"excerpts": ["a '), i, F.lit('", "b"]}'))).otherwise(F.concat(F.lit('{"score": 3, "excerpts": ["a '), i, F.lit('", "b"], ')))
    return s.runs(spark, d).select("run_id", parsing.excerpts(text).alias("excerpts"))


@query(R + "SELECT run_id, score, (run_id % 2)::DOUBLE AS flag, 'r' || run_id AS reasoning, 'q' AS excerpts FROM runs")
def parse_response_fields(spark, d):
    i = F.col("run_id").cast("string")
    text = F.concat(F.lit('{"score": '), F.col("score").cast("int").cast("string"), F.lit(', "indicator": '), (F.col("run_id") % 2).cast("string"), F.lit(', "reasoning": "r'), i, F.lit('", "excerpts": ["q"]}'))
    r = s.runs(spark, d).withColumn("response", text)
    c = F.col("response")
    return r.select("run_id", parsing.cascade_score(c).alias("score"), parsing.flag(c).alias("flag"), parsing.json_field(c, "reasoning").alias("reasoning"), parsing.excerpts(c).alias("excerpts"))


NORMAL = """SELECT run_id, CASE WHEN run_id % 8 < 7 THEN '{"score":' || score::INT || ',"reasoning":"' || CASE run_id % 8 WHEN 1 THEN 'x\\"} Done' WHEN 5 THEN 'why' WHEN 6 THEN 'cut off' ELSE '' END || '","excerpts":[]}' END AS normal FROM runs"""


@query(R + NORMAL)
def normalize_responses(spark, d):
    return malformed(spark, d).select("run_id", parsing.canonical(F.col("response")).alias("normal"))


@query(R + "SELECT run_id, run_id % 8 = 0 AS valid FROM runs")
def validate_responses(spark, d):
    score = parsing.number(parsing.json_field(F.col("response"), "score"))
    return malformed(spark, d).select("run_id", F.coalesce(score.between(0, 100), F.lit(False)).alias("valid"))


EXAMPLES = {"int": "@", "string": "as @", "array": ["a @", "b"], "boolean": True}


def declared(spark, d):
    """All runs with a response of one of the declared formats by turns: whole, without its last field, with that as null, and cut off."""
    texts = []
    for fields in parsing.FORMATS.values():
        whole = {k: EXAMPLES[t] for k, t in fields.items()}
        last = list(whole)[-1]
        kinds = [whole, {k: v for k, v in whole.items() if k != last}, whole | {last: None}]
        texts += [json.dumps(x).replace('"@"', "@") for x in (*kinds, whole)]
        texts[-1] = texts[-1][:-1]
    i = F.col("run_id")
    text = F.element_at(F.array(*map(F.lit, texts)), (4 * (i % 11) + F.floor(i / 11) % 4 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, parsing.FORMATS)), (i % 11 + 1).cast("int"))
    return s.runs(spark, d).withColumns({"format": name, "response": F.replace(text, F.lit("@"), F.col("score").cast("int").cast("string"))})


@query(R + "SELECT run_id, [" + ", ".join(f"'{f}'" for f in parsing.FORMATS) + "][run_id % 11 + 1] AS format, (run_id // 11) % 4 = 0 AS valid FROM runs")
def validate_formats(spark, d):
    return declared(spark, d).select("run_id", "format", parsing.validated(F.col("response"), F.col("format")).alias("valid"))


@query("WITH h AS (SELECT o_orderkey, quarter(o_orderdate)::BIGINT AS quarter, year(o_orderdate)::BIGINT AS year FROM orders) SELECT * FROM h")
def period_from_headline(spark, d):
    o = s.table(spark, d, "orders")
    head = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(", Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(" Earnings Call"))
    q, y = parsing.period(head)
    return o.select("o_orderkey", q.alias("quarter"), y.alias("year"))


@query(f"WITH {s.RUNS} SELECT run_id, score, round(score / 2, 6) AS as_number, NULL::DOUBLE AS bad, CASE WHEN run_id % 3 > 0 THEN date_trunc('second', run_at) END AS as_time FROM runs")
def coerce_types(spark, d):
    """Numbers and times as text; every third time isn't one."""
    text = F.when(F.col("run_id") % 3 > 0, F.date_format("run_at", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("2020-13-01 10:00:00"))
    date, time = F.substring_index(text, " ", 1), F.substring_index(text, " ", -1)
    return s.runs(spark, d).select("run_id", "score", rounded((F.col("score") / 2).cast("string").try_cast("double")).alias("as_number"), F.concat(F.lit("x"), F.col("run_id").cast("string")).try_cast("double").alias("bad"), expr.moment(date, time).alias("as_time"))


@query(R + "SELECT doc_id, prompt, score FROM runs WHERE score >= 98")
def flagged_list(spark, d):
    return s.runs(spark, d).where("score >= 98").select("doc_id", "prompt", "score").orderBy(F.desc("score"), "doc_id")


@query(R + "SELECT run_id, doc_id, score FROM runs WHERE score >= 90 AND score >= (SELECT min(s) FROM (SELECT score AS s FROM runs ORDER BY score DESC LIMIT 50))")
def top_scored_docs(spark, d):
    r = s.runs(spark, d).where("score >= 90").select("run_id", "doc_id", "score")
    cut = r.orderBy(F.desc("score")).limit(50).agg(F.min("score").alias("cut"))
    return r.crossJoin(F.broadcast(cut)).where("score >= cut").drop("cut")  # one row on the right
