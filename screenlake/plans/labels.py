"""Queries over labels, audits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..functions.expr import as_count, percent, rounded
from ..operators import breakdowns, entities as ent, metrics, runs as ops
from . import standins as s
from .registry import query
from .runs import RN, STAGES_SQL, stages

RATES = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"
COUNTS = "count(*) FILTER (WHERE truth = 1 AND guess = 1) AS tp, count(*) FILTER (WHERE truth = 0 AND guess = 1) AS fp, count(*) FILTER (WHERE truth = 0 AND guess = 0) AS tn, count(*) FILTER (WHERE truth = 1 AND guess = 0) AS fn"
LABELS3 = "labels3 AS (SELECT doc_id, unnest([{'s': 'rater_a', 't': (rater_a >= 50)::INT}, {'s': 'rater_b', 't': rater_b}, {'s': 'pooled', 't': coalesce(rater_b, (rater_a >= 50)::INT)}]) AS x FROM ratings), long AS (SELECT doc_id, x.s AS label_source, x.t AS truth FROM labels3)"
FIRST = f"first AS (SELECT * FROM (SELECT *, {RN.format('prompt, doc_id', 'run_at, run_id')} AS rn FROM runs) WHERE rn = 1)"


@query(f"WITH {s.AUDIT} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'F' END AS label FROM audit")
def normalize_labels(spark, d):
    return s.audit(spark, d).select("doc_id", expr.normal_label(F.col("raw_label")).alias("label"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 END::DOUBLE AS flag FROM labels")
def flag_to_num(spark, d):
    from ..functions.parsing import flag_number

    text = F.element_at(F.array(*map(F.lit, (" True", "no", "1", "0 ", "maybe"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return s.table(spark, d, "labels").select("doc_id", flag_number(text).alias("flag"))


@query(f"WITH {s.RATINGS} SELECT DISTINCT doc_id FROM ratings WHERE rater_a IS NOT NULL OR rater_b IS NOT NULL")
def benchmark_ids(spark, d):
    return s.ratings(spark, d).where(F.col("rater_a").isNotNull() | F.col("rater_b").isNotNull()).select("doc_id").distinct()


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' END AS language FROM documents")
def recode_values(spark, d):
    return s.table(spark, d, "documents").select("doc_id", expr.recode(F.col("lang"), {"en": "English", "de": "German", "fr": "French"}).alias("language"))


@query(f"WITH {s.RUNS}, {s.AUDIT} SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS rated, doc_id IN (SELECT doc_id FROM audit) AS audited, doc_id IN (SELECT doc_id FROM runs WHERE score >= 75) AS flagged FROM documents")
def membership_flags(spark, d):
    sets = {"rated": s.table(spark, d, "labels"), "audited": s.audit(spark, d), "flagged": s.runs(spark, d).where("score >= 75")}
    return ent.membership_flags(s.table(spark, d, "documents").select("doc_id"), sets)


def predicted(spark, d):
    first = ops.first_run(s.runs(spark, d))
    return first.withColumn("guess", metrics.prediction(F.col("score"), F.lit(None).cast("double")))


@query(f"WITH {s.RUNS}, {s.RATINGS}, {FIRST}, x AS (SELECT prompt, rater_b AS truth, (score >= 75)::INT AS guess FROM first JOIN ratings USING (doc_id)), c AS (SELECT prompt, {COUNTS} FROM x GROUP BY 1) SELECT *, {RATES} FROM c")
def confusion_metrics(spark, d):
    return metrics.confusion_metrics(predicted(spark, d).join(s.ratings(spark, d).withColumnRenamed("rater_b", "truth"), "doc_id"), ["prompt"])


@query(f"WITH {s.RUNS}, {s.RATINGS}, {FIRST} SELECT p.prompt, r.doc_id, f.score, r.rater_a, r.rater_b FROM (SELECT DISTINCT prompt FROM runs) p CROSS JOIN ratings r LEFT JOIN first f ON f.prompt = p.prompt AND f.doc_id = r.doc_id")
def prompt_label_grid(spark, d):
    runs = s.runs(spark, d)
    prompts = runs.agg(F.collect_set("prompt").alias("prompts"))  # one row, merged in tasks
    wanted = s.ratings(spark, d).crossJoin(F.broadcast(prompts)).withColumn("prompt", F.explode("prompts"))
    return wanted.join(ops.first_run(runs).select("prompt", "doc_id", "score"), ["prompt", "doc_id"], "left").select("prompt", "doc_id", "score", "rater_a", "rater_b")


@query(f"WITH {s.RUNS}, {s.RATINGS}, {FIRST}, {LABELS3}, x AS (SELECT prompt, label_source, truth, (score >= 75)::INT AS guess FROM first JOIN long USING (doc_id)), c AS (SELECT prompt, label_source, {COUNTS} FROM x GROUP BY 1, 2) SELECT *, {RATES} FROM c")
def metrics_by_prompt(spark, d):
    return metrics.confusion_metrics(metrics.label_sources(predicted(spark, d).join(s.ratings(spark, d), "doc_id")), ["prompt", "label_source"])


@query(f"WITH {s.RUNS}, {s.RATINGS}, {FIRST}, x AS (SELECT CASE WHEN prompt IN ('click', 'view') THEN 'score' ELSE 'flag' END AS panel, coalesce(rater_b, (rater_a >= 50)::INT) AS truth, CASE WHEN prompt IN ('click', 'view') THEN (score >= 75)::INT ELSE (cost >= 50)::INT END AS guess FROM first JOIN ratings USING (doc_id)), c AS (SELECT panel, {COUNTS} FROM x GROUP BY 1) SELECT *, {RATES} FROM c")
def panel_metrics(spark, d):
    by_score = F.col("prompt").isin("click", "view")
    x = ops.first_run(s.runs(spark, d)).join(s.ratings(spark, d), "doc_id").select(F.when(by_score, F.lit("score")).otherwise(F.lit("flag")).alias("panel"), F.coalesce(F.col("rater_b"), (F.col("rater_a") >= 50).cast("int")).alias("truth"), F.when(by_score, (F.col("score") >= 75).cast("int")).otherwise((F.col("cost") >= 50).cast("int")).alias("guess"))
    return metrics.confusion_metrics(x, ["panel"])


@query(f"WITH {s.RUNS}, {s.RATINGS}, u AS (SELECT * FROM (SELECT *, {RN.format('model, doc_id', 'run_at, run_id')} AS rn FROM runs WHERE score IS NOT NULL) WHERE rn = 1), specs AS (SELECT unnest(['m0', 'm1', 'm2', 'm9']) AS model), g AS (SELECT model, doc_id, coalesce(rater_b, (rater_a >= 50)::INT) AS truth FROM specs CROSS JOIN ratings), x AS (SELECT g.model, truth, (score >= 75)::INT AS guess FROM g LEFT JOIN u ON u.model = g.model AND u.doc_id = g.doc_id), c AS (SELECT model, {COUNTS}, count(*) FILTER (WHERE truth IS NOT NULL) AS n_total, count(*) FILTER (WHERE truth IS NOT NULL AND guess IS NOT NULL) AS n_used FROM x GROUP BY 1) SELECT *, {RATES}, round(n_used / n_total, 6) AS coverage FROM c")
def metrics_by_model(spark, d):
    truth = F.coalesce(F.col("rater_b"), (F.col("rater_a") >= 50).cast("int"))
    grid = s.ratings(spark, d).select("doc_id", truth.alias("truth"), F.explode(F.array(*map(F.lit, ("m0", "m1", "m2", "m9")))).alias("model"))
    x = grid.join(ops.first_usable_run(s.runs(spark, d)), ["model", "doc_id"], "left").withColumn("guess", (F.col("score") >= 75).cast("int"))
    known = F.col("truth").isNotNull()
    c = x.groupBy("model").agg(*metrics.confusion(F.col("truth"), F.col("guess")), as_count(F.count_if(known)).alias("n_total"), as_count(F.count_if(known & F.col("guess").isNotNull())).alias("n_used"))
    return metrics.with_rates(c).withColumn("coverage", rounded(F.try_divide("n_used", "n_total")))


GRID = STAGES_SQL.rstrip() + f", {s.RATINGS}, {LABELS3}, ap AS (SELECT model, doc_id, unnest([{{'a': 'flagged', 's': flagged}}, {{'a': 'validated', 's': validated}}, {{'a': 'with_followup', 's': with_followup}}]) AS y FROM stages), x AS (SELECT model, y.a AS approach, label_source, truth, (y.s >= 75)::INT AS guess FROM ap JOIN long USING (doc_id)), c AS (SELECT model, approach, label_source, {COUNTS} FROM x GROUP BY 1, 2, 3) SELECT *, {RATES} FROM c"


@query(GRID)
def approach_grid(spark, d):
    names = ("flagged", "validated", "with_followup")
    long = stages(spark, d).select("model", "doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("a"), F.col(n).alias("s")) for n in names])).alias("y"))
    x = long.select("model", "doc_id", F.col("y.a").alias("approach"), (F.col("y.s") >= 75).cast("int").alias("guess")).join(s.ratings(spark, d), "doc_id")
    return metrics.confusion_metrics(metrics.label_sources(x), ["model", "approach", "label_source"])


@query(f"""WITH g AS ({GRID}), p AS (SELECT * FROM g WHERE label_source = 'pooled'), b AS (SELECT * FROM p WHERE f1 > 0 ORDER BY f1 DESC, model, approach LIMIT 1), m AS (SELECT max(f1) AS hi, min(f1) AS lo FROM p WHERE model = 'm1')
SELECT (SELECT count(DISTINCT model) FROM p) AS n_models, b.model AS best_model, b.approach AS best_approach, b.f1, b.precision, b.recall, b.specificity, (SELECT model FROM p WHERE approach = 'flagged' ORDER BY f1, model LIMIT 1) AS worst_model, CASE WHEN lo > 0 THEN round((hi - lo) / lo * 100, 6) ELSE 0.0 END AS improvement_pct FROM m LEFT JOIN b ON true""")
def approach_summary(spark, d):
    return metrics.grid_summary(approach_grid(spark, d), primary="m1", shown="flagged")


ODDS = f"""WITH {s.RUNS}, {s.RATINGS}, f AS (SELECT doc_id, max(score) >= 75 AS flagged, avg(score) >= 50 AS validated FROM runs GROUP BY 1),
x AS (SELECT rater_b, count(*) AS n, count(*) FILTER (WHERE flagged) AS n_flagged, count(*) FILTER (WHERE validated) AS n_validated FROM ratings JOIN f USING (doc_id) WHERE rater_b IS NOT NULL GROUP BY 1),
p AS (SELECT max(n_flagged / n) FILTER (WHERE rater_b = 1) AS f1, max(n_flagged / n) FILTER (WHERE rater_b = 0) AS f0, max(n_validated / n) FILTER (WHERE rater_b = 1) AS v1, max(n_validated / n) FILTER (WHERE rater_b = 0) AS v0 FROM x)
SELECT rater_b, n, n_flagged, round(100.0 * n_flagged / n, 6) AS flagged_pct, CASE WHEN f0 > 0 AND f0 < 1 AND f1 < 1 THEN round(f1 / (1 - f1) / (f0 / (1 - f0)), 6) END AS flagged_odds_ratio,
  n_validated, round(100.0 * n_validated / n, 6) AS validated_pct, CASE WHEN v0 > 0 AND v0 < 1 AND v1 < 1 THEN round(v1 / (1 - v1) / (v0 / (1 - v0)), 6) END AS validated_odds_ratio FROM x, p"""


@query(ODDS)
def agreement_odds(spark, d):
    f = s.runs(spark, d).groupBy("doc_id").agg((F.max("score") >= 75).alias("flagged"), (F.avg("score") >= 50).alias("validated"))
    return metrics.agreement(s.ratings(spark, d).join(f, "doc_id"), "rater_b", ["flagged", "validated"])


AUDITED = f"{s.AUDIT}, {s.RUNS}, m AS (SELECT doc_id, round(avg(score), 6) AS mean_score FROM runs GROUP BY 1), aud AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'F' END AS label, mean_score FROM audit JOIN m USING (doc_id) WHERE doc_id % 4 < 2)"


def audited(spark, d):
    means = s.runs(spark, d).groupBy("doc_id").agg(rounded(F.avg("score")).alias("mean_score"))
    return s.audit(spark, d).join(means, "doc_id").withColumn("label", expr.normal_label(F.col("raw_label"))).where("label IS NOT NULL").select("doc_id", "label", "mean_score")


@query(f"WITH {AUDITED}, c AS (SELECT (SELECT min(s) FROM (SELECT mean_score AS s FROM aud ORDER BY s DESC LIMIT 8)) AS hi, (SELECT max(s) FROM (SELECT mean_score AS s FROM aud ORDER BY s LIMIT 8)) AS lo), b AS (SELECT *, CASE WHEN mean_score >= hi THEN 'top' WHEN mean_score <= lo THEN 'bottom' ELSE 'middle' END AS bin FROM aud, c) SELECT bin, count(*) FILTER (WHERE label = 'T') AS n_true, count(*) FILTER (WHERE label = 'F') AS n_false, min(mean_score) AS low, max(mean_score) AS high, round(100.0 * count(*) FILTER (WHERE label = 'T') / count(*), 6) AS pct FROM b GROUP BY 1")
def tie_aware_bins(spark, d):
    b = breakdowns.tie_aware_bins(audited(spark, d), "mean_score", "doc_id", 8, 8)
    hit = F.count_if(F.col("label") == "T")
    return b.groupBy("bin").agg(as_count(hit).alias("n_true"), as_count(F.count_if(F.col("label") == "F")).alias("n_false"), F.min("mean_score").alias("low"), F.max("mean_score").alias("high"), rounded(percent(hit, F.count(F.lit(1)))).alias("pct"))


@query(f"WITH {AUDITED} SELECT count(*) AS n, count(*) FILTER (WHERE label = 'T') AS n_true, count(*) FILTER (WHERE label = 'F') AS n_false, round(100.0 * count(*) FILTER (WHERE label = 'T') / count(*), 6) AS pct, min(mean_score) AS low, max(mean_score) AS high, round(avg(mean_score), 4) AS mean, round(stddev_samp(mean_score), 4) AS sd, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM aud")
def audit_summary(spark, d):
    n, hit = F.count(F.lit(1)), F.count_if(F.col("label") == "T")
    total = s.table(spark, d, "documents").agg(F.count(F.lit(1)).alias("_all"))
    a = audited(spark, d).agg(as_count(n).alias("n"), as_count(hit).alias("n_true"), as_count(F.count_if(F.col("label") == "F")).alias("n_false"), rounded(percent(hit, n)).alias("pct"), F.min("mean_score").alias("low"), F.max("mean_score").alias("high"), rounded(F.avg("mean_score"), 4).alias("mean"), rounded(F.stddev_samp("mean_score"), 4).alias("sd"))
    return a.crossJoin(total).withColumn("share", rounded(F.col("n") / F.col("_all"))).drop("_all")  # one row each


@query(f"WITH {s.AUDIT} SELECT count(DISTINCT coalesce(c_custkey::VARCHAR, upper(trim(raw_label)))) AS n_entities, count(DISTINCT c_custkey) AS n_matched, count(DISTINCT CASE WHEN c_custkey IS NULL THEN upper(trim(raw_label)) END) AS n_unmatched FROM audit LEFT JOIN customer ON doc_id * 3 = c_custkey")
def distinct_entities(spark, d):
    c = s.table(spark, d, "customer").select("c_custkey")
    x = s.audit(spark, d).join(c, F.col("doc_id") * 3 == F.col("c_custkey"), "left")
    name = F.upper(F.trim("raw_label"))
    return x.agg(as_count(F.count_distinct(F.coalesce(F.col("c_custkey").cast("string"), name))).alias("n_entities"), as_count(F.count_distinct("c_custkey")).alias("n_matched"), as_count(F.count_distinct(F.when(F.col("c_custkey").isNull(), name))).alias("n_unmatched"))


@query(f"WITH {s.AUDIT} SELECT doc_id, coalesce(c_name, 'Sheet ' || doc_id) AS name, c_name IS NULL AS from_sheet FROM audit LEFT JOIN customer ON doc_id * 3 = c_custkey")
def canonical_entity(spark, d):
    c = s.table(spark, d, "customer").select("c_custkey", "c_name")
    return s.audit(spark, d).join(c, F.col("doc_id") * 3 == F.col("c_custkey"), "left").select("doc_id", F.coalesce("c_name", F.concat(F.lit("Sheet "), F.col("doc_id").cast("string"))).alias("name"), F.col("c_name").isNull().alias("from_sheet"))
