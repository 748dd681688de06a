"""Queries for exports, names, exclusions, joins of two sources, representative rows and covariates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from . import standins as s
from .documents import work_dir
from .registry import query

EXCLUDED = (1, 5, 9)


@query("WITH " + s.RUNS + " SELECT run_id, doc_id, prompt, score FROM runs WHERE prompt IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY doc_id, prompt ORDER BY run_at DESC, run_id DESC) = 1")
def export_latest_runs(spark, d):
    path = work_dir(spark)
    files.export_csv(s.runs(spark, d).select("run_id", "doc_id", "prompt", "score", "run_at"), path, ["click", "view"], latest=(["doc_id", "prompt"], ["run_at", "run_id"]))
    return files.headered_csv(spark, path, "run_id bigint, doc_id bigint, prompt string, score double, run_at string").drop("run_at")


@query("WITH " + s.FOLLOWUPS + " SELECT followup_id, parent_id, score FROM followups")
def export_followups(spark, d):
    path = work_dir(spark)
    files.export_csv(s.followups(spark, d), path)
    return files.headered_csv(spark, path, "followup_id bigint, parent_id bigint, score double")


@query("WITH " + s.FOLLOWUPS + " SELECT f.followup_id, f.parent_id, f.score, r.doc_id AS parent_doc_id, r.prompt AS parent_prompt, r.score AS parent_score FROM followups f LEFT JOIN runs r ON f.parent_id = r.run_id")
def export_followups_with_parents(spark, d):
    path = work_dir(spark)
    parents = s.runs(spark, d).select(F.col("run_id").alias("parent_id"), F.col("doc_id").alias("parent_doc_id"), F.col("prompt").alias("parent_prompt"), F.col("score").alias("parent_score"))
    joined = s.followups(spark, d).join(parents, "parent_id", "left").select("followup_id", "parent_id", "score", "parent_doc_id", "parent_prompt", "parent_score")
    files.export_csv(joined, path)
    return files.headered_csv(spark, path, "followup_id bigint, parent_id bigint, score double, parent_doc_id bigint, parent_prompt string, parent_score double")


@query("SELECT n_nationkey AS cle_de_nation, n_name AS nom_court, n_regionkey AS region FROM nation")
def clean_column_names(spark, d):
    raw = s.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").toDF(" Cl\u00e9 de Nation", "Nom (court)", "R\u00e9gion ")
    return raw.toDF(*files.clean_names(raw.columns))


@query("WITH " + s.RUNS + " SELECT run_id, doc_id FROM runs WHERE doc_id NOT IN (1, 5, 9)")
def exclude_ids(spark, d):
    return s.runs(spark, d).where(~F.col("doc_id").isin(*EXCLUDED)).select("run_id", "doc_id")


@query("SELECT o.o_orderkey, o.o_custkey, l.l_linenumber, l.l_quantity FROM lineitem l JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000) o ON l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate AND l.l_returnflag = 'R'")
def two_source_join(spark, d):
    orders = s.table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 1000").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = s.table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return lines.join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate"))).select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity")


@query("WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_nationkey AS nation, c_mktsegment AS segment, n FROM g QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1")
def representative_rows(spark, d):
    counts = s.table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(F.col("c_nationkey").alias("nation")).agg(F.min_by(F.struct("c_mktsegment", "n"), F.struct(-F.col("n"), "c_mktsegment")).alias("x"))
    return best.select("nation", F.col("x.c_mktsegment").alias("segment"), "x.n")


@query("SELECT doc_id, CASE WHEN length(text) > 0 THEN round(ln(length(text)), 6) END AS log_chars FROM documents")
def log_covariate(spark, d):
    return s.table(spark, d, "documents").select("doc_id", F.round(F.ln(F.nullif(F.length("text"), F.lit(0)).cast("double")), 6).alias("log_chars"))
