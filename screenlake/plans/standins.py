"""The roles of the package's tables (runs, follow-ups, ratings, ...) over the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import simple_score


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("prompt"), F.col("ts").alias("run_at"), F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), F.col("props").alias("response"), F.col("value").alias("cost"), simple_score(F.col("props"), "k").alias("score"))


RUNS = "runs AS (SELECT event_id AS run_id, user_id AS doc_id, event_type AS prompt, ts AS run_at, 'm' || (event_id % 3) AS model, props AS response, value AS cost, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS score FROM events)"


def followups(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).where("prompt = 'error'")
    return r.select(F.col("run_id").alias("followup_id"), (F.col("run_id") - 1).alias("parent_id"), "score")


FOLLOWUPS = RUNS + ", followups AS (SELECT run_id AS followup_id, run_id - 1 AS parent_id, score FROM runs WHERE prompt = 'error')"


def ratings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, 100.0 * (1 - F.col("quality"))).alias("rater_a"), F.when(F.col("doc_id") % 3 != 0, F.col("toxic")).alias("rater_b"))


RATINGS = "ratings AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 100.0 * (1 - quality) END::DOUBLE AS rater_a, CASE WHEN doc_id % 3 <> 0 THEN toxic END AS rater_b FROM labels)"


def audit(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("doc_id") % 4
    return table(spark, d, "labels").where(r < 3).select("doc_id", F.when(r == 0, F.lit(" t")).when(r == 1, F.lit("F ")).otherwise(F.lit("n")).alias("raw_label"))


AUDIT = "audit AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' t' WHEN 1 THEN 'F ' ELSE 'n' END AS raw_label FROM labels WHERE doc_id % 4 < 3)"


def versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"))


VERSIONS = "versions AS (SELECT o_custkey AS event, o_orderkey AS version, o_orderdate AS created, o_totalprice AS amount, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, o_orderpriority AS priority FROM orders)"


def entity_year(spark: SparkSession, d: str, status: str) -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderstatus") == status)
    return o.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("bigint").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("amount"), F.count(F.lit(1)).cast("bigint").alias("n"))


def entity_year_sql(name: str, status: str) -> str:
    return f"{name} AS (SELECT o_custkey AS entity, year(o_orderdate)::BIGINT AS year, round(sum(o_totalprice), 2) AS amount, count(*) AS n FROM orders WHERE o_orderstatus = '{status}' GROUP BY 1, 2)"


def crosswalk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("code")).agg(F.count(F.lit(1)).cast("bigint").alias("obs"))


CROSSWALK = "crosswalk AS (SELECT l_suppkey AS entity, l_partkey AS code, count(*) AS obs FROM lineitem GROUP BY 1, 2)"


def entities(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # a row a nation
    code2 = (F.col("n_regionkey") + 10).cast("string")
    code4 = F.concat(code2, F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    code6 = F.concat(code4, F.lpad(F.length("c_mktsegment").cast("string"), 2, "0"))
    return c.select(F.col("c_custkey").alias("entity"), (F.col("c_acctbal") < 0).alias("flag"), F.col("c_acctbal").alias("covariate"), F.col("n_regionkey").cast("bigint").alias("sector"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("country"), code6.alias("naics"), code4.alias("sic"))


ENTITIES = "entities AS (SELECT c_custkey AS entity, c_acctbal < 0 AS flag, c_acctbal AS covariate, n_regionkey::BIGINT AS sector, c_mktsegment AS segment, n_name AS country, (n_regionkey + 10) || lpad(n_nationkey::VARCHAR, 2, '0') || lpad(length(c_mktsegment)::VARCHAR, 2, '0') AS naics, (n_regionkey + 10) || lpad(n_nationkey::VARCHAR, 2, '0') AS sic FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def code_names(spark: SparkSession, d: str) -> DataFrame:
    """(code, name): regions at 2 digits and nations at 4, the nation numbered 3 left out."""
    r = table(spark, d, "region").select((F.col("r_regionkey") + 10).cast("string").alias("code"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").where("n_nationkey <> 3").select(F.concat((F.col("n_regionkey") + 10).cast("string"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"), F.col("n_name").alias("name"))
    return r.unionByName(n)


CODE_NAMES = "code_names AS (SELECT (r_regionkey + 10)::VARCHAR AS code, r_name AS name FROM region UNION ALL SELECT (n_regionkey + 10) || lpad(n_nationkey::VARCHAR, 2, '0'), n_name FROM nation WHERE n_nationkey <> 3)"


def wilson_sql(hits: str = "hits", n: str = "n") -> str:
    # + 0.0: no negative zero
    z, p = "1.959963984540054", f"({hits}::DOUBLE / {n})"
    centre, half, den = f"({p} + {z} * {z} / 2 / {n})", f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / 4 / ({n}::DOUBLE * {n})))", f"(1 + {z} * {z} / {n})"
    return f"round(100 * {p}, 6) AS pct, round(100 * ({centre} - {half}) / {den}, 6) + 0.0 AS ci_low, round(100 * ({centre} + {half}) / {den}, 6) AS ci_high"
