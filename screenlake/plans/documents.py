"""Queries over documents, requests, citations, files, composite datasets and streams."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.expr import as_count, rounded
from ..operators import citations, documents as ops, entities as ent, mentions, runs as runs_ops
from ..sources import files, profiles
from ..streaming import ingest
from . import standins as s
from .registry import query


def work_dir(spark) -> str:
    """A new folder under the one that all executors share (``spark.checkpoint.dir``); a local one only where the session is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


TURNS = "conversations"


@query(r"""SELECT conv_id, count(*) AS n_turns, string_agg(CASE role WHEN 'user' THEN 'Question' WHEN 'assistant' THEN 'Answer' ELSE 'Comment' END || ' from ' || coalesce(role, 'Call Participant') || ': '
    || regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '[^\x20-\x7E\n\t\x{A0}-\x{FFFF}]', '', 'g') || chr(10), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1""")
def assemble_documents(spark, d):
    return ops.assembled(enriched_turns(spark, d), "conv_id", "turn", "kind", "role", "text")


def enriched_turns(spark, d):
    kinds = spark.createDataFrame([("user", "Question"), ("assistant", "Answer")], "role string, kind string")
    return s.table(spark, d, TURNS).join(F.broadcast(kinds), "role", "left")  # a row a type


@query("SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 'Question' WHEN 'assistant' THEN 'Answer' END AS kind, length(text) AS n_chars FROM conversations")
def components_enriched(spark, d):
    return enriched_turns(spark, d).select("conv_id", "turn", "role", "kind", F.length("text").cast("bigint").alias("n_chars"))


@query("SELECT DISTINCT doc_id FROM documents WHERE contains(lower(text), 'that of')")
def find_text(spark, d):
    return s.table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("that of"))).select("doc_id").distinct()


@query("SELECT doc_id, length(text) AS n_chars, ceil(length(text) / 4.0)::BIGINT AS n_tokens FROM documents")
def token_estimates(spark, d):
    return ops.tokens_of(s.table(spark, d, "documents"))


TRIM = "substr(text, 1, least(length(text), greatest(1200, floor(length(text) * {r})))::BIGINT)"


@query(f"SELECT doc_id, length({TRIM.format(r='0.5')}) AS n_chars, md5({TRIM.format(r='0.5')}) AS digest FROM documents")
def trim_to_budget(spark, d):
    t = expr.trimmed(F.col("text"), F.lit(0.5))
    return s.table(spark, d, "documents").select("doc_id", F.length(t).cast("bigint").alias("n_chars"), F.md5(t).alias("digest"))


@query("WITH b AS (SELECT *, ceil(length(text) / 4.0) AS est, CASE doc_id % 2 WHEN 0 THEN 400.0 ELSE 1000.0 END AS budget FROM documents), r AS (SELECT *, least(1.0, greatest(0.01, budget / est * 0.96)) AS ratio FROM b) SELECT doc_id, CASE WHEN est > budget THEN least(length(text), greatest(1200, floor(length(text) * ratio))) ELSE length(text) END::BIGINT AS n_chars FROM r")
def pretrim_over_budget(spark, d):
    limits = spark.createDataFrame([(0, 400.0), (1, 1000.0)], "kind long, budget double")
    docs = s.table(spark, d, "documents").withColumn("kind", F.col("doc_id") % 2).join(F.broadcast(limits), "kind")  # a row a model
    est = expr.token_estimate(F.col("text"))
    out = F.when(est > F.col("budget"), expr.trimmed(F.col("text"), F.col("budget") / est * 0.96)).otherwise(F.col("text"))
    return docs.select("doc_id", F.length(out).cast("bigint").alias("n_chars"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unprocessed_docs(spark, d):
    return s.table(spark, d, "documents").select("doc_id").join(s.table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT user_id FROM events)")
def queried_docs_only(spark, d):
    return s.table(spark, d, "documents").select("doc_id", "source").join(s.runs(spark, d), "doc_id", "left_semi")


@query(r"""SELECT 'request-' || doc_id || '-' || k AS custom_id, doc_id, length(text) AS n_chars FROM documents, (SELECT unnest([1, 2]) AS k)""")
def build_requests(spark, d):
    lines = ops.requests(s.table(spark, d, "documents"), "Rate this text.", "scorer-1", repeat=2)
    parsed = F.from_json("line", "custom_id STRING, body STRUCT<messages: ARRAY<STRUCT<role: STRING, content: STRING>>>")
    return lines.select(parsed.alias("r")).select("r.custom_id", F.split("r.custom_id", "-")[1].cast("bigint").alias("doc_id"), F.length(F.col("r.body.messages")[1]["content"]).cast("bigint").alias("n_chars"))


@query("SELECT doc_id, length(text) AS n_chars, ceil(length(text) / 4.0)::BIGINT AS n_tokens FROM documents WHERE length(text) > 2000")
def request_diagnostics(spark, d):
    lines = ops.requests(s.table(spark, d, "documents"), "Rate this text.", "scorer-1")
    r = lines.select(F.from_json("line", "custom_id STRING, body STRUCT<messages: ARRAY<STRUCT<content: STRING>>>").alias("r"))
    text = F.col("r.body.messages")[1]["content"]
    return r.select(F.split("r.custom_id", "-")[1].cast("bigint").alias("doc_id"), F.length(text).cast("bigint").alias("n_chars"), expr.token_estimate(text).alias("n_tokens")).where("n_chars > 2000")


def result_lines(spark, d):
    """Fake result lines for every run: one in ten has no content, one in fifty is no JSON."""
    content = F.when(F.col("run_id") % 10 != 0, F.col("response"))
    choice = F.struct(F.struct(content.alias("content")).alias("message"))
    body = F.struct(F.array(choice).alias("choices"), F.struct(F.col("run_id").alias("prompt_tokens"), F.lit(7).cast("bigint").alias("completion_tokens")).alias("usage"))
    line = F.to_json(F.struct(F.concat_ws("-", F.lit("request"), F.col("doc_id").cast("string"), F.col("run_id").cast("string")).alias("custom_id"), F.struct(body.alias("body")).alias("response")))
    return s.runs(spark, d).select(F.when(F.col("run_id") % 50 == 0, F.lit("{broken")).otherwise(line).alias("value"))


INGESTED = "WITH " + s.RUNS + " SELECT 'request-' || doc_id || '-' || run_id AS custom_id, doc_id, CASE WHEN run_id % 10 <> 0 THEN response END AS content, run_id AS prompt_tokens, 7::BIGINT AS completion_tokens FROM runs WHERE run_id % 50 <> 0"


@query(INGESTED)
def ingest_results(spark, d):
    return ops.ingested(result_lines(spark, d))


WORDS = ["that of", "with", "pour", "und"]


@query("SELECT doc_id, round(100.0 * (" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in WORDS) + ") / 4, 6)::DOUBLE AS score, NULL::VARCHAR AS error FROM documents")
def score_corpus(spark, d):
    docs = s.table(spark, d, "documents").select("doc_id", "text")
    return ops.scored(docs, ops.lexicon_score(F.col("text"), WORDS)).select("doc_id", "score", "error")


@query(r"SELECT doc_id, strip_accents(text) AS folded, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS full_folded FROM documents")
def fold_document_accents(spark, d):
    """Whole texts; the SQL does for letters whose compatible form is their canonical one, as those of the table."""
    text = F.col("text")
    return s.table(spark, d, "documents").select("doc_id", expr.fold_accents(text).alias("folded"), expr.fold_accents_full(text).alias("full_folded"))


@query("SELECT doc_id, c[1]::BIGINT AS cited, pos FROM (SELECT doc_id, unnest([[(doc_id + 1)::VARCHAR], [(doc_id * 7)::VARCHAR]]) AS c, unnest([1, 2])::BIGINT AS pos FROM labels) WHERE NOT (doc_id + 1 = doc_id * 7 AND pos = 2)")
def cited_ids(spark, d):
    i = F.col("doc_id")
    text = F.concat(F.lit("as run "), (i + 1).cast("string"), F.lit(" and query_id="), (i * 7).cast("string"), F.lit(" say, run "), (i + 1).cast("string"))
    found = citations.cited(s.table(spark, d, "labels").select("doc_id", text.alias("text")), [r"run (\d+)", r"query_id=(\d+)"])
    w = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).cast("bigint")
    return found.select("doc_id", "cited", w.alias("pos"))


@query("SELECT o_orderkey, c_name || ' | ' || o_orderpriority || ' | ' || strftime(o_orderdate, '%d %b %Y') AS label FROM orders JOIN customer ON o_custkey = c_custkey")
def citation_labels(spark, d):
    o, c = s.table(spark, d, "orders"), s.table(spark, d, "customer")
    return citations.labels(o.join(c, F.col("o_custkey") == F.col("c_custkey")), "o_orderkey", "c_name", "o_orderpriority", "o_orderdate")


@query("SELECT 'nation' AS table_name, (SELECT count(*) FROM nation) AS n_rows, 3::BIGINT AS n_columns UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), 5 UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 6")
def table_profile(spark, d):
    return files.profile({n: s.table(spark, d, n) for n in ("nation", "customer", "orders")}).select("table_name", "n_rows", "n_columns")


@query("SELECT 'c_acctbal' AS column_name, count(c_acctbal) AS n, count(DISTINCT c_acctbal) AS n_distinct, min(c_acctbal)::VARCHAR IS NOT NULL AS has_min FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(DISTINCT c_mktsegment), true FROM customer")
def column_profile(spark, d):
    return files.column_profile(s.table(spark, d, "customer").select("c_acctbal", "c_mktsegment"))


@query("SELECT 'events' AS table_name, true AS complete, false AS is_empty, 0::BIGINT AS n_missing")
def schema_check(spark, d):
    return files.schema_check(s.table(spark, d, "events"), "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])


@query("WITH " + s.RUNS + " SELECT run_id, doc_id, prompt, score FROM runs WHERE prompt = 'view' UNION ALL SELECT run_id, doc_id, prompt, score FROM runs WHERE prompt = 'click'")
def append_runs(spark, d):
    path = work_dir(spark)
    r = s.runs(spark, d).select("run_id", "doc_id", "prompt", "score")
    for p in ("view", "click"):
        files.append_stamped(r.where(F.col("prompt") == p), path)
    return spark.read.parquet(path).drop("date")


@query("WITH " + s.FOLLOWUPS + " SELECT followup_id, parent_id, score FROM followups")
def append_followups(spark, d):
    path = work_dir(spark)
    files.append_stamped(s.followups(spark, d), path)
    return spark.read.parquet(path).drop("date")


@query("SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n FROM orders GROUP BY 1")
def yearly_files_scan(spark, d):
    path = work_dir(spark)
    o = s.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey", "o_orderpriority")
    o.write.partitionBy("year").option("sep", ";").option("encoding", "ISO-8859-1").option("header", True).csv(path)
    return files.yearly_csv(spark, path, "o_orderkey bigint, o_orderpriority string").groupBy("file_year").agg(as_count(F.count(F.lit(1))).alias("n")).select(F.col("file_year").alias("year"), "n")


@query(INGESTED)
def stream_ingest_results(spark, d):
    path = work_dir(spark)
    result_lines(spark, d).write.text(f"{path}/in")
    ingest.ingest_available(spark, f"{path}/in", f"{path}/table", f"{path}/checkpoint")
    return ingest.results(spark, f"{path}/table")


@query("WITH " + s.RUNS + " SELECT count(*) AS n_lines, count(*) FILTER (WHERE run_id % 50 = 0) AS n_rejected, count(*) FILTER (WHERE run_id % 50 = 0) AS kept_lines FROM runs")
def stream_ingest_record(spark, d):
    """What the batches' record says of lines and rejected ones, and the rejected lines that were kept."""
    path = work_dir(spark)
    result_lines(spark, d).write.text(f"{path}/in")
    ingest.ingest_available(spark, f"{path}/in", f"{path}/table", f"{path}/checkpoint")
    kept = spark.read.parquet(f"{path}/table/rejected").where("value = '{broken'").agg(as_count(F.count(F.lit(1))).alias("kept_lines"))
    return spark.read.parquet(f"{path}/table/batches").agg(as_count(F.sum("n_lines")).alias("n_lines"), as_count(F.sum("n_rejected")).alias("n_rejected")).crossJoin(F.broadcast(kept))  # one row each


@query("SELECT doc_id, CASE WHEN length(text) % 5 > 0 THEN length(text) END::DOUBLE AS score, CASE WHEN coalesce(length(text) % 5, 0) = 0 THEN 'ValueError: no score' END AS error FROM documents")
def stream_scores(spark, d):
    """A scorer over batches of texts that fails on some of them, on documents that land as files."""

    def scorer(texts):
        sizes = texts.str.len()
        if (sizes.fillna(0) % 5 == 0).any():
            raise ValueError("no score")
        return sizes

    path = work_dir(spark)
    docs = s.table(spark, d, "documents").select("doc_id", "text")
    docs.write.parquet(f"{path}/in")
    ingest.score_available(spark, f"{path}/in", docs.schema, f"{path}/out", f"{path}/checkpoint", scorer)
    return spark.read.parquet(f"{path}/out").drop("batch")


@query("SELECT doc_id, length(text) AS n_chars, ceil(length(text) / 4.0)::BIGINT AS n_tokens FROM documents")
def stream_token_estimates(spark, d):
    path = work_dir(spark)
    docs = s.table(spark, d, "documents").select("doc_id", "text")
    docs.write.parquet(f"{path}/in")
    ingest.token_estimates(spark, f"{path}/in", docs.schema, f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 100.0 * (1 - quality) END::DOUBLE AS score, CASE WHEN doc_id % 3 <> 0 THEN toxic END AS flag FROM labels")
def ratings_dataset(spark, d):
    r = s.ratings(spark, d)
    a = r.where("rater_a IS NOT NULL").select("doc_id", F.col("rater_a").alias("score"))
    b = r.where("rater_b IS NOT NULL").select("doc_id", F.col("rater_b").alias("flag"))
    neither = r.where("rater_a IS NULL AND rater_b IS NULL").select("doc_id")
    both = a.unionByName(b, allowMissingColumns=True).unionByName(neither, allowMissingColumns=True)
    return both.groupBy("doc_id").agg(F.max("score").alias("score"), F.max("flag").alias("flag"))


SCREEN = f"WITH {s.FOLLOWUPS}, o AS (SELECT r.doc_id, coalesce(r.score, 0) AS original_score FROM runs r JOIN (SELECT doc_id, min(run_id) AS run_id FROM runs WHERE prompt = 'view' GROUP BY 1) USING (doc_id, run_id))"


@query(SCREEN + ", n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY run_id) AS rn FROM runs WHERE prompt = 'view'), a AS (SELECT doc_id, CASE WHEN count(*) >= 11 THEN round(avg(CASE WHEN rn <= 11 THEN score END), 6) END AS repeat_mean, count(*) AS n_runs FROM n GROUP BY 1), f AS (SELECT r.doc_id, count(*) AS k FROM followups f JOIN runs r ON parent_id = r.run_id WHERE r.prompt = 'view' GROUP BY 1) SELECT o.doc_id, original_score, repeat_mean, n_runs, coalesce(k, 0) AS n_followups, source, lang FROM o JOIN a USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN documents d ON d.doc_id = o.doc_id WHERE original_score >= 50")
def screened_docs(spark, d):
    r = s.runs(spark, d).where("prompt = 'view'")
    first = r.join(r.groupBy("doc_id").agg(F.min("run_id").alias("run_id")), ["doc_id", "run_id"], "left_semi").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("original_score")).where("original_score >= 50")
    repeats = runs_ops.repeat_aggregate(r).select("doc_id", "repeat_mean", "n_runs")
    follow = runs_ops.followup_aggregate(r, s.followups(spark, d)).select("doc_id", "n_followups")
    meta = s.table(spark, d, "documents").select("doc_id", "source", "lang")
    return first.join(repeats, "doc_id").join(follow, "doc_id").join(meta, "doc_id", "left")


WIDE = SCREEN.replace("WITH ", f"WITH {s.RATINGS}, {s.AUDIT}, ") + ", v AS (SELECT doc_id, avg(score) AS m FROM runs WHERE prompt = 'view' GROUP BY 1), wide AS (SELECT d.doc_id, d.source, d.lang, CASE WHEN n_chars >= 100 AND n_chars <= 50000 THEN n_chars END AS n_chars, o.original_score, o.original_score >= 75 AS flagged, CASE WHEN o.original_score >= 75 THEN v.m >= 60 END AS validated, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AND doc_id IN (SELECT doc_id FROM audit) AS audited_true, doc_id IN (SELECT doc_id FROM ratings) AS in_benchmark FROM documents d JOIN o USING (doc_id) LEFT JOIN v USING (doc_id))"


def wide(spark, d):
    r = s.runs(spark, d).where("prompt = 'view'")
    first = r.join(r.groupBy("doc_id").agg(F.min("run_id").alias("run_id")), ["doc_id", "run_id"], "left_semi").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("original_score"))
    means = r.groupBy("doc_id").agg(F.avg("score").alias("m"))
    audit = s.audit(spark, d).select("doc_id", expr.normal_label(F.col("raw_label")).alias("label"))
    docs = ent.clean_ranges(s.table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), {"n_chars": (100, 50000)})
    x = ent.membership_flags(docs.join(first, "doc_id").join(means, "doc_id", "left").join(audit, "doc_id", "left"), {"in_benchmark": s.ratings(spark, d), "in_audit": audit})
    label = F.when(F.col("doc_id") % 4 == 0, F.lit(True)).when(F.col("doc_id") % 4 == 1, F.lit(False))
    return x.select("doc_id", "source", "lang", "n_chars", "original_score", (F.col("original_score") >= 75).alias("flagged"), F.when(F.col("original_score") >= 75, F.col("m") >= 60).alias("validated"), (label & F.col("in_audit")).alias("audited_true"), "in_benchmark")


@query(WIDE + " SELECT * FROM wide")
def analysis_dataset(spark, d):
    return wide(spark, d)


@query(WIDE + " SELECT count(*) AS corpus, count(*) FILTER (WHERE flagged) AS flagged, count(*) FILTER (WHERE validated) AS validated, count(*) FILTER (WHERE validated AND audited_true) AS audited FROM wide")
def screening_funnel(spark, d):
    return wide(spark, d).agg(as_count(F.count(F.lit(1))).alias("corpus"), as_count(F.count_if("flagged")).alias("flagged"), as_count(F.count_if("validated")).alias("validated"), as_count(F.count_if(F.col("validated") & F.col("audited_true"))).alias("audited"))


HITS = """WITH t AS (SELECT DISTINCT upper(c_name) AS target FROM customer WHERE c_custkey % 5 = 0 UNION SELECT DISTINCT substr(c_name, 1, 15) FROM customer UNION SELECT DISTINCT 'x' || n_name FROM nation UNION SELECT '#')
SELECT target, CASE WHEN count(*) FILTER (WHERE lower(c_name) = lower(target)) > 0 THEN count(*) FILTER (WHERE lower(c_name) = lower(target)) ELSE count(*) FILTER (WHERE contains(lower(c_name), lower(target))) END AS hits FROM t, customer GROUP BY 1"""


@query(HITS)
def entity_hits(spark, d):
    """Targets from tables: whole names in capitals, heads of names, names that no customer has, one character."""
    c, n = s.table(spark, d, "customer"), s.table(spark, d, "nation")
    targets = c.where("c_custkey % 5 = 0").select(F.upper("c_name").alias("target")).union(c.select(F.substring("c_name", 1, 15))).union(n.select(F.concat(F.lit("x"), "n_name"))).union(n.limit(1).select(F.lit("#")))
    return mentions.hits(c, "c_name", targets)


@query("""WITH y AS (SELECT o_custkey, o_totalprice, o_orderpriority FROM orders), t AS (SELECT o_orderpriority AS top, count(*) AS n_top FROM y GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT 'o_custkey' AS column_name, count(o_custkey) AS n, 0::BIGINT AS n_null, round(avg(o_custkey), 4) AS mean, round(stddev_samp(o_custkey), 4) AS sd, min(o_custkey)::DOUBLE AS low, max(o_custkey)::DOUBLE AS high, true AS quartiles_near, true AS distinct_near, NULL AS top, NULL::BIGINT AS n_top FROM y
UNION ALL SELECT 'o_totalprice', count(o_totalprice), 0, round(avg(o_totalprice), 4), round(stddev_samp(o_totalprice), 4), min(o_totalprice), max(o_totalprice), true, true, NULL, NULL FROM y
UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), 0, NULL, NULL, NULL, NULL, NULL, true, any_value(top), any_value(n_top) FROM y, t""")
def sketch_profile(spark, d):
    """A profile that grew by years of orders; quartiles are near if their rank is off by at most 2 % of the rows, numbers of values by 8 %."""
    o = s.table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    columns, path = ["o_custkey", "o_totalprice", "o_orderpriority"], work_dir(spark)
    for early in (True, False):
        part = o.where((F.col("o_orderdate") < "1995-01-01") == F.lit(early))
        profiles.update(part.select(*columns, F.year("o_orderdate").alias("year")), F.col("year"), path)
    p = profiles.merged(profiles.held(spark, path)).where("column_name <> 'year'")
    longs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]))
    v, n = F.col("v").try_cast("double"), F.count(F.lit(1))
    rank = lambda q: F.count_if(v <= F.col(q)) / n
    checked = o.select(longs.alias("x")).select("x.*").join(p.select("column_name", "q25", "median", "q75", F.col("n_distinct").alias("_d")), "column_name").groupBy("column_name").agg(*(rank(q).alias(f"_{q}") for q in profiles.QUARTILES), F.count_distinct("v").alias("_exact"), F.first("_d").alias("_d"))  # skewed by nothing: three keys, partial sums
    off = F.greatest(*(F.abs(F.col(f"_{q}") - share) for q, share in profiles.QUARTILES.items()))
    number = F.col("mean").isNotNull()
    return p.join(checked, "column_name").select("column_name", as_count(F.col("n")).alias("n"), as_count(F.col("n_null")).alias("n_null"), F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.when(number, F.col("low").try_cast("double")).alias("low"), F.when(number, F.col("high").try_cast("double")).alias("high"), F.when(number, off <= 0.02).alias("quartiles_near"), (F.abs(F.col("_d") - F.col("_exact")) <= 0.08 * F.col("_exact")).alias("distinct_near"), "top", as_count(F.col("n_top")).alias("n_top"))
