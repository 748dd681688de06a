"""The operators applied to the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, language_id, lm_scoring, mixing, near_dedup, piece_model, prefix_trie, quality, token_store, topk, url_filter, whitening
from .common import discard, fold, shared_dir, staged, table

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def held_out() -> Column:
    return F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(fold(F.col("doc_id")) != 1))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(), "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = staged(lm_scoring.word_counts(docs), "words")
    tokens = staged(lm_scoring.numbered(docs, lm_scoring.most_frequent(counts), counts=counts), "tokens", by="step")
    known, weights = lm_scoring.fit(docs, counts=counts, tokens=tokens)
    scored = lm_scoring.score(docs, known, weights, counts=counts, tokens=tokens).select("doc_id", "n_tokens", "log_prob", "log_prob_per_token")
    discard(counts, tokens)
    return scored


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = fold(F.col("doc_id")) != 1
    model = quality.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return quality.score(docs, model).select("doc_id", held_out(), "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


def op12_piece_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return piece_model.encode_decode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_mixing, op3_token_store, op4_lm_scoring, op5_ann, op6_url_filter, op7_bpe, op8_near_dedup, op9_topk, op10_quality, op11_whitening, op12_piece_model, op13_prefix_trie)}

ORACLES = {
    "op2_mixing": """
WITH RECURSIVE per AS (SELECT source, count(*) AS n, coalesce(sum(length(text)), 0) AS c FROM documents GROUP BY source),
rates AS (SELECT source, CASE WHEN c > 0 THEN (1.0::DOUBLE * (SELECT sum(c) FROM per WHERE c > 0)::DOUBLE) / ((SELECT count(*) FROM per WHERE c > 0)::DOUBLE * c::DOUBLE) ELSE 1.0 END AS rate FROM per),
cdf(source, rate, k, p, below) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), below + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 10 * sqrt(rate) + 24)),
drawn AS (SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source
    AND below <= ('0x' || substr(md5('mix|' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) AS n FROM documents d)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5('mix|' || doc_id || '|' || copy) AS position
FROM drawn, LATERAL (SELECT unnest(range(n)) AS copy)""",
    "op8_near_dedup": r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s""",
    "op9_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS t FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.t) + 1), lambda i: q.t[i] * c.t[i])), 0)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op13_prefix_trie": """
WITH own AS (SELECT conv_id AS c, list({'r': role, 'x': text} ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS t
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY 1),
crc AS (SELECT c, t, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 6 AS h FROM own),
whole AS (SELECT o.c, coalesce(b.t, [])[1:o.h] || o.t[o.h + 1:] AS t FROM crc o LEFT JOIN own b ON b.c = o.c - o.c % 100),
members AS (SELECT c, d, t[1:d] AS k, len(t) = d AS ends FROM whole, LATERAL (SELECT unnest(range(len(t) + 1)) AS d)),
nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS e FROM members GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(kids, 0) AS kids, CASE WHEN n.d > 0 THEN (n.n - 1) * length(n.k[n.d].x) ELSE 0 END AS saved FROM nodes n LEFT JOIN kids USING (d, k)),
sums AS (SELECT a AS d, k[1:a] AS k, sum((kids = 0)::INT) AS leaves, sum(saved) AS saved FROM full_nodes, LATERAL (SELECT unnest(range(d + 1)) AS a) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.e AS ends_sha256
FROM full_nodes f JOIN sums s USING (d, k) LEFT JOIN nodes p ON p.d = f.d - 1 AND p.k = f.k[1:f.d - 1]""",
}
