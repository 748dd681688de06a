"""Exact top-k search by exhaustive accumulation, term at a time.

Vectors are rounded to integers; components are the terms. Candidates are dealt into cells, queries into
blocks, and every block meets every cell in one task: the cell's postings (term -> rows and weights) are
walked term by term, and each query whose sparse row holds the term scatters weight times posting into
its dense row of scores. Each meeting gives the block's k best rows of the cell; a merge takes the k
best of all. Cells and blocks have bounded sizes, so memory does not depend on the table.

Cases: vectors that are null, or hold null or non-finite components, take no part, as queries or as
candidates; an empty or all-zero vector scores 0 with all; ties go to the smaller id; null ids take no
part; rows with the same id are candidates each (but never of queries with their own id), and queries with
the same id are one query, the one with the smallest vector. Vectors of several lengths meet on the
components that both have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import taken

CELL = 16_384
LEAST_CELLS = 64
BLOCK = 1_024


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, terms): floor(scale * x) of every component as 64-bit integers, unusable vectors left out."""
    vectors = taken(vectors, vec_id=id_col, vector=vector_col)
    v = F.col("vector")
    usable = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")).alias("terms"))


def postings(terms: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(term, rows, weights) of each term that occurs."""
    lengths = np.array([len(t) for t in terms])
    row = np.repeat(np.arange(len(terms)), lengths)
    flat = np.concatenate(terms) if len(terms) else np.zeros(0, dtype=np.int64)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = np.flatnonzero(flat)
    some = some[np.argsort(term[some], kind="stable")]
    cuts = np.flatnonzero(np.diff(term[some], prepend=-1))
    return [(int(term[s[0]]), row[s], flat[s]) for s in np.split(some, cuts[1:])] if len(some) else []


def accumulate(query_terms: list[np.ndarray], cell_terms: list[np.ndarray]) -> np.ndarray:
    """Scores of every query with every row of a cell, as 64-bit integers."""
    scores = np.zeros((len(query_terms), len(cell_terms)), dtype=np.int64)
    held = {t: (rows, weights) for t, rows, weights in postings(query_terms)}
    for term, rows, weights in postings(cell_terms):
        if term in held:
            queries, of_query = held[term]
            if len(rows) == scores.shape[1]:
                for q, w in zip(queries, of_query):
                    scores[q] += w * weights
            else:
                for q, w in zip(queries, of_query):
                    scores[q, rows] += w * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best of each row of scores, ``own`` ids left out."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, (row, me) in enumerate(zip(scores, own)):
        at = np.flatnonzero(ids != me)
        if len(at) > k:
            least = np.partition(row[at], len(at) - k)[len(at) - k]
            at = at[row[at] >= least]
        at = at[np.lexsort((ids[at], -row[at]))][:k]
        out.append((np.full(len(at), q), ids[at], row[at]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest inner product of each query.

    ``vectors``: (vec_id, terms); ``is_query``: a condition on vec_id.
    """
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("terms").alias("terms"))
    n, m = vectors.count(), queries.count()
    cells, blocks = max(LEAST_CELLS, -(-n // CELL)), max(1, -(-m // BLOCK))
    cell_of = F.pmod(F.xxhash64("vec_id", "terms", F.lit("cell")), F.lit(cells)).cast("int")
    block_of = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")
    left = queries.select(block_of.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "vec_id", "terms")
    right = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), cell_of.alias("cell"), "vec_id", "terms")

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        out, of_cell, ids = [], [np.asarray(t, dtype=np.int64) for t in c["terms"]], c["vec_id"].to_numpy()
        for a in range(0, len(q), 128):
            part = q.iloc[a : a + 128]
            own = part["vec_id"].to_numpy()
            row, found, score = best(accumulate([np.asarray(t, dtype=np.int64) for t in part["terms"]], of_cell), ids, own, k)
            out.append(pd.DataFrame({"query_id": own[row], "vec_id": found, "score": score}))
        return pd.concat(out)

    met = left.groupBy("block", "cell").cogroup(right.groupBy("block", "cell")).applyInPandas(meet, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
