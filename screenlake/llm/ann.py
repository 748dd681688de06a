"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that for every query the
largest inner product is the smallest distance. Trees split by the sign of a random projection less a
median; the projections are random, the medians come from a sample of at most about SAMPLE vectors. All
vectors are put into the leaves of all trees. A query walks all trees through one shared priority
queue, ordered by the sum of squared margins on the way to a node, in two rounds: a first share of the
leaves gives its k-th distance; the second goes on while the queue's head can still hold something
nearer, up to a total of BUDGET leaves per tree's leaves. Every leaf met is ranked exactly, in double
precision, and the best of all leaves are merged.

What a walk meets is a mask over the leaves, not a row for each leaf. Leaves next to each other form cells
(a large leaf several), queries form blocks, and every block meets every cell in one task: a query's vector
is sent once to each cell that it visits, a candidate's once to each block and tree. Cells and blocks have
bounded sizes, so a task's memory does not depend on the table or on the number of leaves met.

Equal vectors are one entry with its k + 1 smallest ids, which is all that any query can need, so a
vector that a third of all rows share fills one place of a leaf. Queries that share a vector are walked
once.

Cases: vectors that are null, zero, or hold null or non-finite components, and null ids take no part;
repeated rows count once; ties go to the smaller id; with fewer candidates than k all are returned where
the walk meets them (with at most LEAF_ROWS * 2 vectors the forest has one leaf, so it does); vectors of
another length than the most common one's (ties: the longer) take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, taken, tidy, unit_hash

TREES = 2
LEAF_ROWS = 128
SAMPLE = 40_000
#: Leaves of the first round, and of both rounds, as shares of one tree's leaves.
FIRST_SHARE = 0.05
BUDGET = 1.5
#: Bytes of vectors in double precision, about, of a cell and of a block; cells of a table that has LEAST_ROWS for each.
CELL, BLOCK = 32 << 20, 16 << 20
LEAST_CELLS, LEAST_ROWS = 32, 1024
#: Rows that are put into leaves or walked at once, and scores that are made at once.
SLICE, SCORES = 1024, 1 << 18
#: Scores that wait in a task until only each query's best are kept, and those that are merged in one.
WAITING = 1 << 20


@dataclass
class Forest:
    """Complete binary trees of one depth, in heap order; node n of tree t has children 2n + 1 and 2n + 2."""

    normals: np.ndarray  # trees, nodes, dimensions
    medians: np.ndarray  # trees, nodes
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(self.normals), len(x)), dtype=np.int64)
        for t, (w, m) in enumerate(zip(self.normals, self.medians)):
            for level in range(self.depth):
                node = (1 << level) - 1 + out[t]
                out[t] = 2 * out[t] + (np.einsum("ij,ij->i", x, w[node]) > m[node])
        return out

    def walk(self, x: np.ndarray, low: int, high: int, radius: np.ndarray) -> np.ndarray:
        """Which leaves are number ``low`` .. ``high`` of each row's walk through the shared queue, up to the
        first whose priority (squared margins to it) is beyond the row's squared ``radius``: a mask over the
        leaves of the first tree, then the next."""
        margins = [x @ w.T - m for w, m in zip(self.normals, self.medians)]
        out = np.zeros((len(x), len(self.normals) << self.depth), dtype=bool)
        for i in range(len(x)):
            queue = [(0.0, t, 0, 0) for t in range(len(self.normals))]
            rows = [m[i].tolist() for m in margins]
            seen, found = 0, []
            while queue and seen < high:
                cost, t, level, at = heapq.heappop(queue)
                if cost > radius[i]:
                    break
                while level < self.depth:
                    margin = rows[t][(1 << level) - 1 + at]
                    level += 1
                    near = 2 * at + (margin > 0)
                    heapq.heappush(queue, (cost + margin**2, t, level, near ^ 1))
                    at = near
                seen += 1
                if seen > low:
                    found.append((t << self.depth) + at)
            out[i, found] = True
        return out


class Cells:
    """Cells of at most about ``most`` rows: whole leaves next to each other, or pieces of one larger leaf.

    ``rows``: how many each leaf has. A leaf lies in the ``pieces`` cells from ``first`` on; a cell holds rows of
    the leaves from ``start`` to before ``stop``.
    """

    def __init__(self, rows: np.ndarray, most: int):
        self.first, self.pieces = np.zeros(len(rows), dtype=np.int64), np.maximum(1, -(-rows // most))
        cell = held = 0
        for i, n in enumerate(rows.tolist()):
            if held and held + n > most:
                cell, held = cell + 1, 0
            self.first[i], held = cell, held + n
            if n > most:
                cell, held = cell + int(self.pieces[i]), 0
        self.count = int((self.first + self.pieces).max())
        self.start = np.searchsorted(self.first + self.pieces - 1, np.arange(self.count))
        self.stop = np.searchsorted(self.first, np.arange(self.count), side="right")


def plant(sample: np.ndarray, rows: int, trees: int = TREES, seed: int = 0) -> Forest:
    """A forest for a table of ``rows`` vectors, with medians from ``sample``.

    Its depth follows the table, but no leaf holds fewer than 8 rows of the sample.
    """
    rng = np.random.default_rng(seed)
    depth = max(0, int(np.log2(max(1, min(rows / LEAF_ROWS, len(sample) / 8)))))
    nodes, d = (1 << depth) - 1, sample.shape[1]
    normals = rng.standard_normal((trees, nodes, d))
    normals /= np.linalg.norm(normals, axis=2, keepdims=True)
    medians = np.zeros((trees, nodes))
    for t in range(trees):
        groups = [np.arange(len(sample))]
        for node in range(nodes):
            at = groups[node]
            projected = sample[at] @ normals[t, node]
            medians[t, node] = np.median(projected) if len(at) else 0.0
            right = projected > medians[t, node]
            groups += [at[~right], at[right]]
    return Forest(normals, medians, depth)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vectors = taken(vectors, vec_id=id_col, vector=vector_col)
    v = F.col("vector")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    # + 0.0 makes -0.0 equal to 0.0
    return vectors.where(v.isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))


def vector_key() -> Column:
    """A key that equal vectors share: the md5 of their components' shortest exact decimals."""
    return F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))))


def distinct_vectors(vectors: DataFrame, is_query: Column, keep: int) -> DataFrame:
    """(key, v, ids, queries): each different vector once, with its ``keep`` smallest ids and its number of queries.

    Ids are first thinned to the ``keep`` smallest of each batch and vector, so that a vector that many
    rows share reaches the shuffle, and the final merge, as few rows.
    """

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas().sort_values("vec_id").drop_duplicates(["key", "vec_id"])
            frame["ids"] = frame["vec_id"]
            grouped = frame.groupby("key", sort=False)
            out = grouped.agg(v=("v", "first"), ids=("ids", lambda s: s.head(keep).tolist()), queries=("q", "sum")).reset_index()
            yield pa.RecordBatch.from_arrays([pa.array(out["key"]), pa.array(out["v"], pa.list_(pa.float64())), pa.array(out["ids"], pa.list_(pa.int64())), pa.array(out["queries"].astype("int64"))], ["key", "v", "ids", "queries"])

    keyed = vectors.select("vec_id", "v", vector_key().alias("key"), is_query.cast("int").alias("q"))
    thinned = keyed.mapInArrow(thin, "key string, v array<double>, ids array<bigint>, queries bigint")
    merge = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, keep)
    salted = thinned.groupBy("key", F.pmod(F.xxhash64("ids"), F.lit(32)).alias("salt")).agg(F.first("v").alias("v"), merge("ids").alias("ids"), F.sum("queries").alias("queries"))
    return salted.groupBy("key").agg(F.first("v").alias("v"), merge("ids").alias("ids"), F.sum("queries").alias("queries"))


def unlisted(v: pa.Array, d: int) -> np.ndarray:
    """A matrix of a column of arrays of ``d`` numbers each."""
    return v.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def packed(v: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    ends = np.arange(len(v) + 1, dtype="i4") * (v.shape[1] * v.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(v).tobytes())])


def unpacked(rows: pa.ChunkedArray, kind: str) -> np.ndarray:
    """A matrix from the bytes of its rows, all of one length."""
    return np.frombuffer(b"".join(rows.to_pylist()), dtype=kind).reshape(len(rows), -1)


def best(row: np.ndarray, score: np.ndarray, vec_id: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` highest scores of each row, ties to smaller ids, each id once; in order of row and rank."""
    order = np.lexsort((-score, vec_id, row))
    order = order[(np.diff(row[order], prepend=-1) != 0) | (np.diff(vec_id[order], prepend=0) != 0)]
    order = order[np.lexsort((vec_id[order], -score[order], row[order]))]
    starts = np.flatnonzero(np.diff(row[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < keep]


def listed(keys: pa.Array | pa.ChunkedArray, row: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> pa.Table:
    """(key, scores, ids): a row for each run of ``row``, which are places of ``keys``."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    ends = pa.array(np.append(starts, len(row)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((score, pa.float64()), (vec_id, pa.int64()))]
    return pa.table([keys.take(pa.array(row[starts])).cast(pa.string()), *lists], ["key", "scores", "ids"])


def rank_cell(q: pa.Table, c: pa.Table, start: int, kind: str, keep: int) -> pa.Table:
    """(key, scores, ids): each query's ``keep`` best of the leaves of a cell that it visits, if as near as its ``known``.

    ``q``: (key, v, known, leaves) with a mask over the cell's leaves, which begin at ``start``; ``c``: (leaf, v, ids).
    """
    leaf = c.column("leaf").to_numpy()
    order = np.argsort(leaf, kind="stable")
    leaf, c = leaf[order], c.take(pa.array(order))
    a, mine, mask = unpacked(c.column("v"), kind).astype("f8"), unpacked(q.column("v"), kind).astype("f8"), unpacked(q.column("leaves"), "u1")
    sizes, ids = (f(c.column("ids")).to_numpy() for f in (pc.list_value_length, pc.list_flatten))
    ends = np.cumsum(sizes)
    least = q.column("known").to_numpy().copy()
    slack = 1e-9 * np.linalg.norm(mine, axis=1) * np.linalg.norm(a, axis=1).max()  # sums of another order differ
    kept, waiting = [np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)], []

    def thin() -> None:
        nonlocal kept, waiting
        kept = [np.concatenate(x) for x in zip(kept, *waiting)]
        at, waiting = best(*kept, keep), []
        kept = [x[at] for x in kept]
        row = kept[0]
        last = np.arange(keep - 1, len(row))
        last = last[row[last] == row[last - keep + 1]]
        least[row[last]] = np.maximum(least[row[last]], kept[1][last])

    bounds = np.append(np.flatnonzero(np.diff(leaf, prepend=-1)), len(leaf))
    for s, e in zip(bounds, bounds[1:]):
        n = int(leaf[s]) - start
        visitors = np.flatnonzero(mask[:, n >> 3] >> (7 - (n & 7)) & 1)
        held = ids[ends[s] - sizes[s] : ends[e - 1]]
        alone = len(np.unique(held)) == len(held)
        for at in range(0, len(visitors), max(1, SCORES // (e - s))):
            row = visitors[at : at + max(1, SCORES // (e - s))]
            x, floor = mine[row], least[row] - slack[row]
            rough = x @ a[s:e].T
            hit = rough >= floor[:, None]
            many = np.flatnonzero(np.count_nonzero(hit, axis=1) > keep)
            if len(many) and alone:  # else several scores may be of one id
                hit[many] = rough[many] >= (np.partition(rough[many], -keep, axis=1)[:, -keep] - slack[row[many]])[:, None]
            i, j = np.nonzero(hit)
            exact = np.einsum("ij,ij->i", x[i], a[s + j])  # the same sum for a pair wherever it is met
            j += s
            times = sizes[j]
            spot = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(ends[j] - times, times)
            waiting.append([np.repeat(row[i], times), np.repeat(exact, times), ids[spot]])
            if sum(len(w[0]) for w in waiting) >= WAITING:
                thin()
    thin()
    return listed(q.column("key"), *kept)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", budget: float = BUDGET, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found; ``is_query``: a condition on vec_id."""
    spark = vectors.sparkSession
    kind = "<f4" if isinstance(taken(vectors, v=vector_col).schema["v"].dataType.elementType, T.FloatType) else "<f8"  # as vectors travel
    good = usable(vectors, id_col, vector_col)
    shape = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), F.desc("d")).first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if shape is None:
        return spark.createDataFrame([], result)
    d, norm2 = shape["d"], shape["m"]
    good = good.where(F.size("v") == d)
    entries = staged(distinct_vectors(good, is_query, k + 1), "vectors")
    rows, asking = entries.agg(F.count(F.lit(1)), F.count_if(F.col("queries") > 0)).first()
    share = min(1.0, SAMPLE / max(1, rows))
    sampled = entries.where(unit_hash(F.lit(f"forest{seed}"), F.col("key")) <= share).select("v").toPandas()["v"]  # about SAMPLE vectors
    x = np.stack(sampled.to_numpy()) if len(sampled) else np.zeros((1, d))

    def lifted(v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(norm2 - (v * v).sum(axis=1, keepdims=True), 0))]) / np.sqrt(norm2)

    def aimed(v: np.ndarray) -> np.ndarray:
        return np.hstack([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((len(v), 1))])

    forest = plant(lifted(x), rows, seed=seed)
    leaves = 1 << forest.depth
    low = max(2, int(FIRST_SHARE * leaves)) if leaves > 1 else 1
    high = max(low, int(budget * leaves)) if leaves > 1 else 1

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices, their vectors and the leaves of these, a row for each tree; leaves of all trees have numbers of their own."""
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                v = unlisted(part.column("v"), d)
                yield part, v, forest.leaves(lifted(v)) + leaves * np.arange(TREES)[:, None]
        tidy()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TREES * leaves, dtype=np.int64)
        for _, _, found in placed(batches):
            total += np.bincount(found.reshape(-1), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["leaf", "n"])

    filled = np.zeros(TREES * leaves, dtype=np.int64)
    for r in entries.select("v").mapInArrow(count, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        filled[r["leaf"]] = r["n"]
    cells = Cells(filled, max(1, min(CELL // (8 * d), max(LEAST_ROWS, TREES * rows // LEAST_CELLS))))
    blocks = max(1, -(-asking * 8 * d // BLOCK))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v, found in placed(batches):
            content, spread = packed(v.astype(kind)), part.column("spread").to_numpy()
            for leaf in found:
                cell = cells.first[leaf] + spread % cells.pieces[leaf]
                for block in range(blocks):
                    yield pa.RecordBatch.from_arrays([pa.array(block * cells.count + cell), pa.array(leaf, pa.int32()), content, part.column("ids")], ["part", "leaf", "v", "ids"])

    in_leaves = entries.select("v", "ids", F.xxhash64("key").alias("spread")).mapInArrow(place, "part bigint, leaf int, v binary, ids array<bigint>")
    queries = entries.where("queries > 0").select("key", "v")

    def visits(frame: DataFrame, first: int, last: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    v = unlisted(batch.column("v"), d)
                    met = forest.walk(aimed(v), first, last, batch.column("radius").to_numpy(zero_copy_only=False).astype(float))
                    content, block = packed(v.astype(kind)), batch.column("block").to_numpy()
                    for cell, (a, b) in enumerate(zip(cells.start, cells.stop)):
                        row = np.flatnonzero(met[:, a:b].any(axis=1))
                        if len(row):
                            yield pa.RecordBatch.from_arrays([pa.array(block[row] * cells.count + cell), batch.column("key").take(pa.array(row)), content.take(pa.array(row)), batch.column("known").take(pa.array(row)), packed(np.packbits(met[row, a:b], axis=1))], ["part", "key", "v", "known", "leaves"])
            tidy()

        block = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
        dealt = frame.select("key", "v", "radius", "known", block).repartition(max(1, -(-asking // 512)), "key")  # a walk takes long for its bytes
        return dealt.mapInArrow(run, "part bigint, key string, v binary, known double, leaves binary")

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return listed(pa.array([], pa.string()), *(np.zeros(0, dtype=t) for t in ("i8", "f8", "i8")))
        return rank_cell(q, c, int(cells.start[c.column("part")[0].as_py() % cells.count]), kind, k + 1)

    def merge(met: pa.Table) -> pa.Table:
        keys = met.column("key").combine_chunks().dictionary_encode()
        row = np.repeat(keys.indices.to_numpy(), pc.list_value_length(met.column("ids")).to_numpy()).astype(np.int64)
        score, ids = (pc.list_flatten(met.column(c)).to_numpy() for c in ("scores", "ids"))
        at = best(row, score, ids, k + 1)
        return listed(keys.dictionary, row[at], score[at], ids[at])

    lists = "key string, scores array<double>, ids array<bigint>"
    merges = max(1, -(-asking * cells.count * (k + 1) // WAITING))

    def ranked(walks: DataFrame, *before: DataFrame) -> DataFrame:
        """(key, scores, ids): the best k + 1 of all leaves met, and of ``before``, each id once."""
        met = walks.groupBy("part").cogroup(in_leaves.groupBy("part")).applyInArrow(meet, lists)
        for other in before:
            met = met.unionByName(other)
        return met.groupBy(F.pmod(F.xxhash64("key", F.lit("merge")), F.lit(merges))).applyInArrow(merge, lists)

    near = staged(ranked(visits(queries.withColumns({"radius": F.lit(float("inf")), "known": F.lit(float("-inf"))}), 0, low)), "near")
    # squared distance of the k-th found, with |query| = 1 and |x| <= 1: 2 - 2 cos
    kth = near.select("key", F.element_at("scores", -1).alias("s"), F.size("scores").alias("n"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    few = F.coalesce(F.col("n"), F.lit(0)) <= k
    radius = F.when(few, F.lit(float("inf"))).otherwise(2 - 2 * F.col("s") / (length * float(np.sqrt(norm2))))
    known = F.when(few, F.lit(float("-inf"))).otherwise(F.col("s"))
    both = ranked(visits(queries.join(kth, "key", "left").select("key", "v", radius.alias("radius"), known.alias("known")), low, high), near)
    own = good.where(is_query).select(F.col("vec_id").alias("query_id"), vector_key().alias("key")).dropDuplicates(["query_id"])
    pairs = F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))
    others = F.slice(F.filter(pairs, lambda p: p["vec_id"] != F.col("query_id")), 1, k)
    return own.join(both, "key").select("query_id", F.posexplode(others).alias("rank", "pair")).select("query_id", (F.col("rank") + 1).alias("rank"), "pair.vec_id", "pair.score")
