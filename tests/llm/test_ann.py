import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from screenlake.llm import ann
from screenlake.llm import queries as q


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24)).astype("f4")
    x[1000:1600] = x[:600] + 0.05 * rng.standard_normal((600, 24)).astype("f4")
    x[2000:2200] = x[40]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3).cache()


def found(vectors):
    return sorted(map(tuple, ann.search(vectors, F.col("vec_id") % 20 == 0, k=10).collect()))


def test_what_walks_send_does_not_grow_with_the_leaves(spark, vectors, monkeypatch, tmp_path):
    kind = type(vectors)
    plain = kind.mapInArrow

    def weighed(self, func, schema, *more, **named):
        def run(batches):
            for batch in func(batches):
                (tmp_path / f"{batch.nbytes}-{uuid.uuid4().hex}").touch()
                yield batch

        return plain(self, run, schema, *more, **named)

    monkeypatch.setattr(kind, "mapInArrow", weighed)
    monkeypatch.setattr(ann, "LEAF_ROWS", 8)  # 256 leaves, of which a query may meet 384
    assert len(found(vectors)) == 1500
    sizes = [int(p.name.split("-")[0]) for p in tmp_path.iterdir()]
    assert max(sizes) < 1 << 20 and sum(sizes) < 8 << 20


def test_cells_and_blocks_of_any_size_find_the_same(vectors, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 32)
    want = found(vectors)
    row = 8 * 24
    for cell, block, slice_ in ((200, 40, 100), (20, 7, 1024), (100_000, 1000, 1024)):  # rows; the second divides leaves
        monkeypatch.setattr(ann, "CELL", cell * row)
        monkeypatch.setattr(ann, "BLOCK", block * row)
        monkeypatch.setattr(ann, "LEAST_ROWS", cell)
        monkeypatch.setattr(ann, "SLICE", slice_)
        assert found(vectors) == want


def test_cells():
    for rows, most in (([3, 0, 4, 5, 0, 25, 1, 2, 0], 10), ([30], 10), ([0, 0], 5), ([5, 5, 5], 5), ([1, 21, 21], 10)):
        cells = ann.Cells(np.array(rows), most)
        held = [[] for _ in range(cells.count)]
        for leaf, n in enumerate(rows):
            for piece in range(cells.pieces[leaf]):
                cell = cells.first[leaf] + piece
                held[cell].append(-(-n // cells.pieces[leaf]))
                assert cells.start[cell] <= leaf < cells.stop[cell]
        assert max(map(sum, held)) <= most
        assert [int(b - a) for a, b in zip(cells.start, cells.stop)] == list(map(len, held))


@pytest.mark.parametrize("waiting", [1, 1 << 20])
def test_a_cell_against_brute_force(monkeypatch, waiting):
    monkeypatch.setattr(ann, "WAITING", waiting)
    monkeypatch.setattr(ann, "SCORES", 64)
    rng = np.random.default_rng(2)
    a, mine = rng.integers(-2, 3, (90, 3)).astype("f8"), rng.integers(-2, 3, (40, 3)).astype("f8")  # many ties
    leaf = rng.integers(5, 14, 90)
    ids = [rng.choice(60, rng.integers(1, 4), replace=False).tolist() for _ in range(80)] + [[7]] * 10  # ids of several vectors
    mask = rng.random((40, 9)) < 0.6
    known = np.where(rng.random(40) < 0.5, -np.inf, 2.0)
    keys = [f"q{i}" for i in range(40)]
    c = pa.table([pa.array(leaf, pa.int32()), ann.packed(a), pa.array(ids, pa.list_(pa.int64()))], ["leaf", "v", "ids"])
    got = ann.rank_cell(pa.table([pa.array(keys), ann.packed(mine), pa.array(known), ann.packed(np.packbits(mask, axis=1))], ["key", "v", "known", "leaves"]), c, 5, "<f8", 6).to_pylist()
    want = []
    for i, key in enumerate(keys):
        scores = {}
        for j in np.flatnonzero(mask[i, leaf - 5]):
            s = float(mine[i] @ a[j])
            for n in ids[j]:
                if s >= known[i]:
                    scores[n] = max(s, scores.get(n, -np.inf))
        top = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:6]
        if top:
            want.append({"key": key, "scores": [s for _, s in top], "ids": [n for n, _ in top]})
    assert got == want


def test_recall_of_the_query_on_the_given_embeddings(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype="f8")
    got = {}
    for r in q.op5_ann(spark, folder).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for i, v in zip(ids, x):
        if i % 20 == 0:
            s = x @ v
            hits += len(set(ids[[j for j in np.lexsort((ids, -s)) if ids[j] != i][:20]].tolist()) & set(got[i]))
            assert all(abs(score - s[ids == n][0]) < 1e-9 for n, score in got[i].items())
    assert hits >= 0.9 * 20 * len(got)
