"""The prefix trie against a brute-force one, its parentheses against a stack, and odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from screenlake.llm import prefix_trie
from screenlake.llm.parentheses import Parentheses

KIND = "conv_id long, turn long, role string, text string"


def brute(rows, every=100, most=6):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, r, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), x))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = own.get(c - int(math.fmod(c, every)), [])[:h] + v[h:]
    members, kids, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not kids[k]
        saved[k] += (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    ends = {k: ",".join(str(c) for c in m if len(whole[c]) == len(k)) for k, m in members.items()}
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()), key=str)


def got(df, **options):
    return sorted(map(tuple, prefix_trie.trie(df, **options).collect()), key=str)


def odd_rows(seed):
    rng = random.Random(seed)
    rows = [(c if rng.random() > 0.02 else None, rng.choice([t, t, None, 2]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", None, "", "é🙂"])) for c in range(700) for t in range(rng.randint(0, 7))]
    rows += [(-7, 0, "a", "b"), (-107, 0, "a", "b"), (2**62, 0, "a", "b")]
    rows += [(5000 + i, 0, "u", "same") for i in range(400)]  # equal conversations, over several shards
    return rows + [(7000 + i, j, "u", f"s{j}") for i in range(30) for j in range(200)]  # deep ones


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", 7)
    rows = odd_rows(seed)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    assert got(df.withColumn("Path", F.lit(1)).withColumn("a.b", F.lit(2))) == brute(rows)


@pytest.mark.parametrize("turns", [40, 10_000])
def test_any_number_of_shards(spark, monkeypatch, turns):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    rows = odd_rows(9)[:2500]
    assert got(spark.createDataFrame(rows, KIND), every=10, most=3) == brute(rows, 10, 3)


def test_few_rows(spark):
    assert got(spark.createDataFrame([], KIND)) == []
    assert got(spark.createDataFrame([(None, 1, "a", "b")], KIND)) == []
    for rows in ([(3, 0, "a", "b")], [(100, 0, "a", "b"), (101, None, None, None)], [(0, 0, None, "x" * 100_000)] * 2):
        assert got(spark.createDataFrame(rows, KIND)) == brute(rows)


def test_find_close():
    rng = random.Random(4)
    for size in (1, 2, 40, 3000):
        opens, stack, want = [], [], {}
        while len(opens) < 2 * size - len(stack) or stack:
            more = len(opens) + len(stack) < 2 * size and (not stack or rng.random() < 0.6)
            if more:
                stack.append(len(opens))
            else:
                want[stack.pop()] = len(opens)
            opens.append(more)
        tree = Parentheses(np.array(opens))
        assert tree.find_close(tree.at).tolist() == [want[i] for i in tree.at.tolist()]
    deep = Parentheses(np.array([True] * 100_000 + [False] * 100_000))
    assert deep.find_close(np.array([0, 5, 99_999])).tolist() == [199_999, 199_994, 100_000]
