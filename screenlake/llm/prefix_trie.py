"""The prefix trie of conversations, with what sharing each prefix saves.

A turn is a 128-bit hash of its role and text with the text's length, so texts aren't moved; a conversation
is the sequence of its turns' hashes. Sequences are sorted and dealt to shards by ranges of (sequence, id),
so conversations that are equal, however many, are dealt too. A task reads one shard and writes its trie as
balanced parentheses (see ``parentheses``): the closing parenthesis delimits a node's subtree, ranks of leaf
pairs count its leaves, cumulative arrays give members and savings.

A node lies in several shards only if it is a common prefix of the last sequence of one shard and the first
of the next. A child belongs to the first shard that has it, a leaf to the last one, and a node's text is paid for
once in the first; so all numbers of a shared node are sums over its shards, and every other node is complete in
its own. Shared nodes merge by the hash of their prefix. The ids that end at a shared node are hashed in
order from blocks of at most BLOCK_IDS.

Cases: rows with a null id are left out; null roles and texts are empty; of equal turn numbers (null first) the
smaller role, then the smaller hash comes first, and repeated rows are turns each; conversations without turns end at
the root; other columns don't matter; an empty table gives an empty result. A task's memory grows with its
shard: with its share of all turns and with the turns of its longest conversation, not with their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, shared_dir, staged
from .parentheses import Parentheses
from .pieces import ragged

HASH = 16
#: Turns of a shard, about.
SHARD_TURNS = 500_000
BLOCK_IDS = 50_000
NONE = hashlib.sha256(b"").hexdigest()
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
#: ``key`` and ``parent_key``: of shared nodes and of their children; ``ids``: a block of the ids that end at a shared node.
PART = f"shard int, key binary, parent_key binary, ids binary, {NODE}"


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order as (hash in hex, code points of the text)."""
    role, text = (F.coalesce(column(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(column(turn_col).isNotNull().alias("numbered"), column(turn_col).alias("turn"), role.alias("role"), F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("hash"), F.char_length(text).cast("bigint").alias("n"))
    rows = conversations.where(column(id_col).isNotNull()).select(column(id_col).cast("bigint").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["hash"], t["n"])).alias("turns"))


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first crc32(c) % most turns taken from conversation c - c % every (none if absent)."""
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = turns.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return turns.withColumns({"base": base, "h": h}).join(heads, "base", "left").select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def sequences(turns: DataFrame) -> DataFrame:
    """(path, conv_id, lengths): the turns' hashes as one binary, ordered as the trie is."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["hash"]), ""))
    return turns.select(path.alias("path"), "conv_id", F.transform("turns", lambda t: t["n"]).alias("lengths"))


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // HASH
    same = (np.frombuffer(a, "V16", n) == np.frombuffer(b, "V16", n)) if n else np.zeros(0, dtype=bool)
    return n if same.all() else int(same.argmin())


def shared_depths(spark, ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """For each shard, how many turns its first sequence has in common with the one before, and its last with the one after; -1 for none.

    Two numbers a shard reach the driver; the sequences meet in tasks.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                path = batch.column(0)
                first = path[0].as_py() if first is None else first
                last = path[batch.num_rows - 1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], ["shard", "first", "last"])

    edges = staged(ordered.select("path").mapInArrow(ends, "shard int, first binary, last binary"), "edges")
    shards = sorted(r["shard"] for r in edges.select("shard").collect())
    follow = spark.createDataFrame(list(zip(shards, shards[1:])), "shard int, next int")

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("last").to_pylist(), batch.column("first").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("next"), pa.array(list(map(common_turns, a, b)), pa.int64())], ["shard", "next", "n"])

    pairs = edges.select("shard", "last").join(follow, "shard").join(edges.select(F.col("shard").alias("next"), "first"), "next").select("shard", "next", "last", "first")
    out = {s: [-1, -1] for s in shards}
    for r in pairs.mapInArrow(common, "shard int, next int, n bigint").collect():
        out[r["shard"]][1] = out[r["next"]][0] = r["n"]
    discard(edges)
    return {s: tuple(v) for s, v in out.items()}


class Shard:
    """The trie of sorted sequences: nodes in depth-first order, the root first, as arrays."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, turns: np.ndarray, lengths: np.ndarray, before: int, after: int):
        self.ids, m = ids, len(ids)
        starts = np.cumsum(sizes) - sizes
        common = np.zeros(m, dtype=np.int64)
        both = np.minimum(sizes[:-1], sizes[1:])
        differ = turns[ragged(starts[:-1], both)] != turns[ragged(starts[1:], both)]
        segment = np.repeat(np.arange(m - 1), both)[differ]
        common[1:] = both
        row, at = np.unique(segment, return_index=True)
        common[row + 1] = (np.flatnonzero(differ)[at] - (np.cumsum(both) - both)[row]) if len(row) else 0
        new = sizes - common
        self.depth = np.append(0, ragged(common + 1, new))
        length = np.append(0, lengths[ragged(starts + common, new)])
        n = len(self.depth)
        counts = np.empty(2 * m + 2, dtype=np.int64)
        counts[0], counts[1:-1:2], counts[2::2] = 1, np.append(0, sizes[:-1]) - common, new
        counts[-1] = sizes[-1] + 1
        opens = np.repeat(np.arange(2 * m + 2) % 2 == 0, counts)
        tree = Parentheses(opens)
        self.end, leaves = tree.subtrees()
        self.end_node = np.cumsum(new)
        place = np.searchsorted(self.end_node, np.append(np.arange(n), n))  # a node's first row; one past the last by its end
        self.first_row, self.end_row = place[:-1], place[self.end]
        self.n_convs = self.end_row - self.first_row
        both_ends = np.column_stack([self.first_row, self.end_row]).ravel()
        self.conv_id = np.minimum.reduceat(np.append(ids, np.iinfo(np.int64).max), both_ends)[::2]
        by_depth = np.lexsort((np.arange(n), self.depth))
        rank = self.depth[by_depth] * n + by_depth
        self.parent = np.full(n, -1, dtype=np.int64)
        self.parent[1:] = by_depth[np.searchsorted(rank, (self.depth[1:] - 1) * n + np.arange(1, n)) - 1]
        owned = np.ones(n, dtype=bool)
        owned[: max(before, 0) + 1] = before < 0  # the first sequence's nodes are the first ones
        self.n_children = np.bincount(self.parent[1:][owned[1:]], minlength=n)
        saved = np.append(0, np.cumsum(self.n_convs * length - owned * length))
        self.saved = saved[self.end] - saved[:-1]
        last, node = int(self.end_node[-1]), np.arange(n)
        self.last_path = np.flatnonzero((node <= last) & (last < self.end))
        self.n_leaves = leaves - (sizes[-1] <= after) * ((node <= last) & (last < self.end))
        self.shared = np.zeros(n, dtype=bool)
        self.shared[: before + 1] = True
        self.shared[self.last_path[: after + 1]] = True

    def keys(self, first: bytes, last: bytes) -> dict[int, bytes]:
        """The hash of the prefix of each shared node, which lies on the first or the last sequence."""
        out = {}
        for path, nodes in ((first, range(len(first) // HASH + 1)), (last, self.last_path.tolist())):
            h = hashlib.sha256()
            for depth, node in enumerate(nodes):
                if depth:
                    h.update(path[(depth - 1) * HASH : depth * HASH])
                if not self.shared[node]:
                    break
                out[node] = h.digest()
        return out

    def parts(self, shard: int, first: bytes, last: bytes) -> Iterator[pa.RecordBatch]:
        n, keys = len(self.depth), self.keys(first, last)
        hashes, blocks = [NONE] * n, []
        cuts = np.append(np.flatnonzero(np.diff(self.end_node, prepend=-1)), len(self.ids)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            node = int(self.end_node[a])
            if node in keys:
                blocks += [(keys[node], int(self.ids[k]), ",".join(map(str, self.ids[k : min(k + BLOCK_IDS, b)].tolist())).encode()) for k in range(a, b, BLOCK_IDS)]
            else:
                hashes[node] = hashlib.sha256(",".join(map(str, self.ids[a:b].tolist())).encode()).hexdigest()
        names = ["shard", "key", "parent_key", "ids", *(f.split()[0] for f in NODE.split(", "))]
        inner = (self.parent >= 0) & ~self.shared[self.parent]
        for a in range(0, n, 1 << 16):
            s = slice(a, min(a + (1 << 16), n))
            own = range(s.start, s.stop)
            columns = [pa.array([shard] * len(own), pa.int32()), pa.array([keys.get(i) for i in own], pa.binary()), pa.array([keys.get(p) for p in self.parent[s].tolist()], pa.binary()), pa.nulls(len(own), pa.binary())]
            columns += [pa.array(self.conv_id[s]), pa.array(self.depth[s]), pa.array(self.conv_id[self.parent[s]], mask=~inner[s])]
            columns += [pa.array(x[s].astype(np.int64)) for x in (self.n_convs, self.n_children, self.n_leaves, self.saved)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(hashes[s], pa.string())], names)
        for key, conv, ids in blocks:
            row = {"shard": shard, "key": key, "ids": ids, "conv_id": conv}
            yield pa.RecordBatch.from_pylist([row], pa.schema([(f.split()[0], {"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in PART.split(", ")]))


def shard_parts(ordered: DataFrame, depths: dict[int, tuple[int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        shard = TaskContext.get().partitionId()
        first, last = held[0].column("path")[0].as_py(), held[-1].column("path")[held[-1].num_rows - 1].as_py()
        ids = np.concatenate([b.column("conv_id").to_numpy() for b in held])
        sizes = np.concatenate([b.column("lengths").value_lengths().to_numpy().astype(np.int64) for b in held])
        lengths = np.concatenate([b.column("lengths").flatten().to_numpy() for b in held])
        turns = np.concatenate([np.frombuffer(b"".join(b.column("path").to_pylist()), "V16") for b in held])
        held.clear()
        # equal hashes get equal numbers, which compare faster
        yield from Shard(ids, sizes, numbered(turns), lengths, *depths[shard]).parts(shard, first, last)

    return ordered.select("path", "conv_id", "lengths").mapInArrow(run, PART)


def numbered(turns: np.ndarray) -> np.ndarray:
    halves = turns.view("<u8").reshape(-1, 2)
    order = np.lexsort((halves[:, 0], halves[:, 1]))
    changes = (halves[order[1:]] != halves[order[:-1]]).any(axis=1)
    out = np.empty(len(turns), dtype=np.int64)
    out[order] = np.append(0, np.cumsum(changes)) if len(turns) else 0
    return out


def hashed_ends(blocks: DataFrame) -> DataFrame:
    """(key, ends_sha256) from blocks of ids (key, conv_id, ids), read in order, one held at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, h = None, None
        for frame in frames:
            done = []
            for k, ids in zip(frame["key"], frame["ids"]):
                if k != key:
                    done += [(key, h.hexdigest())] if h else []
                    key, h = k, hashlib.sha256(ids)
                else:
                    h.update(b"," + ids)
            yield pd.DataFrame(done, columns=["key", "ends"])
        if h:
            yield pd.DataFrame([(key, h.hexdigest())], columns=["key", "ends"])

    return blocks.select("key", "conv_id", "ids").repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ids").mapInPandas(run, "key binary, ends string")


def trie(conversations: DataFrame, every: int = 100, most: int = 6, **columns: str) -> DataFrame:
    """A row for each node of the trie of all rebuilt conversations (see ``rebuilt``): NODE."""
    spark = conversations.sparkSession
    own = staged(turns_of(conversations, **columns), "turns")
    whole = sequences(rebuilt(own, every, most))
    n = own.agg(F.sum(F.size("turns"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_TURNS))
    shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    ordered = whole.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id").checkpoint()
    parts = staged(shard_parts(ordered, shared_depths(spark, ordered)), "parts")
    discard(own)
    names = [f.split()[0] for f in NODE.split(", ")]
    nodes, blocks = parts.where("ids IS NULL"), parts.where("ids IS NOT NULL")
    shared = nodes.where("key IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = shared.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), *sums)
    merged = staged(merged.join(hashed_ends(blocks), "key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NONE))), "shared")
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    tops = merged.join(above, "parent_key", "left").select(*names)
    # children of a shared node look it up in their own shard, so that a node with very many children is many keys
    here = shared.select("shard", F.col("key").alias("parent_key")).join(above, "parent_key")
    alone = nodes.where("key IS NULL")
    under = alone.where("parent_key IS NOT NULL").drop("parent_conv_id").join(here, ["shard", "parent_key"]).select(*names)
    return tops.unionByName(under).unionByName(alone.where("parent_key IS NULL").select(*names))
