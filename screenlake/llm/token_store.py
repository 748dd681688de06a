"""Token ids of a corpus in a compact file format, and back.

Format: a folder with two Parquet tables. ``codebook`` holds (id, count, bits): the code lengths of a
canonical Huffman code over the global counts, at most MAX_BITS long, which alone define the code.
``blocks`` holds independent blocks of whole documents in ascending document id: their ids and token
numbers, the bit string, and the bit offset of every STRIDE-th token, from which all parts of a block
are decoded side by side by table look-up.

Cases: a null text counts as empty, so it has only the end id; an empty table gives an empty store;
null document ids come first; rows with the same document id stay separate rows, ordered by their ids'
bytes, unless they are so many that they fill several buckets; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, staged, text_slices
from .pieces import PieceEncoder, shared

MAX_BITS = 20
STRIDE = 256
BLOCK_TOKENS = 1 << 16


# --- the code ---------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit in {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    rows, is_leaf = leaves, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = rows[: len(rows) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        rows = both[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        used = int(flags[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


def canonical(symbols: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols by (bits, symbol), their bits and their codes, left-aligned to MAX_BITS."""
    order = np.lexsort((symbols, bits))
    symbols, bits = symbols[order], bits[order]
    steps = np.left_shift(1, MAX_BITS - bits)
    return symbols, bits, np.concatenate([[0], np.cumsum(steps)[:-1]]) if len(bits) else steps


class Coder:
    def __init__(self, symbols: np.ndarray, bits: np.ndarray):
        symbols, bits, codes = canonical(symbols, bits)
        top = int(symbols.max()) + 1 if len(symbols) else 1
        self.bits, self.codes = np.zeros(top, dtype=np.int64), np.zeros(top, dtype=np.uint64)
        self.bits[symbols], self.codes[symbols] = bits, (codes >> (MAX_BITS - bits)).astype(np.uint64)
        spans = np.left_shift(1, MAX_BITS - bits)
        self.symbol_at = np.zeros(1 << MAX_BITS, dtype=np.uint32)
        self.bits_at = np.ones(1 << MAX_BITS, dtype=np.uint8)
        self.symbol_at[: spans.sum()] = np.repeat(symbols, spans)
        self.bits_at[: spans.sum()] = np.repeat(bits, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string and the bit offsets of every STRIDE-th token."""
        if not len(ids):
            return b"", np.zeros(0, dtype=np.int64)
        bits, codes = self.bits[ids], self.codes[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        word, room = at >> 6, 64 - (at & 63) - bits
        whole = np.where(room >= 0, codes << np.maximum(room, 0).astype(np.uint64), codes >> np.maximum(-room, 0).astype(np.uint64))
        words = np.zeros(int(ends[-1] >> 6) + 2, dtype=np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.add.reduceat(whole, first)  # no two codes share a bit
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] += codes[over] << (64 + room[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: int(ends[-1] + 7) // 8], at[::STRIDE]

    def decode(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """Ids of blocks (bit string, checkpoints, number of tokens), all checkpoints side by side."""
        raw = np.frombuffer(b"".join(b for b, _, _ in blocks) + bytes(8), dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        base = np.concatenate([[0], np.cumsum([len(b) for b, _, _ in blocks])[:-1]]) * 8
        at = np.concatenate([p + b for (_, p, _), b in zip(blocks, base)]).astype(np.int64)
        out = np.empty((STRIDE, len(at)), dtype=np.uint32)
        last = 8 * (len(window) - 1)
        for row in out:
            here = np.minimum(at, last)
            code = (window[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)
            row[:] = self.symbol_at[code]
            at += self.bits_at[code]
        flat, done, lane = out.T, [], 0
        for _, points, n in blocks:
            done.append(np.ascontiguousarray(flat[lane : lane + len(points)]).reshape(-1)[:n])
            lane += len(points)
        return done


# --- jobs -------------------------------------------------------------------------------------


ENCODED = "doc_id bigint, n_tokens bigint, ids binary, width string, seen binary"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, width, seen): zstd-compressed little-endian ids, 16 bits wide where the vocabulary allows.

    ``seen``, on the first row of each slice: the slice's different ids and their counts, 32 and 64 bits each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder = shared(PieceEncoder, tokenizer)
        wide = "<u2" if max(encoder.tok.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else "<u4"
        end = np.array([] if end_id is None else [end_id], dtype=wide)
        pack = zstandard.ZstdCompressor(level=1)
        for batch in text_slices(batches, "text", 4 << 20):
            ids, counts = encoder.encode(batch.column(1))
            ids = ids.astype(wide)
            cuts = np.cumsum(counts)
            packed = [pack.compress(np.concatenate([ids[b - n : b], end]).tobytes()) for b, n in zip(cuts.tolist(), counts.tolist())]
            total = np.bincount(ids)
            if len(end):
                total = np.pad(total, (0, max(0, end_id + 1 - len(total))))
                total[end_id] += len(counts)
            at = np.flatnonzero(total)
            seen = at.astype("<u4").tobytes() + total[at].astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts + len(end), pa.int64()), pa.array(packed, pa.binary()), pa.array([wide] * len(counts)), pa.array([seen, *[None] * (len(counts) - 1)], pa.binary())], ["doc_id", "n_tokens", "ids", "width", "seen"])

    return docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).alias("text")).mapInArrow(run, ENCODED)


def in_id_order(encoded: DataFrame, ids: DataFrame) -> DataFrame:
    """``encoded`` in buckets of consecutive document ids, with each row's first token in its bucket.

    ``ids``: the document ids alone, from which the buckets' bounds are estimated in one cheap pass.
    """
    spark = encoded.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / (4 * parts) for i in range(1, 4 * parts)]
    row = ids.agg(F.percentile_approx("doc_id", shares, 20_000).alias("b"), F.count("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    of_null = max(1, -(-row["none"] * 4 * parts // max(1, row["n"] + row["none"])))
    # the same rows have the same number in every attempt of a task
    bucketed = encoded.withColumn("bucket", _bucket(F.col("doc_id"), F.monotonically_increasing_id(), sorted(row["b"] or []), of_null))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total = None, 0
        for batch in batches:
            buckets, ns, out = batch.column("bucket").to_pylist(), batch.column("n_tokens").to_pylist(), []
            for b, n in zip(buckets, ns):
                if b != bucket:
                    bucket, total = b, 0
                out.append(total)
                total += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "first"])

    schema = f"{ENCODED}, bucket int, first bigint"
    return bucketed.repartition(parts, "bucket").sortWithinPartitions("bucket", "doc_id", "ids").mapInArrow(starts, schema)


def _bucket(value: Column, tie: Column, bounds: list[int], of_null: int) -> Column:
    """Number of bounds below or at ``value``, negative for null.

    An id that several bounds share has as many buckets, dealt by ``tie``; null has ``of_null`` of them.
    """

    @F.pandas_udf("int")
    def number(ids: pd.Series, ties: pd.Series) -> pd.Series:
        known, tie = ids.notna().to_numpy(), ties.to_numpy()
        out = (-1 - tie % of_null).astype(np.int32)
        x, edges = ids[known].astype("int64").to_numpy(), np.array(bounds, dtype=np.int64)
        low, high = (np.searchsorted(edges, x, side=s) for s in ("left", "right"))
        out[known] = np.where(high > low + 1, low + 1 + tie[known] % np.maximum(1, high - low), high)
        return pd.Series(out)

    return number(value, tie)


def token_counts(packed: DataFrame) -> DataFrame:
    """(id, count) over all documents: the slices' counts are added in each task, then once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for seen in batch.column(0).to_pylist():
                n = len(seen) // 12
                at, counts = np.frombuffer(seen, dtype="<u4", count=n), np.frombuffer(seen, dtype="<i8", offset=4 * n)
                if n and at[-1] >= len(total):
                    total = np.pad(total, (0, int(at[-1]) + 1 - len(total)))
                total[at] += counts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "count"])

    return packed.select("seen").where("seen is not null").mapInArrow(run, "id bigint, count bigint").groupBy("id").agg(F.sum("count").alias("count"))


def _unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for raw, width in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist()):
        yield np.frombuffer(unpack.decompress(raw), dtype=width)


BLOCK_SCHEMA = "bucket int, first bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, bits binary, checkpoints binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the store at ``path``, a folder that all executors share."""
    spark = docs.sparkSession
    encoded = encode_documents(docs, tokenizer, end_id, id_col, text_col)
    ordered = in_id_order(encoded, docs.select(F.col(id_col).cast("bigint").alias("doc_id")))
    packed = staged(ordered, "ids")
    counts = token_counts(packed).collect()  # a row for each id of the vocabulary at most
    ids = np.array([r["id"] for r in counts], dtype=np.int64)
    totals = np.array([r["count"] for r in counts], dtype=np.int64)
    bits = code_lengths(totals)
    rows = list(zip(ids.tolist(), totals.tolist(), bits.tolist()))
    spark.createDataFrame(rows, "id bigint, count bigint, bits bigint").coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ids, bits)
        docs_in: list[tuple[int | None, int]] = []
        parts: list[np.ndarray] = []
        place: tuple[int, int, int] | None = None  # bucket, first token, tokens so far

        def block() -> pa.RecordBatch:
            whole = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
            raw, points = coder.encode(whole)
            values = [[place[0]], [place[1]], [len(whole)], [[d for d, _ in docs_in]], [[n for _, n in docs_in]], [raw], [points.astype("<i8").tobytes()]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], ["bucket", "first", "n_tokens", "doc_ids", "doc_tokens", "bits", "checkpoints"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "bucket", "first"))
            for doc, bucket, first, tokens in zip(*columns, _unpacked(batch)):
                if place and (place[0] != bucket or place[1] + place[2] != first or place[2] >= BLOCK_TOKENS):
                    yield block()
                    docs_in, parts, place = [], [], None
                place = (bucket, first, len(tokens)) if place is None else (*place[:2], place[2] + len(tokens))
                docs_in.append((doc, len(tokens)))
                parts.append(tokens)
        if place:
            yield block()

    packed.mapInArrow(run, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the store at ``path``: ``ids`` as little-endian 32-bit integers,
    ``start`` the number of tokens of all documents before."""
    book = spark.read.parquet(f"{path}/codebook").select("id", "bits").collect()  # at most the vocabulary
    symbols = np.array([r["id"] for r in book], dtype=np.int64)
    bits = np.array([r["bits"] for r in book], dtype=np.int64)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    totals = sorted((r["bucket"], r["n"]) for r in blocks.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect())  # a row a bucket
    ends = np.cumsum([0, *[n for _, n in totals]]).tolist()
    before = {b: e for (b, _), e in zip(totals, ends)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(symbols, bits)
        names = ("bucket", "first", "n_tokens", "doc_ids", "doc_tokens", "bits", "checkpoints")
        for whole in batches:
            for k in range(0, whole.num_rows, 16):
                rows = list(zip(*(whole.slice(k, 16).column(c).to_pylist() for c in names)))
                tokens = coder.decode([(raw, np.frombuffer(points, dtype="<i8"), n) for _, _, n, _, _, raw, points in rows])
                out: list[list] = [[], [], [], []]
                for (bucket, first, _, doc_ids, doc_tokens, _, _), ids in zip(rows, tokens):
                    at = 0
                    for doc, n in zip(doc_ids, doc_tokens):
                        for column, value in zip(out, (doc, before[bucket] + first + at, n, ids[at : at + n].astype("<u4").tobytes())):
                            column.append(value)
                        at += n
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
