"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut into chunks where a rolling hash of the last WINDOW bytes hits a mask, so the same passage
gives the same chunks in every document that holds it. A chunk's core reaches from its first safe cut to its
last (see ``pieces``). The cores of the whole corpus are counted in Spark, by their hashes; each that occurs more
than once is encoded once, and its ids are joined back, by a 128-bit hash of the core, to the texts that hold
it. Other cores are encoded where their text is. A filter of the repeated hashes (see ``Repeats``) picks the cores and
the rows that take part in the joins; rows without a repeated core are encoded where they were read. What lies around a join of two chunks, from the left one's last
safe cut to the right one's first, is encoded again together with characters of both neighbours: the ids
at either end must be exactly those that the neighbours' characters have alone. Where they aren't, more of
the neighbours is taken until they agree; where they never do, the text goes to the library whole. No
join is kept beyond its slice of texts.

Cores and joins are encoded many at a time: a stretch that occurs in several of them at once is encoded once, plain
words by the merges (see ``plain_words``), all else by the library.

With ``across=False`` no table of chunks is made: cores are shared by the slices of a worker only, and no text
is shuffled.

The hash of a text only says which cores' ids travel to it; a core takes its ids by its own hash. A text that fills
a third of all rows has its cores listed once, and Spark splits its rows where they are joined with that list.

Texts with a special token's string inside go to the library whole. Cases: a null text counts as empty
(no ids); an empty table gives an empty result; all other columns and repeated rows are kept as they
are; columns of the result with the name of an input column replace it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Members, column, discard, others, staged, text_slices
from .pieces import ODD, PieceEncoder, joined, ragged, safe_cuts, shared
from .plain_words import PlainWords

WINDOW = 32
#: Chunks have 2**CHUNK_BITS bytes on the average.
CHUNK_BITS = 8
#: Characters of either neighbour that are encoded with a join at first.
CONTEXT = 1
SLICE = 2 << 20


def cut_points(data: np.ndarray, window: int = WINDOW, bits: int = CHUNK_BITS) -> np.ndarray:
    """Positions where a chunk starts, by a hash of the ``window`` bytes before."""
    if len(data) <= window:
        return np.zeros(0, dtype=np.int64)
    table = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
    h = table[data]
    reach = 1
    while reach < window:
        h[reach:] += h[:-reach] * np.uint32(31**reach % (1 << 32))
        reach *= 2
    return np.flatnonzero((h[window - 1 : -1] >> np.uint32(32 - bits)) == 0) + window


def hash_of(core: bytes) -> bytes:
    return hashlib.blake2b(core, digest_size=16).digest()


class ChunkEncoder(PieceEncoder):
    """Encodes texts by cores of chunks and joins; the memo keeps cores only, ``given`` holds ids of cores by their hash."""

    def __init__(self, path: str, limit: int = 20_000, separator: str | None = None):
        self.plain = PlainWords.of(path)
        super().__init__(path, limit, separator)
        self.tokens = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())] if self.tok.decoder is None else None
        self.edges: dict[str, bytes] = {}
        self.cuts = np.zeros(0, dtype=np.int64)
        self.given: dict[bytes, bytes] = {}
        self.passing = np.zeros(0, dtype=np.int64)

    def bounds(self, data: np.ndarray, starts: np.ndarray, odd: np.ndarray) -> np.ndarray:
        safe = safe_cuts(data, starts, odd)
        is_safe = np.zeros(len(data) + 1, dtype=bool)
        is_safe[safe] = True
        cuts = cut_points(data)
        cuts = cuts[cuts - starts[np.searchsorted(starts, cuts, side="right") - 1] >= WINDOW]  # no hash reaches into the text before
        self.cuts = cuts[~is_safe[cuts]]
        before = np.cumsum(is_safe, dtype=np.int32)[self.cuts] - 1
        start = np.zeros(len(data) + 1, dtype=bool)
        for ends in (starts, cuts[is_safe[cuts]], safe[before], safe[before + 1]):  # a cut at a safe one joins nothing
            start[ends] = True
        return np.flatnonzero(start)

    def joins(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which stretches of the last ``bounds`` hold a cut, so that they are no cores."""
        return np.searchsorted(self.cuts, begin, side="right") < np.searchsorted(self.cuts, end)

    def cores(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The cores of the texts in a row, and the number of the text of each; none of texts that go to the library whole."""
        texts = pc.fill_null(texts, "")
        for s in self.special:
            texts = pc.if_else(pc.match_substring(texts, s), "", texts)
        data, starts = joined(texts)
        if not len(data):
            return pa.array([], pa.binary()), np.zeros(0, dtype=np.int64)
        bounds = self.bounds(data, starts, pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False))
        all_ = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int64)), pa.py_buffer(data)])
        core = ~self.joins(bounds[:-1], bounds[1:])
        return all_.filter(pa.array(core)).cast(pa.binary()), np.searchsorted(starts, bounds[:-1][core], side="right") - 1

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.memo.trim()
        before, self.passing = len(self.memo.known), np.zeros(0, dtype=np.int64)
        out = super().cut(texts)
        if len(self.passing):
            self.memo.keep(np.setdiff1d(np.arange(len(self.memo.known)), before + self.passing))
        return out

    def library_all(self, texts: list[str], at_once: int = 16) -> Iterator[bytes]:
        """As the library's ids, but plain words are merged here, all at once."""
        plain = self.plain.fits(pa.array(texts, pa.large_string())) if self.plain and texts else np.zeros(len(texts), dtype=bool)
        if not plain.any():
            yield from super().library_all(texts, at_once)
            return
        words = iter(self.plain.ids([texts[i] for i in np.flatnonzero(plain)]))
        rest = super().library_all([texts[i] for i in np.flatnonzero(~plain)], at_once)
        for is_plain in plain:
            yield next(words if is_plain else rest)

    def encode_each(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text alone, as bytes; a stretch between safe cuts that occurs more than once in them is encoded once, none is kept for later."""
        texts = texts.cast(pa.large_string())
        data, starts = joined(texts)
        if not len(data):
            return [b""] * len(texts)
        bounds = safe_cuts(data, starts, pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False))
        coded = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, dtype=np.int64)), pa.py_buffer(data)]).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_string())
        plain = self.plain.fits(distinct) if self.plain else np.zeros(len(distinct), dtype=bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        strings = distinct.take(pa.array(order)).to_pylist()
        n = int(plain.sum())
        found = [*self.library_all(strings[:n]), *self.encode_new(strings[n:])]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        codes, lengths = place[codes], np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        ids = np.frombuffer(b"".join(found), dtype="<u4")[ragged((np.cumsum(lengths) - lengths)[codes], lengths[codes])].tobytes()
        cuts = (np.concatenate([[0], np.cumsum(lengths[codes])])[np.searchsorted(bounds, starts)] * 4).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, data: np.ndarray, starts: np.ndarray, bounds: np.ndarray, first: np.ndarray, texts: list[str]) -> list[bytes | None]:
        begin, end = bounds[first], bounds[first + 1]
        joins = self.joins(begin, end)
        self.passing = np.flatnonzero(joins)
        out: list[bytes | None] = [None] * len(texts)
        cores = np.flatnonzero(~joins).tolist()
        if self.given:
            for i in cores:
                out[i] = self.given.get(hash_of(texts[i].encode()))
        cores = [i for i in cores if out[i] is None]
        for i, ids in zip(cores, self.encode_each(pa.array([texts[i] for i in cores], pa.large_string()))):
            out[i] = ids
        text = np.searchsorted(starts, begin, side="right") - 1
        low, high = starts[text], starts[np.minimum(text + 1, len(starts) - 1)]
        raw, open_, width = data.tobytes(), np.flatnonzero(joins).tolist(), CONTEXT
        while open_:
            around = []
            for i in open_:
                a, b, l, h = int(begin[i]), int(end[i]), int(low[i]), int(high[i])
                left = raw[max(l, a - 4 * width) : a].decode("utf-8", "ignore")[-width:]
                right = raw[b : min(h, b + 4 * width + 4)].decode("utf-8", "ignore")[: width + 1]
                around.append((left, right, width >= max(a - l, h - b)))
            missing = list({x for left, right, _ in around for x in (left, right) if x and x not in self.edges})
            self.edges.update(zip(missing, self.library_all(missing)))
            again = []
            for i, (left, right, all_), ids in zip(open_, around, self.encode_each(pa.array([left + texts[i] + right for i, (left, right, _) in zip(open_, around)], pa.large_string()))):
                p, q = (len(self.edges[x]) if x else 0 for x in (left, right))
                inner = len(ids) - p - q
                if inner >= 0 and ids[:p] == self.edges.get(left, b"") and ids[p + inner :] == self.edges.get(right, b""):
                    out[i] = ids[p : p + inner]
                elif not all_:
                    again.append(i)
            open_, width = again, width * 4
        if len(self.edges) > 100_000:
            self.edges.clear()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False); without a decoder it joins tokens by a space."""
        numbers = ids.tolist()
        if self.tokens is None:
            return self.tok.decode(numbers, skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, numbers))


class Repeats(Members):
    """A Bloom filter of the hashes of cores that occur more than once, 32 MB at most (see ``Members``).

    False hits send more rows through the joins, which sort them out; results are the same with any number.
    """

    def __init__(self, docs: DataFrame, tokenizer: str, text_col: str = "text"):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = shared(ChunkEncoder, tokenizer)
            for batch in text_slices(batches, "text", SLICE):
                counted = encoder.cores(batch.column(0))[0].value_counts()
                yield pa.RecordBatch.from_arrays([pa.array(first_halves(counted.field("values"))), counted.field("counts")], ["h", "n"])

        rows = docs.select(column(text_col).alias("text")).mapInArrow(count, "h bigint, n bigint")
        found = staged(rows.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "chunks")
        super().__init__(found, "h")
        discard(found)

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.shiftrightunsigned(key, 18 * k), F.lit(self.size)) for k in range(self.HASHES)]

    def hold(self, cores: pa.Array) -> np.ndarray:
        """Which of the cores may occur more than once."""
        h = first_halves(cores).view(np.uint64)
        return self.mask([(h >> np.uint64(18 * k) & np.uint64(self.size - 1)).astype(np.int64) for k in range(self.HASHES)])


def first_halves(cores: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(hash_of(c)[:8] for c in cores.to_pylist()), dtype="<i8")


def chunk_ids(docs: DataFrame, tokenizer: str, repeats: Repeats, text_col: str = "text") -> DataFrame:
    """(core, ids): the hash and the ids of each core that occurs more than once in the corpus.

    Cores are counted in each slice and task before the shuffle, so a frequent one arrives as few rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(ChunkEncoder, tokenizer)
        for batch in text_slices(batches, "text", SLICE):
            cores = encoder.cores(batch.column(0))[0]
            counted = cores.filter(pa.array(repeats.hold(cores))).value_counts()
            yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["core", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(ChunkEncoder, tokenizer)
        for batch in text_slices(batches, "core", SLICE):
            ids = encoder.encode_each(batch.column(0).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(map(hash_of, batch.column(0).to_pylist()), pa.binary()), pa.array(ids, pa.binary())], ["core", "ids"])

    counted = docs.select(column(text_col).alias("text")).mapInArrow(count, "core binary, n bigint")
    return counted.groupBy("core").agg(F.sum("n").alias("n")).where("n > 1").select("core").mapInArrow(encode, "core binary, ids binary")


def chunks_of_texts(docs: DataFrame, tokenizer: str, repeats: Repeats, text_col: str = "text") -> DataFrame:
    """(_key, chunks): for the hash of a text its cores that occur more than once in the corpus, with their ids."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(ChunkEncoder, tokenizer)
        for batch in text_slices(batches, "text", SLICE):
            cores, of = encoder.cores(batch.column(1))
            held = repeats.hold(cores)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[held])), pa.array(map(hash_of, cores.filter(pa.array(held)).to_pylist()), pa.binary())], ["_key", "core"])

    rows = docs.select(F.xxhash64(column(text_col)).alias("_key"), column(text_col).alias("text")).mapInArrow(hashes, "_key bigint, core binary")
    known = rows.distinct().join(chunk_ids(docs, tokenizer, repeats, text_col), "core")
    return known.groupBy("_key").agg(F.collect_list(F.struct("core", "ids")).alias("chunks"))  # no more than a text has cores


def rows_by_repeats(rows: DataFrame, tokenizer: str, repeats: Repeats, some: bool, text_col: str) -> DataFrame:
    """The rows whose text has a core that may be repeated (``some``), or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(ChunkEncoder, tokenizer)
        for batch in text_slices(batches, text_col, SLICE):
            cores, of = encoder.cores(batch.column(batch.schema.get_field_index(text_col)))
            hit = np.zeros(batch.num_rows, dtype=bool)
            hit[of[repeats.hold(cores)]] = True
            yield batch.filter(pa.array(hit == some))

    return rows.mapInArrow(run, rows.schema)


def encode_decode(docs: DataFrame, tokenizer: str, text_col: str = "text", keep_ids: bool = False, keep_text: bool = False, across: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256, and on demand ids (binary) and decoded.

    ``across``: cores that texts share are encoded once for the whole corpus, not once for each worker. The
    repeated hashes are then counted when the query is built.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    added += [T.StructField("ids", T.BinaryType())] * keep_ids + [T.StructField("decoded", T.StringType())] * keep_text
    kept = others(docs, *(f.name for f in added))
    places, names = [docs.schema.fields.index(f) for f in kept], docs.columns
    at = names.index(text_col) if text_col in names else [n.lower() for n in names].index(text_col.lower())
    docs, text = docs.toDF(*(f"c{i}" for i in range(len(names)))), F.col(f"c{at}")  # names may clash but for case
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*kept, *added])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(ChunkEncoder, tokenizer)
        for batch in text_slices(batches, f"c{t}", SLICE):
            if "chunks" in batch.schema.names:
                each = pc.list_flatten(batch.column(batch.num_columns - 1))
                encoder.given = dict(zip(each.field("core").to_pylist(), each.field("ids").to_pylist()))
            ids, counts = encoder.encode(batch.column(t))
            encoder.given = {}
            split = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
            raw = [x.astype("<u4", copy=False).tobytes() for x in split]
            decoded = [encoder.decode(x) for x in split]
            columns = [pa.array(counts, pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (raw, [t.encode() for t in decoded]))]
            columns += [pa.array(raw, pa.binary())] * keep_ids + [pa.array(decoded, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], inner.names)

    t = places.index(at) if at in places else len(kept)  # the text is once in a row
    rows = docs.select(*(f"c{i}" for i in [*places, *[at] * (t == len(kept))]))
    rows = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))
    if across:
        texts = docs.select(text.alias("text"))
        repeats = Repeats(texts, tokenizer)
        shared_ = rows_by_repeats(rows, tokenizer, repeats, True, f"c{t}").withColumn("_key", F.xxhash64(f"c{t}"))
        shared_ = shared_.join(chunks_of_texts(texts, tokenizer, repeats), "_key", "left").drop("_key")
        out = rows_by_repeats(rows, tokenizer, repeats, False, f"c{t}").mapInArrow(run, inner).unionByName(shared_.mapInArrow(run, inner))
    else:
        out = rows.mapInArrow(run, inner)
    return out.toDF(*(f.name for f in [*kept, *added]))
