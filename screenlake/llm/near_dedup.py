"""Near-duplicate documents by one-permutation MinHash with optimal densification.

A document's set of word shingles is hashed once; the hash range is split into BINS bins and the least
hash of each bin is its sketch. An empty bin borrows from the first non-empty one of its own fixed
random sequence of bins. ROWS bins make a band; documents that agree on a band share a bucket.

1. Documents with the same set are one class, represented by the smallest id.
2. In each bucket every representative is paired with the bucket's smallest only (a star), so pairs grow
   with the rows, not with their square. Pairs are confirmed on full sets and joined to components.
3. What a star can miss lies in buckets that still hold several components. Only their members' full
   sets are kept. In STAR_ROUNDS more stars, each bucket takes another centre, from its most frequent
   component, for the members outside it.
4. What is then still outside meets all members of its buckets, in blocks of bounded size; pairs that a
   finer sketch rules out are left out, and the rest is confirmed on full sets as well. A pair that
   shares several buckets is made in one of them only, that of the smallest key.

No bucket is capped. A link between two texts is lost if no band agrees (at similarity 0.8 with BANDS = 24
and ROWS = 4, one in 300,000), or if a sketch rules the pair out (at 5 deviations of room, about one in three
million for each of the two tests).

Texts are never shuffled: the ids that need their full sets, and those that are dropped in the end, are
found where the texts are read by a Bloom filter of bounded size; what it lets through by chance joins
nothing.

Cases: words are split at ASCII white space and A-Z lower-cased; fewer words than a shingle make one
shingle; null texts and texts without words have the empty set, link with nothing and are kept; rows
with a null id are kept, unlinked; rows that repeat an id are one document with links of each of its
texts; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Members, column, discard, staged, text_slices
from .components import components

BANDS, ROWS = 24, 4
BINS = BANDS * ROWS
BLOCK = 512
STAR_ROUNDS = 1
FINE = 512
_EDGES = (np.arange(BINS + 1, dtype=object) * (1 << 64) // BINS)[:-1].astype(np.uint64)
_FINE_EDGES = (np.arange(FINE + 1, dtype=object) * (1 << 64) // FINE)[:-1].astype(np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


#: For each bin the sequence of bins it may borrow from.
_BORROW = (mix64(np.arange(BINS * 1024, dtype=np.uint64) + np.uint64(1)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, 1024)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``n`` words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    if len(words) < n:
        hashes = np.concatenate([hashes, np.full(n - len(words), len(words), dtype=np.uint64)])
    mixed = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i]
    return np.unique(mix64(mixed))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin, empty bins filled by optimal densification."""
    at = np.searchsorted(shingles, _EDGES)
    ends = np.append(at[1:], len(shingles))
    full = at < ends
    out = shingles[np.minimum(at, len(shingles) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        tries = full[_BORROW[empty]]
        first = tries.argmax(axis=1)
        source = np.where(tries.any(axis=1), _BORROW[empty, first], np.flatnonzero(full)[0])
        out[empty] = out[source]
    return out


def bands(values: np.ndarray) -> np.ndarray:
    grouped = values.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, i])
    return key


def sketches(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, keys, mins): one row a document row; the last three null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in text_slices(batches, "text"):
            sizes, sets, keys, mins = [], [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, n)
                sizes.append(len(shingles))
                if not len(shingles):
                    for column in (sets, keys, mins):
                        column.append(None)
                    continue
                values = sketch(shingles)
                sets.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                keys.append(bands(values).view(np.int64).tolist())
                mins.append(values.astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(mins, pa.binary())], ["doc_id", "n_shingles", "set_key", "keys", "mins"])

    return docs.select(column(id_col).cast("bigint").alias("doc_id"), column(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, keys array<bigint>, mins binary")


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether sketches (rows of BINS numbers) may belong to sets of similarity ``least``: 5 deviations of room."""
    same = (a == b).mean(axis=-1)
    room = 5 * np.sqrt(least * (1 - least) / np.minimum(BINS, np.minimum(na, nb)))
    return (same >= least - room) & (np.minimum(na, nb) >= least * np.maximum(na, nb))


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, BINS)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Fewer rows in each batch for Python, where rows hold two whole sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule out a similarity of ``percent``."""
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("mins").alias(f"m{c}"), F.col("n_shingles").alias(f"n{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = plausible(_rows(batch.column("ma")), _rows(batch.column("mb")), *(batch.column(c).to_numpy() for c in ("na", "nb")), percent / 100)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ma", "mb", "na", "nb").mapInArrow(run, "a bigint, b bigint")


def fine_sketch(shingles: np.ndarray) -> np.ndarray:
    """FINE bins of a byte each: 1 to 255 from the bin's least hash, 0 for an empty bin."""
    at = np.searchsorted(shingles, _FINE_EDGES)
    full = at < np.append(at[1:], len(shingles))
    return np.where(full, shingles[np.minimum(at, len(shingles) - 1)] % np.uint64(255) + np.uint64(1), np.uint64(0)).astype(np.uint8)


def may_reach(a: np.ndarray, b: np.ndarray, na: int, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether fine sketches leave a similarity of ``least`` possible, with 5 deviations of room.

    A non-empty bin is a draw without replacement from the union of the sets.
    """
    used = np.maximum(1, ((a > 0) | (b > 0)).sum(axis=1))
    same = ((a == b) & (a > 0)).sum(axis=1) / used
    drawn = np.minimum(1.0, used * (1 + least) / (na + nb))
    room = 5 * np.sqrt(least * (1 - least) / used * (1 - drawn) + 1e-4)
    return (same >= least - room) & (np.minimum(na, nb) >= least * np.maximum(na, nb))


def full_sets(docs: DataFrame, ids: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, size, shingles, fine, own) of the documents in ``ids`` (doc_id), a row for each of their rows.

    ``own``: the keys of the text's buckets, BANDS numbers of 8 bytes. Texts stay where they are read; a few
    documents that aren't in ``ids`` come along, which no pair joins.
    """
    wanted = Members(ids)
    spots = [f"p{i}" for i in range(Members.HASHES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            some = whole.filter(pa.array(wanted.mask([whole.column(p).to_numpy() for p in spots])))
            for batch in text_slices([some], "text"):
                sets = [shingle_set(t, n) for t in batch.column("text").to_pylist()]
                fine = [fine_sketch(s).tobytes() if len(s) else bytes(FINE) for s in sets]
                own = [bands(sketch(s)).tobytes() if len(s) else bytes(8 * BANDS) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c, pa.binary()) for c in ([s.tobytes() for s in sets], fine, own))], ["doc_id", "size", "shingles", "fine", "own"])

    key = column(id_col).cast("bigint")
    texts = docs.where(key.isNotNull()).select(key.alias("doc_id"), column(text_col).alias("text"), *(p.alias(c) for p, c in zip(wanted.places(key), spots)))
    return texts.mapInArrow(run, "doc_id bigint, size bigint, shingles binary, fine binary, own binary")


def confirmed_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full ``sets``, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    with arrow_rows(pairs.sparkSession, 256):
        return staged(pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint"), "confirmed")


def several(members: DataFrame) -> DataFrame:
    """(key, main, n, outside, centre) of the buckets of ``members`` (key, doc_id, component) with several components."""
    by = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.min_by("doc_id", F.xxhash64("doc_id", "key", "component")).alias("centre"))
    sizes = by.groupBy("key").agg(F.max_by(F.struct("component", "centre"), F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("outside"))
    return sizes.where("outside > 0").select("key", F.col("top.component").alias("main"), F.col("top.centre").alias("centre"), "n", "outside")


def leftovers(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in the same bucket whose fine sketches allow the similarity.

    ``members``: (key, doc_id, component) of buckets.
    """
    sizes = staged(several(members), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    joined = members.join(sizes, "key").join(sets.select("doc_id", "size", "fine", "own"), "doc_id")
    joined = joined.withColumn("rb", F.ceil(F.col("n") / BLOCK)).withColumn("lb", F.ceil(F.col("outside") / BLOCK))
    number = lambda salt, of: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(of) - 1))
    payload = ["key", "doc_id", "component", "main", "fine", "own", "size"]
    left = joined.where("component <> main").select(*payload, F.lit(True).alias("left"), number("left", "lb").alias("l"), every("rb").alias("r"))
    right = joined.select(*payload, F.lit(False).alias("left"), number("right", "rb").alias("r"), every("lb").alias("l"))
    groups = max(1, int(total // 4096))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, bucket in frame.groupby("key", sort=False):
            sides = [bucket[bucket["left"]], bucket[~bucket["left"]]]
            if not len(sides[0]) or not len(sides[1]):
                continue
            fa, fb = (np.frombuffer(b"".join(s["fine"]), dtype=np.uint8).reshape(-1, FINE) for s in sides)
            ka, kb = (np.frombuffer(b"".join(s["own"]), dtype=np.int64).reshape(-1, BANDS) for s in sides)
            (ia, ib), (ca, cb), (na, nb) = ([s[c].to_numpy() for s in sides] for c in ("doc_id", "component", "size"))
            outside, here = cb != sides[1]["main"].to_numpy(), (kb == key).any(axis=1)
            for i in np.flatnonzero((ka == key).any(axis=1)):
                # two rows outside the main component meet twice, once on either side
                at = np.flatnonzero(here & (cb != ca[i]) & (~outside | (ib > ia[i])))
                at = at[may_reach(fa[i], fb[at], na[i], nb[at], percent / 100)]
                at = at[~np.isin(kb[at], ka[i][ka[i] < key]).any(axis=1)]
                out.append(np.stack([np.minimum(ia[i], ib[at]), np.maximum(ia[i], ib[at])], axis=1))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]}).drop_duplicates()

    both = left.unionByName(right).withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)))
    return both.groupBy("g", "l", "r").applyInPandas(meet, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    sketched = staged(sketches(docs, n, id_col, text_col), "sketches")
    some = sketched.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = some.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("mins").alias("mins"))
    reps = staged(classes, "classes")
    # an id with several texts represents several sets; it is joined to itself by its id
    buckets = reps.select("doc_id", F.explode("keys").alias("key"))
    centres = staged(buckets.groupBy("key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a"), "centres")
    spread = staged(buckets.join(centres, "key"), "buckets")
    discard(centres)
    pairs = staged(likely(spread.where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct(), reps, percent).distinct(), "pairs")
    paired = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = staged(full_sets(docs, paired, n, id_col, text_col), "sets")
    links = confirmed_sets(pairs, sets, percent)
    discard(pairs, sets)
    first = components(links)
    label, own, members, sets = first, first.select(F.col("component").alias("a"), F.col("node").alias("b")), spread, None
    for step in range(STAR_ROUNDS + 1):
        known = label.select(F.col("node").alias("doc_id"), "component")
        named = members.select("key", "doc_id").join(known, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        split = staged(several(named), "several")
        before, members = members, staged(named.join(split.select("key"), "key", "left_semi"), "members")
        discard(before)
        if sets is None:
            sets = staged(full_sets(docs, members.select("doc_id").distinct(), n, id_col, text_col), "sets")
        if step < STAR_ROUNDS:
            star = members.join(split, "key").where("component <> main").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
        else:
            star = leftovers(members, sets, percent)
        star = staged(star, "pairs")
        own = own.unionByName(confirmed_sets(star, sets, percent))
        discard(split, star)
        if step < STAR_ROUNDS:
            label = components(own)
    discard(members, sets)
    # ids with texts of several sets link the sets' representatives
    any_set = F.coalesce("set_key", F.lit(b""))
    mixed = sketched.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(any_set).alias("least"), F.max(any_set).alias("most")).where("least <> most").select("doc_id")
    mixed = staged(some.select("doc_id", "set_key").join(mixed, "doc_id", "left_semi"), "mixed")
    some_mixed = not mixed.isEmpty()
    if some_mixed:
        own = own.unionByName(mixed.join(reps.select("set_key", F.col("doc_id").alias("rep")), "set_key").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    label = components(own).select("node", "component")
    # a class has its component once; its copies get it by the set, not as links of their own
    of_set = reps.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").where("component is not null or last <> doc_id").select("set_key", F.coalesce("component", "doc_id").alias("_of_set"))
    out = sketched.select("doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left").select("doc_id", "n_shingles", "_of_set")
    component = F.coalesce("_of_set", "doc_id")
    if some_mixed:
        of_id = label.join(mixed.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("doc_id"), F.col("component").alias("_of_id"))
        out, component = out.join(of_id, "doc_id", "left"), F.coalesce("_of_id", "_of_set", "doc_id")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document represents its group. Null ids stay.

    Of rows that repeat an id the one with the smallest text stays (null counts as empty; of equal texts, any).
    """
    found = near_duplicates(docs, n, percent, id_col, text_col).where(F.col("doc_id").isNotNull())
    gone = staged(found.groupBy(F.col("doc_id").alias("_near_id")).agg(F.min("kept").alias("_stays"), F.count(F.lit(1)).alias("_rows")).where("not _stays or _rows > 1"), "gone")
    names, key = [column(c) for c in docs.columns], column(id_col)
    listed = Members(gone, "_near_id").may_hold(docs.sparkSession, key)
    hits = docs.where(listed)
    stay = docs.where(~listed).unionByName(hits.join(gone, key == F.col("_near_id"), "left_anti"))
    again = gone.where("_stays").select("_near_id")
    if not again.isEmpty():
        one = hits.join(again, key == F.col("_near_id"), "left_semi").groupBy(key.alias("_near_id")).agg(F.min_by(F.struct(*names), F.coalesce(column(text_col), F.lit(""))).alias("_row"))
        stay = stay.unionByName(one.select(*[F.col("_row")[c].alias(c) for c in docs.columns]))
    return stay
