"""Helpers that several operators share: the shared folder, folds, batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a session on one machine gets a new local folder; a cluster has none to take.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; ``by``: its last column, with a folder for each value.

    This cuts the lineage: a lost executor costs no more than its unfinished tasks.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables that no later step reads; anything else is left alone."""
    for df in tables:
        path = getattr(df, "staged_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids have a null fold."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(folds))


def unit_hash(*cols: Column) -> Column:
    """A double in [0, 1) from the md5 of the columns as text, the same in any engine: 52 bits."""
    key = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def sample_by_hash(df: DataFrame, key: Column, group: str, per_group: int, seed: str, most_groups: int = 1000) -> DataFrame:
    """At most ``per_group`` rows of each of the ``most_groups`` most frequent values of ``group``.

    They are those with the smallest hashes of ``key``, one row for each hash, so rows that repeat a key are
    one. Rows are first thinned at rates from the counts of all rows: a group, however large, reaches the
    ranking as about twice ``per_group`` rows.
    """
    hashed = df.withColumn("_u", unit_hash(F.lit(seed), key))
    keys = hashed.groupBy(group).agg(F.approx_count_distinct("_u").alias("_keys"), F.count(F.lit(1)).alias("_rows"))
    rates = keys.orderBy(F.desc("_rows"), group).limit(most_groups).select(F.col(group).alias("_group"), (F.lit(2.0 * per_group + 20) / F.greatest("_keys", F.lit(1))).alias("_rate"))
    drawn = hashed.join(F.broadcast(rates), F.col(group).eqNullSafe(F.col("_group"))).where(F.col("_u") < F.col("_rate")).dropDuplicates(["_group", "_u"])
    order = Window.partitionBy("_group").orderBy("_u")
    return drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_group).drop("_u", "_group", "_rate", "_n")


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def taken(df: DataFrame, **names: str) -> DataFrame:
    """The named columns of ``df`` alone, by their new names; a column that differs from them in case only is no clash."""
    place = {c.lower(): i for i, c in reversed([*enumerate(df.columns)])} | {c: i for i, c in enumerate(df.columns)}
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(F.col(f"c{place.get(c, place.get(c.lower()))}").alias(n) for n, c in names.items()))


def others(df: DataFrame, *replaced: str) -> list:
    """The fields of ``df`` that a result with the columns ``replaced`` keeps (Spark's names ignore case)."""
    lower = {r.lower() for r in replaced}
    return [f for f in df.schema.fields if f.name.lower() not in lower]


class Members:
    """A Bloom filter of the ids of a table: ``mask`` and ``may_hold`` are true for each of them and for few others.

    It has BITS bits an id, MOST at most in all (32 MB on the driver and in each task), whatever the table's
    size; a larger table has more false hits, so what reads it must be right with any number of them. Ids
    are hashed and merged to bitmaps in tasks; only the bitmaps reach the driver.
    """

    BITS, MOST, HASHES = 16, 1 << 28, 3

    def __init__(self, ids: DataFrame, id_col: str = "doc_id"):
        want = max(1 << 15, min(self.MOST, self.BITS * ids.count()))
        self.size = 1 << (want - 1).bit_length()
        spots = ids.select(F.explode(F.array(*self.places(column(id_col)))).alias("p"))
        maps = spots.groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits")).collect()
        self.bits = np.zeros(self.size >> 3, dtype=np.uint8)
        for r in maps:  # 4 KB each
            self.bits[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], dtype=np.uint8)

    def places(self, key: Column) -> list[Column]:
        a, b = (F.pmod(F.xxhash64(key.cast("bigint"), F.lit(i)), F.lit(self.size)) for i in (1, 2))
        return [F.pmod(a + b * j, F.lit(self.size)) for j in range(self.HASHES)]

    def mask(self, places: list[np.ndarray]) -> np.ndarray:
        out = np.ones(len(places[0]), dtype=bool)
        for p in places:
            out &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def may_hold(self, spark: SparkSession, key: Column) -> Column:
        """The same as an expression; the bitmap is one scalar value, read once by each task."""
        bits = spark.createDataFrame([(self.bits.tobytes(),)], "bits binary").scalar()
        out = key.isNotNull()
        for p in self.places(key):
            byte = F.conv(F.hex(F.substring(bits, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
            out = out & (F.pmod(F.floor(byte / F.pow(F.lit(2.0), p.bitwiseAND(F.lit(7)))), F.lit(2)) == 1)
        return F.coalesce(out, F.lit(False))


def tidy() -> None:
    """Hand freed memory back, so that a worker that later tasks use again doesn't keep this one's most."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], name: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of text, at least one row."""
    for batch in batches:
        total = start = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_pylist()
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
    tidy()


def with_text_columns(docs: DataFrame, text_col: str, added: list[T.StructField], start: Callable[[], Callable[[pa.Array], list]], limit: int = 2 << 20) -> DataFrame:
    """``docs`` with the columns ``added``, computed from the texts; columns of these names are replaced.

    ``start`` makes, in each task, the function from a slice's texts (about ``limit`` bytes) to the added columns.
    Between, columns have numbers for names, as Spark's own functions for Python don't take every name.
    """
    kept = others(docs, *(f.name for f in added))
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*kept, *added])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in text_slices(batches, "text", limit):
            values = compute(batch.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *values], inner.names)

    numbered = docs.select(*(column(f.name).alias(f"c{i}") for i, f in enumerate(kept)), column(text_col).alias("text"))
    return numbered.mapInArrow(run, inner).toDF(*(f.name for f in [*kept, *added]))
