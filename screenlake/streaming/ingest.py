"""File streams that can be killed and run again: result lines into a table, each result once; scores and token estimates.

A stream's state is its checkpoint, which numbers the batches. All that a batch writes carries its number and replaces what
the same batch wrote before, so a batch that is repeated after a failure, wherever it was cut off, leaves one copy.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.documents import RESULT, ingested, scored, tokens_of

#: Parts of a results table by the hash of the request's id. Fixed when a table is made.
BUCKETS = 32


def written(spark: SparkSession, table: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def replace_parts(df: DataFrame, path: str, *by: str) -> None:
    """Write ``df`` in place of the parts (values of ``by``) that it has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def bucket_of(custom_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(custom_id), F.lit(buckets)).cast("int")


def held_results(spark: SparkSession, root: str, schema: T.StructType, buckets: list[int], but: int) -> DataFrame:
    """The results in these buckets that other batches than ``but`` saved; other buckets aren't read."""
    whole = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(whole).parquet(f"{root}/results").where(F.col("bucket").isin(buckets) & (F.col("batch") != but))


def save_batch(lines: DataFrame, batch: int, root: str, buckets: int = BUCKETS) -> None:
    """One batch of result lines: new results, rejected lines, and last of all the batch's record.

    Of several results of a request the one whose text sorts first counts, in whatever order they landed; one that an
    earlier batch saved stays. Lines without a request id are kept as they came.
    """
    spark = lines.sparkSession
    lines = lines.persist()
    try:
        rows = ingested(lines)
        names = [c for c in rows.columns if c != "custom_id"]
        new = rows.groupBy("custom_id").agg(F.min_by(F.struct(*names), F.to_json(F.struct(*names))).alias("row")).select("custom_id", *(F.col("row")[c].alias(c) for c in names)).withColumn("bucket", bucket_of(F.col("custom_id"), buckets))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if touched and written(spark, f"{root}/results"):
            new = new.join(held_results(spark, root, rows.schema, touched, batch).select("custom_id"), "custom_id", "left_anti")
        replace_parts(new.withColumn("batch", F.lit(batch).cast("bigint")), f"{root}/results", "bucket", "batch")
        bad = lines.where(F.from_json("value", RESULT)["custom_id"].isNull()).select("value", F.lit(batch).cast("bigint").alias("batch"))
        replace_parts(bad, f"{root}/rejected", "batch")
        n = F.count(F.lit(1))
        record = lines.agg(n.alias("n_lines"), F.count_if(F.from_json("value", RESULT)["custom_id"].isNull()).alias("n_rejected")).withColumns({"saved_at": F.current_timestamp(), "batch": F.lit(batch).cast("bigint")})
        replace_parts(record, f"{root}/batches", "batch")
    finally:
        lines.unpersist()


def ingest_available(spark: SparkSession, source: str, root: str, checkpoint: str, max_files: int = 1000, save: Callable[[DataFrame, int, str], None] = save_batch) -> None:
    """Parse the result files that have landed into ``root``: results, rejected and batches.

    A result is looked up only in its bucket of the table, so no state grows with the stream.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(source)
    lines.writeStream.foreachBatch(lambda df, batch: save(df, batch, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def results(spark: SparkSession, root: str) -> DataFrame:
    """The saved results without the columns that place them."""
    return spark.read.parquet(f"{root}/results").drop("bucket", "batch")


def score_available(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, scorer: Column | Callable[[pd.Series], pd.Series], text_col: str = "text", max_files: int = 100) -> None:
    """Score the documents that have landed since the last call, up to ``max_files`` files a batch.

    A stopped run goes on with the batch it was in; finished batches aren't scored again.
    """

    def save(df: DataFrame, batch: int) -> None:
        replace_parts(scored(df, scorer, text_col).drop(text_col).withColumn("batch", F.lit(batch).cast("bigint")), out, "batch")

    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    docs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def token_estimates(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str) -> None:
    """Token estimates of the documents that have landed since the last call."""
    docs = spark.readStream.schema(schema).parquet(source)
    tokens_of(docs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
