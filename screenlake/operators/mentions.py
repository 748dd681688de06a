"""Which texts hold which of very many target strings, through an inverted index of short pieces of the targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece; shorter targets are pieces themselves.
PIECE = 4


def pieces(text: Column, size: int) -> Column:
    """The different pieces of ``size`` characters, found in one walk over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def holding(texts: DataFrame, targets: DataFrame, size: int = PIECE) -> DataFrame:
    """(key, target) for each text of ``texts`` (key, text) and each of the different ``targets`` (target) that it holds.

    Every target waits under one of its pieces, that which the fewest texts have; texts look their pieces up there, and what is
    found is verified in the whole text. Joins are on pieces and keys only, so nothing is compared with everything, and only
    keys travel with the pieces, a row for each different piece of a text. Case counts: lower both sides before. NULL and empty targets are in no text.
    """
    targets = targets.where("target <> ''").select("target").distinct()
    sizes = sorted(r[0] for r in targets.select(F.least(F.length("target"), F.lit(size)).alias("n")).distinct().collect())  # ``size`` numbers at most
    none = F.array().cast("array<string>")
    own = none
    for n in sizes:
        own = F.when(F.length("target") >= n, pieces(F.col("target"), n)).otherwise(own)
    of_target = targets.select("target", F.explode(own).alias("piece"))
    of_text = texts.select("key", F.explode(F.concat(none, *(pieces(F.col("text"), n) for n in sizes))).alias("piece"))
    frequent = of_text.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    anchors = of_target.join(frequent, "piece", "left").groupBy("target").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    maybe = of_text.hint("merge").join(anchors, "piece").select("key", "target")  # many more rows than its source's size tells, so never broadcast
    return maybe.join(texts.select("key", "text"), "key").where(F.contains("text", F.col("target"))).select("key", "target").distinct()


def hits(df: DataFrame, column: str, targets: DataFrame) -> DataFrame:
    """(target, hits): rows equal to each target of a table (target), or if there are none, rows that hold it; case is ignored.

    Equal values of the column are counted first. Repeated targets are one; targets that differ by case only have a row each.
    """
    texts = df.where(F.col(column).isNotNull()).groupBy(F.lower(column).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    named = targets.where("target IS NOT NULL").select("target", F.lower("target").alias("plain")).distinct()
    found = holding(texts.select(F.col("text").alias("key"), "text"), named.select(F.col("plain").alias("target"))).withColumnRenamed("key", "text").join(texts, "text")
    equal = F.col("text") == F.col("target")
    counted = found.groupBy(F.col("target").alias("plain")).agg(F.sum(F.when(equal, F.col("n"))).alias("equal"), F.sum("n").alias("within"))
    return named.join(counted, "plain", "left").select("target", F.coalesce("equal", "within", F.lit(0)).cast("bigint").alias("hits"))
