"""Column profiles of a growing table from sketches of its parts: a new part is read once, the others not again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of the quantile sketches; ranks of quantiles are off by about 0.5 % of the rows. Values tracked for the most frequent one.
KLL, TRACKED = 600, 1000
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def sketched(df: DataFrame, part: Column) -> DataFrame:
    """(part, column_name, is_number, n_rows, n, mean, m2, low, high, kll, hll, top) of every column of ``df`` in every part, in one pass.

    Numbers (NaN as NULL) have a mean, a sum of squared deviations m2, bounds and a quantile sketch; other columns, as
    text, bounds and a sketch of the most frequent values. All have a sketch of how many values differ.
    """

    def one(f: T.StructField) -> Column:
        c, is_number = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)
        v = F.nanvl(c.cast("double"), F.lit(None)) if is_number else c.cast("string")
        none = lambda kind: F.lit(None).cast(kind)
        numbers = (F.avg(v), F.var_pop(v) * F.count(v), F.kll_sketch_agg_double(v, KLL)) if is_number else (none("double"), none("double"), none("binary"))
        top = none("string") if is_number else v
        named = {"column_name": F.lit(f.name), "is_number": F.lit(is_number), "n_rows": F.count(F.lit(1)), "n": F.count(v), "mean": numbers[0], "m2": numbers[1]}
        ends = {"low_number": F.min(v) if is_number else none("double"), "high_number": F.max(v) if is_number else none("double"), "low": none("string") if is_number else F.min(v), "high": none("string") if is_number else F.max(v)}
        sketches = {"kll": numbers[2], "hll": F.hll_sketch_agg(v.cast("string")), "top": F.call_function("approx_top_k_accumulate", top, F.lit(TRACKED))}
        return F.struct(*(x.alias(n) for n, x in (named | ends | sketches).items()))

    return df.groupBy(part.alias("part")).agg(F.array(*map(one, df.schema.fields)).alias("_x")).select("part", F.inline("_x"))


def update(df: DataFrame, part: Column, path: str) -> None:
    """Write the sketches of the parts that ``df`` has rows of, in place of those that the profile held of them."""
    sketched(df, part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def held(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(parts: DataFrame) -> DataFrame:
    """The profile of the whole table from its parts' sketches: (column_name, n, n_null, mean, sd, low, high, quartiles, n_distinct, top, n_top).

    Counts, mean, sd and bounds are exact; quartiles are values whose rank is near (see KLL), n_distinct is an estimate, and
    top the most frequent value of a column that isn't a number, with its estimated number of rows.
    """
    n, total = F.sum("n"), F.sum(F.col("mean") * F.col("n"))
    agg = parts.groupBy("column_name", "is_number").agg(n.alias("n"), F.sum("n_rows").alias("_rows"), F.try_divide(total, n).alias("mean"), F.collect_list(F.struct("n", "mean", "m2")).alias("_parts"), F.min("low_number").alias("_low"), F.max("high_number").alias("_high"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("kll").alias("_kll"), F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("n_distinct"), F.get(F.expr(f"approx_top_k_estimate(approx_top_k_combine(top, {TRACKED}), 1)"), F.lit(0)).alias("_top"))  # a row a part
    apart = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + F.coalesce(p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")), F.lit(0.0)))
    some = F.col("is_number") & (F.col("n") > 0)
    quartiles = [F.when(some, F.kll_sketch_get_quantile_double("_kll", F.lit(s))).alias(q) for q, s in QUARTILES.items()]
    bound = lambda number, text: F.when(F.col("is_number"), F.col(number).cast("string")).otherwise(F.col(text))
    return agg.select("column_name", "n", (F.col("_rows") - F.col("n")).alias("n_null"), "mean", F.when(some & (F.col("n") > 1), F.sqrt(apart / (F.col("n") - 1))).alias("sd"), bound("_low", "low").alias("low"), bound("_high", "high").alias("high"), *quartiles, "n_distinct", F.when(~F.col("is_number"), F.col("_top.item")).alias("top"), F.when(~F.col("is_number"), F.col("_top.count")).alias("n_top"))
