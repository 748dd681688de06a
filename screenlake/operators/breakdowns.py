"""Rates by group, quantile, year and code hierarchy, and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import as_count, bin_label, percent, rounded, wilson
from .ranks import quantiles, range_number


def rates(df: DataFrame, by: list[str], flag: str = "flag", mean_of: str | None = None) -> DataFrame:
    """n (flags known), hits, percent and the Wilson interval of each group."""
    extra = [rounded(F.avg(mean_of)).alias(f"mean_{mean_of}")] if mean_of else []
    agg = df.groupBy(*by).agg(as_count(F.count(flag)).alias("n"), as_count(F.coalesce(F.sum(F.col(flag).cast("int")), F.lit(0))).alias("hits"), *extra)
    return with_interval(agg)


def with_interval(df: DataFrame) -> DataFrame:
    low, high = wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    return df.withColumns({"pct": rounded(percent(F.col("hits"), F.col("n"))), "ci_low": rounded(low), "ci_high": rounded(high)})


def quantile_bins(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """``df`` with bin 1 .. ``bins``: right-closed between interpolated exact quantiles; equal edges count once; NULL has none."""
    edges = sorted({e for e in quantiles(df, {value: [i / bins for i in range(1, bins)]})[value] if e is not None})
    v = F.col(value).cast("double")
    return df.withColumn("bin", F.when(v.isNotNull() & ~F.isnan(v), 1 + range_number(v, edges)).cast("bigint"))


def prefix_rates(codes: DataFrame, segments: DataFrame) -> DataFrame:
    """Counts of codes summed into segments by their prefixes; a code counts once in a segment.

    ``codes``: (code, n, hits); ``segments``: a short list (segment, prefix), which is broadcast.
    """
    lengths = F.explode(F.sequence(F.lit(1), F.length("code")))
    heads = codes.withColumn("_l", lengths).withColumn("prefix", F.col("code").substr(F.lit(1), F.col("_l")))
    hit = heads.join(F.broadcast(segments), "prefix").dropDuplicates(["segment", "code"])
    return with_interval(hit.groupBy("segment").agg(as_count(F.sum("n")).alias("n"), as_count(F.sum("hits")).alias("hits")))


def nearest_ancestor(codes: DataFrame, names: DataFrame, least: int = 2) -> DataFrame:
    """Each code's own name, or its longest named prefix's."""
    heads = codes.select("code").distinct().withColumn("length", F.explode(F.expr(f"sequence(length(code), {least}, -1)"))).withColumn("ancestor", F.expr("substring(code, 1, length)"))
    found = heads.join(names.select(F.col("code").alias("ancestor"), "name"), "ancestor")
    return found.groupBy("code").agg(F.max_by(F.struct("ancestor", "name"), "length").alias("x")).select("code", "x.ancestor", "x.name")


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts in ``bins`` equal bins from the least to the greatest value, empty bins too, the last bin closed."""
    by = by or []
    known = df.where(F.col(value).isNotNull())
    ends = known.agg((F.min(value) if low is None else F.lit(float(low))).cast("double").alias("lo"), (F.max(value) if high is None else F.lit(float(high))).cast("double").alias("hi")).where("lo IS NOT NULL")
    number = F.when(F.col("hi") > F.col("lo"), F.least(F.width_bucket(F.col(value).cast("double"), F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins))).otherwise(F.lit(1)).cast("bigint")
    counted = known.crossJoin(F.broadcast(ends)).withColumn("bin", number).groupBy(*by, "bin").agg(as_count(F.count(F.lit(1))).alias("n"))  # one row on the right
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))))
    frame = known.select(*by).distinct().crossJoin(F.broadcast(every)) if by else every  # a row a bin on the right
    step = (F.col("hi") - F.col("lo")) / bins
    out = frame.join(counted, [*by, "bin"], "left")
    return out.select(*by, "bin", bin_label(F.col("lo") + (F.col("bin") - 1) * step, F.col("lo") + F.col("bin") * step, F.col("bin") == bins).alias("label"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def histogram_one_point(df: DataFrame, value: str) -> DataFrame:
    """Counts in bins of width 1 from floor(min) to ceil(max) + 1, empty bins too; the last bin is closed."""
    known = df.where(F.col(value).isNotNull())
    ends = known.agg(F.floor(F.min(value)).cast("bigint").alias("lo"), F.ceil(F.max(value)).cast("bigint").alias("hi")).where("lo IS NOT NULL")
    counted = known.groupBy(F.floor(value).cast("bigint").alias("bin")).agg(as_count(F.count(F.lit(1))).alias("n"))
    every = ends.select(F.explode(F.sequence("lo", "hi")).alias("bin"))  # edges lo .. hi + 1, so the last bin starts at hi
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def nested_group(audited: Column, validated: Column, flagged: Column) -> Column:
    """The smallest of the nested sets that holds the row."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    return F.when(sure(audited), F.lit("audited")).when(sure(validated), F.lit("validated")).when(sure(flagged), F.lit("flagged")).otherwise(F.lit("corpus"))


def tie_aware_bins(df: DataFrame, score: str, key: str, top: int, bottom: int) -> DataFrame:
    """top / middle / bottom by the scores at the cut ranks; all that tie with a cut fall on its side.

    The two cuts come from bounded top-k reports, so nothing is sorted as a whole.
    """
    known = df.where(F.col(score).isNotNull())
    best = known.select(F.col(score).alias("s")).orderBy(F.desc("s")).limit(top).agg(F.min("s").alias("top_cut"))
    worst = known.select(F.col(score).alias("s")).orderBy("s").limit(bottom).agg(F.max("s").alias("bottom_cut"))
    cuts = best.crossJoin(worst)  # one row each
    return known.crossJoin(F.broadcast(cuts)).withColumn("bin", F.when(F.col(score) >= F.col("top_cut"), F.lit("top")).when(F.col(score) <= F.col("bottom_cut"), F.lit("bottom")).otherwise(F.lit("middle"))).drop("top_cut", "bottom_cut")


def leaderboard(df: DataFrame, group: str, entity: str, flag: str, best: int) -> DataFrame:
    """The ``best`` entities of each group by number of rows, with their flag rate. Entities are counted first."""
    per = df.groupBy(group, entity).agg(as_count(F.count(F.lit(1))).alias("n"), as_count(F.sum(F.col(flag).cast("int"))).alias("hits"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.desc("hits"), F.asc(entity))).cast("bigint")
    return per.withColumn("rank", rank).where(F.col("rank") <= best).select(group, entity, "rank", "n", "hits", rounded(percent(F.col("hits"), F.col("n"))).alias("pct"))


def continuous_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, mean, median, low, high, n) of each numeric column; exact medians by counting."""
    medians = quantiles(df, {c: [0.5] for c in columns})
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v"), F.lit(medians[c][0]).cast("double").alias("median")) for c in columns]))
    v = F.col("z.v")
    return df.select(each.alias("z")).groupBy("z.column_name").agg(rounded(F.avg(v)).alias("mean"), rounded(F.first("z.median")).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"), as_count(F.count(v)).alias("n"))


def entity_rankings(df: DataFrame, group: str, entity: str, flag: str, best: int, least: int = 1, salts: int = 64) -> DataFrame:
    """The first ``best`` entities of each group by rows (volume), by flag rate among those with ``least`` rows (rate), and the last by rate (tail).

    Also how many entities the group has and the share of them with a flag. Ranks are taken in parts of a group first, so that a
    group with most entities is ranked by several tasks.
    """
    per = df.groupBy(group, entity).agg(as_count(F.count(F.lit(1))).alias("n"), as_count(F.coalesce(F.sum(F.col(flag).cast("int")), F.lit(0))).alias("hits"))
    whole = per.groupBy(group).agg(as_count(F.count(F.lit(1))).alias("n_entities"), rounded(percent(F.count_if(F.col("hits") > 0), F.count(F.lit(1)))).alias("flagged_share"))
    rate = F.col("hits") / F.col("n")
    enough = F.col("n") >= least
    kinds = [("volume", F.lit(True), F.struct(-F.col("n"), -F.col("hits"))), ("rate", enough, F.struct(-rate, -F.col("n"))), ("tail", enough, F.struct(rate, -F.col("n")))]
    out = None
    for name, kept, order in kinds:
        listed = per.where(kept).withColumns({"_o": order, "_salt": F.pmod(F.xxhash64(entity), F.lit(salts)), "ranking": F.lit(name)})
        part = listed.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy("_o", entity))).where(F.col("_r") <= best)
        top = part.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("_o", entity)).cast("bigint")).where(F.col("rank") <= best)
        top = top.select(group, "ranking", "rank", entity, "n", "hits", rounded(percent(F.col("hits"), F.col("n"))).alias("pct"))
        out = top if out is None else out.unionByName(top)
    return out.join(whole, group)
