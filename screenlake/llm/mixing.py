"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of all characters over its actual share. Each
document's number of copies is drawn from the Poisson distribution with its source's rate: a uniform
number from the md5 of the seed and the document's id is inverted through the distribution function.
A rate above LARGEST is drawn as the sum of independent draws of equal smaller rates, a hash for each.
Copies are exploded into rows of their own and the table is shuffled globally by a hash of seed, id and
copy. All of it is DataFrame functions; the per-source rates are broadcast while they are few.

Cases: sources without a given weight, null included, have ``default_weight``; a source whose texts are
all empty or null has rate 1; documents with a null id are drawn by their text; repeated rows get the
same number of copies; an empty table gives an empty result; columns named copy or position are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, others, staged, unit_hash

#: Beyond this rate exp(-rate) is near underflow (the SQL, which makes a single draw, holds up to it); a larger one is drawn in parts of at most PART.
LARGEST, PART = 700, 500
#: Copies are numbered in blocks, so that no row holds the numbers of all copies of a document.
BLOCK = 100_000
#: Up to so many sources their rates are broadcast; more are joined by the source.
MOST_BROADCAST = 100_000

#: Terms of the distribution function are summed in blocks of this many; see ``poisson``.
TERMS = 24


def rates(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, n_docs, n_chars, rate) for every source."""
    per = docs.groupBy(column(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.length(column(text_col)).cast("bigint")), F.lit(0)).alias("n_chars"))
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    per = per.withColumn("weight", weight)
    total = per.where("n_chars > 0").agg(F.sum("weight").alias("_w"), F.sum("n_chars").alias("_c"))
    rate = F.when(F.col("n_chars") > 0, F.col("weight") * F.col("_c") / (F.col("_w") * F.col("n_chars"))).otherwise(F.lit(1.0))
    return per.crossJoin(F.broadcast(total)).select("source", "n_docs", "n_chars", rate.alias("rate"))  # one row on the right


def poisson(rate: Column, uniform: Column, largest: Column | None = None) -> Column:
    """The inverse of the Poisson distribution function: the least k whose cumulated probability exceeds ``uniform``.

    The sum runs over 0 .. ``largest``, by default so far beyond the rate that what is left out is below
    2**-52, the step of ``uniform``. Rates above LARGEST are refused with an error; ``draws`` splits them.
    """
    top = F.ceil(rate + 10 * F.sqrt(rate) + TERMS) if largest is None else largest
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("below"), F.lit(0).cast("bigint").alias("k"))
    step = lambda s, i: F.when(s["below"] > uniform, s).otherwise(F.struct((s["p"] * rate / i).alias("p"), (s["below"] + s["p"] * rate / i).alias("below"), i.cast("bigint").alias("k")))
    draw = F.aggregate(F.sequence(F.lit(1), top.cast("int")), start, step, lambda s: s["k"])
    return F.when(rate > LARGEST, F.raise_error(F.lit(f"a repetition rate above {LARGEST} cannot be drawn at once"))).when(rate <= 0, F.lit(0).cast("bigint")).otherwise(draw)


def draws(rate: Column, *key: Column) -> Column:
    """The Poisson draw of ``key`` for any rate, a bigint."""
    parts = F.when(rate > LARGEST, F.ceil(rate / PART)).otherwise(1).cast("int")
    uniforms = F.when(rate > LARGEST, F.transform(F.sequence(F.lit(1), parts), lambda i: unit_hash(*key, F.lit("part"), i))).otherwise(F.array(unit_hash(*key)))
    return F.aggregate(uniforms, F.lit(0).cast("bigint"), lambda n, u: n + poisson(rate / parts, u))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", names: tuple[str, str] = ("copy", "position")) -> DataFrame:
    """``docs`` with each row repeated by its draw, in a global random order.

    ``names``: the copy's number (from 0) and the key of the order; columns of these names, in any case, are replaced.
    """
    kept = [f.name for f in others(docs, *names)]
    per = staged(rates(docs, weights, default_weight, source_col, text_col).select(F.col("source").alias("_source"), F.col("rate").alias("_rate")), "rates")
    few = per.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    key = F.coalesce(column(id_col).cast("string"), F.md5(F.coalesce(column(text_col), F.lit(""))))
    whole = docs.select(*(column(c).alias(f"c{i}") for i, c in enumerate(kept)), key.alias("_key"), column(source_col).alias("_of"))
    drawn = whole.join(F.broadcast(per) if few else per, F.col("_of").eqNullSafe(F.col("_source")))
    numbered = drawn.withColumn("_n", draws(F.col("_rate"), F.lit(seed), F.col("_key"))).where("_n > 0").withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(BLOCK).cast("bigint"))))
    some = numbered.withColumn("_copy", F.explode(F.sequence(F.col("_from").cast("int"), (F.least(F.col("_from") + BLOCK, "_n") - 1).cast("int"))))
    keyed = some.withColumn("_position", F.md5(F.concat_ws("|", F.lit(seed), F.col("_key"), F.col("_copy").cast("string"))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.select(*(f"c{i}" for i in range(len(kept))), "_copy", "_position").repartition(parts, "_position").sortWithinPartitions("_position").toDF(*kept, *names)
