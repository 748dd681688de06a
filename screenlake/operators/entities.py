"""Versions, sources and crosswalks: which of several rows of a key stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import as_count
from .runs import first_by


def latest_version(versions: DataFrame, key: str = "event", at: str = "created", version: str = "version") -> DataFrame:
    return first_by(versions, [key], F.desc(at), F.desc(version))


def dedup_with_preferred(versions: DataFrame, preferred: Column, key: str = "event", at: str = "created", version: str = "version") -> DataFrame:
    """The latest version of each event, overwritten column by column with the preferred one's values that aren't NULL."""
    latest = latest_version(versions, key, at, version)
    best = latest_version(versions.where(preferred), key, at, version)
    other = [c for c in versions.columns if c != key]
    best = best.select(key, *[F.col(c).alias(f"_p_{c}") for c in other])
    return latest.join(best, key, "left").select(key, *[F.coalesce(f"_p_{c}", c).alias(c) for c in other])


def refine_crosswalk(pairs: DataFrame) -> DataFrame:
    """Each entity's best code: most observations, then the smallest code. ``pairs``: (entity, code, obs)."""
    return first_by(pairs, ["entity"], F.desc("obs"), F.asc("code"))


def key_uniqueness(df: DataFrame, key: str, partner: str, unique: bool = False) -> DataFrame:
    """Keys with several rows: rows and different partners.

    ``unique``: no two rows have the same key and partner, as after grouping by both; partners are then counted without grouping by both again.
    """
    partners = F.count(partner) if unique else F.count_distinct(partner)
    return df.groupBy(key).agg(as_count(F.count(F.lit(1))).alias("n_rows"), as_count(partners).alias("n_partners")).where("n_rows > 1")


def pairing_report(df: DataFrame, left: str, right: str) -> DataFrame:
    """A row for each side of the pairing: keys, keys with several rows and their rows, keys with several partners, and the most partners."""
    pairs = df.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))  # so that a frequent key is counted by its partners

    def side(key: str) -> DataFrame:
        per = pairs.groupBy(key).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("partners"))
        many = F.col("rows") > 1
        return per.agg(as_count(F.count(F.lit(1))).alias("n_keys"), as_count(F.count_if(many)).alias("n_repeated"), as_count(F.coalesce(F.sum(F.when(many, F.col("rows"))), F.lit(0))).alias("n_rows"), as_count(F.count_if(F.col("partners") > 1)).alias("n_ambiguous"), as_count(F.max("partners")).alias("most_partners")).select(F.lit(key).alias("side"), "*")

    return side(left).unionByName(side(right))


def distinct_counts(df: DataFrame) -> DataFrame:
    """Rows before and after whole repeated rows are dropped, in one pass."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(as_count(F.coalesce(F.sum("_n"), F.lit(0))).alias("n_before"), as_count(F.count(F.lit(1))).alias("n_after"))


def stacked(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Both tables under each other, columns that one lacks as NULL, with their source's name."""
    a, b = (df.withColumn("source", F.lit(n)) for df, n in zip((first, second), names))
    return a.unionByName(b, allowMissingColumns=True)


def enriched(df: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """A left lookup that cannot multiply rows: of a key that the dimension repeats no row is used."""
    once = dim.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in dim.columns if c not in on]).where("_n = 1").drop("_n")
    return df.join(once, on, "left")


def clean_ranges(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values outside of their column's bounds (inclusive) become NULL."""
    out = df
    for name, (low, high) in bounds.items():
        bad = F.lit(False)
        bad = bad | (F.col(name) < low) if low is not None else bad
        bad = bad | (F.col(name) > high) if high is not None else bad
        out = out.withColumn(name, F.when(~bad, F.col(name)))
    return out


def constant_columns(df: DataFrame) -> DataFrame:
    """(column_name, n_values, is_constant) of every column, from one pass."""
    counts = df.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in df.columns])
    listed = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("n_values")) for c in df.columns])
    return counts.select(F.explode(listed).alias("x")).select("x.column_name", "x.n_values", (F.col("x.n_values") <= 1).alias("is_constant"))


def membership_flags(ids: DataFrame, sets: dict[str, DataFrame], on: str = "doc_id") -> DataFrame:
    """A Boolean for each named set: whether the id is in it."""
    out = ids
    for name, members in sets.items():
        out = out.join(members.select(on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out
