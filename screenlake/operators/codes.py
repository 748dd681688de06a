"""Industry codes as trees: nodes of (system, level, code) with parents, roll-up along them, names, and membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import as_count, percent

#: Digits of each system's levels. Fixed values.
LEVELS = {"gics": [2, 4, 6, 8], "naics": [2, 3, 4, 5, 6], "sic": [2, 3, 4]}


def prefixes(df: DataFrame, code: str = "code", shortest: int = 1, whole: bool = True) -> DataFrame:
    """``df`` with a row (prefix, length) for each prefix of its code."""
    length = F.length(code) if whole else F.length(code) - 1
    lengths = F.when(length >= shortest, F.sequence(F.lit(shortest), length)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("length", F.explode(lengths)).withColumn("prefix", F.col(code).substr(F.lit(1), F.col("length")))


def listed(names: DataFrame) -> DataFrame:
    """(system, level, code, name) from a classification; a code that it has at several levels is the node of the most specific one."""
    return names.groupBy("system", "code").agg(F.max_by(F.struct("level", "name"), F.struct("level", F.col("name"))).alias("x")).select("system", F.col("x.level").cast("bigint").alias("level"), "code", "x.name")


def tree(names: DataFrame) -> DataFrame:
    """The nodes of a classification with their parent: the longest shorter code that is listed in the system, NULL at the top."""
    nodes = listed(names)
    above = prefixes(nodes.select("system", "code"), whole=False).join(nodes.select("system", F.col("code").alias("prefix")), ["system", "prefix"])
    parents = above.groupBy("system", "code").agg(F.max_by("prefix", "length").alias("parent"))
    return nodes.join(parents, ["system", "code"], "left")


def resolved(whole: DataFrame, nodes: DataFrame) -> DataFrame:
    """``whole`` (system, full, ...) with ``own``: the longest listed code that ``full`` is with zeros behind it, else ``full``."""
    codes = whole.select("system", F.col("full").alias("code")).distinct()
    padded = prefixes(codes).where(F.col("code").substr(F.col("length") + 1, F.length("code")).rlike("^0*$"))
    found = padded.join(nodes.select("system", F.col("code").alias("prefix")), ["system", "prefix"]).groupBy("system", F.col("code").alias("full")).agg(F.max_by("prefix", "length").alias("own"))
    return whole.join(found, ["system", "full"], "left").withColumn("own", F.coalesce("own", "full"))


def hierarchy_rates(df: DataFrame, codes: dict[str, str], names: DataFrame, flag: str = "flag", levels: dict[str, list[int]] = LEVELS) -> DataFrame:
    """Rows and hits of every node of every code system: (system, level, code, name, n, hits, pct), sorted by system, level and falling pct.

    ``codes``: system -> column. Rows are first counted by whole code, then rolled up along the tree. A code without a name
    has its nearest listed ancestor's, with the code, at a system's last level, and else the system and the code.
    """
    nodes = listed(names)
    systems = F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.col(c).alias("full")) for s, c in codes.items()]))
    whole = df.select(systems.alias("c"), F.col(flag).cast("int").alias("f")).where("c.full IS NOT NULL").groupBy("c.system", "c.full").agg(F.count("f").alias("n"), F.coalesce(F.sum("f"), F.lit(0)).alias("hits"))
    lengths = F.create_map(*[x for s in codes for x in (F.lit(s), F.array(*map(F.lit, levels[s])))])
    rolled = resolved(whole, nodes).withColumn("level", F.explode(lengths[F.col("system")])).where(F.length("own") >= F.col("level")).withColumn("code", F.col("own").substr(F.lit(1), F.col("level")))
    summed = rolled.groupBy("system", F.col("level").cast("bigint").alias("level"), "code").agg(as_count(F.sum("n")).alias("n"), as_count(F.sum("hits")).alias("hits"))
    known = summed.join(nodes.select("system", "code", "name"), ["system", "code"], "left")
    last = F.create_map(*[F.lit(x) for s in codes for x in (s, max(levels[s]))])
    lost = known.where(F.col("name").isNull() & (F.col("level") == last[F.col("system")])).select("system", "code")
    heirs = prefixes(lost, whole=False).join(nodes.select("system", F.col("code").alias("prefix"), "name"), ["system", "prefix"]).groupBy("system", "code").agg(F.max_by("name", "length").alias("ancestor"))
    named = known.join(heirs, ["system", "code"], "left").withColumn("name", F.coalesce("name", F.concat("ancestor", F.lit(" (code: "), "code", F.lit(")")), F.concat(F.upper("system"), F.lit(" "), "code")))
    out = named.select("system", "level", "code", "name", "n", "hits", F.round(percent(F.col("hits"), F.col("n")), 2).alias("pct"))
    return out.orderBy("system", "level", F.desc("pct"), "code")


def starts_with_any(code: Column, heads: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(code, F.lit(h)) for h in heads])


def memberships(df: DataFrame, samples: dict[str, dict[str, list[str]]], prefer: tuple[str, ...] = ("sic", "naics", "gics")) -> DataFrame:
    """``df`` with a column for each sample: whether the row's code starts with one of the sample's prefixes.

    ``samples``: name -> system -> prefixes; a system is the column of that name. A sample goes by the first system of
    ``prefer`` that it is declared in and that any row of the whole table has a code of; without one it is NULL.
    """
    have = df.agg(*((F.count(s) > 0).alias(f"_{s}") for s in prefer))

    def member(systems: dict[str, list[str]]) -> Column:
        out = F.lit(None).cast("boolean")
        for s in reversed([p for p in prefer if p in systems]):
            out = F.when(F.col(f"_{s}"), starts_with_any(F.col(s), systems[s])).otherwise(out)
        return out

    return df.crossJoin(F.broadcast(have)).select(*df.columns, *(member(systems).alias(name) for name, systems in samples.items()))  # one row on the right
