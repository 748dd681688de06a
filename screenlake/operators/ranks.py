"""Running sums and exact quantiles that no single task has to do: rows are cut into value ranges, and only ranges are put in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges a column is cut into at most; the driver holds one number for each.
MOST_RANGES = 256
#: Values of an interval that are fetched and sorted instead of being cut further.
FEW = 1 << 15


def range_cuts(df: DataFrame, column: str, ranges: int | None = None) -> list:
    """Values that cut ``column`` into ranges of about equally many rows."""
    ranges = ranges or min(MOST_RANGES, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = df.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    return sorted(set(cuts or []))


def range_number(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts are below the value, found by halving; 0 for NULL."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > F.lit(cuts[middle]), among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(cuts))


def running_sums(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], ties: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with the running sums ``values`` (name -> summand) of each key in the order of a column, the row itself included.

    The order's values are cut into ranges, summed by key and range, and those few sums are accumulated; rows
    are put in order only within their key and range. So a key with most rows is as many tasks as it has ranges. Rows that tie
    in ``order`` and ``ties`` are added in any order; NULL comes first.
    """
    cut = df.withColumns({"_range": range_number(F.col(order), range_cuts(df, order, ranges)), **{f"_v_{n}": v for n, v in values.items()}})
    per = cut.groupBy(*keys, "_range").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values))
    listed = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_range", *(f"_s_{n}" for n in values)))).alias("_all"))  # one entry a range


    def sum_before(x: Column, n: str) -> Column:
        zero = F.lit(0).cast(per.schema[f"_s_{n}"].dataType)
        return F.aggregate(F.filter("_all", lambda y: y["_range"] < x["_range"]), zero, lambda a, y: (a + F.coalesce(y[f"_s_{n}"], zero)).cast(per.schema[f"_s_{n}"].dataType))

    before = F.transform("_all", lambda x: F.struct(x["_range"].alias("_range"), *(sum_before(x, n).alias(f"_b_{n}") for n in values)))
    offsets = listed.select(*keys, F.inline(before))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "_range"]]
    joined = cut.alias("c").join(offsets.alias("o"), same).select("c.*", *(f"_b_{n}" for n in values))
    w = Window.partitionBy(*keys, "_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*df.columns, *((F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(w)).alias(n) for n in values))


def numbered_across(df: DataFrame, keys: list[str], order: str, name: str = "rn", **options) -> DataFrame:
    """``df`` with each row's number within its key, for keys that may hold most rows."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")}, **options)


@dataclass
class Interval:
    """Values strictly between ``low`` and ``high`` (None: no bound), with ``below`` values up to ``low`` and ``inside`` in it."""

    column: str
    low: float | None
    high: float | None
    below: int
    inside: int

    def holds(self) -> Column:
        v = F.col(self.column)
        out = F.lit(True)
        if self.low is not None:
            out = out & (v > self.low)
        return out & (v < self.high) if self.high is not None else out


def nth_values(df: DataFrame, wanted: dict[str, list[int]], counts: dict[str, int], few: int = FEW, accuracy: int = 1000) -> dict[tuple[str, int], float]:
    """The values at 0-based ranks of double columns, exactly, by repeated counting of ranges.

    Each round proposes two cuts around every rank from approximate quantiles, then counts what lies below, at and
    between them: the rank is one of the cuts, or in one of three smaller intervals. An interval of ``few`` values or
    less is fetched. Only counts, cuts and such short lists leave the tasks, however many values or ties there are.
    """
    found: dict[tuple[str, int], float] = {}
    open_ = {(c, r): Interval(c, None, None, 0, counts[c]) for c, ranks in wanted.items() for r in ranks}
    while open_:
        small = {k: i for k, i in open_.items() if i.inside <= few}
        large = {k: i for k, i in open_.items() if i.inside > few}
        lists = list({(i.column, i.low, i.high): i for i in small.values()}.values())
        asked = [F.sort_array(F.collect_list(F.when(i.holds(), F.col(i.column)))) for i in lists]
        shares = {k: (k[1] - i.below) / i.inside for k, i in large.items()}
        asked += [F.percentile_approx(F.when(large[k].holds(), F.col(k[0])), [max(0.0, s - 2 / accuracy), min(1.0, s + 2 / accuracy)], accuracy) for k, s in shares.items()]
        row = list(df.agg(*asked).first())
        values = {(i.column, i.low, i.high): v for i, v in zip(lists, row)}
        for k, i in small.items():
            found[k] = values[i.column, i.low, i.high][k[1] - i.below]
        pairs = dict(zip(shares, row[len(lists) :]))
        counted = []
        for k, (a, b) in pairs.items():
            v, inside = F.col(k[0]), large[k].holds()
            counted += [F.count_if(inside & (v < a)), F.count_if(inside & (v == a)), F.count_if(inside & (v > a) & (v < b)), F.count_if(inside & (v == b))]
        row = list(df.agg(*counted).first()) if counted else []
        open_ = {}
        for n, (k, (a, b)) in enumerate(pairs.items()):
            i, at = large[k], k[1] - large[k].below
            under, at_a, between, at_b = row[4 * n : 4 * n + 4]
            if a == b:
                at_b = 0
            if at < under:
                open_[k] = Interval(i.column, i.low, a, i.below, under)
            elif at < under + at_a:
                found[k] = a
            elif at < under + at_a + between:
                open_[k] = Interval(i.column, a, b, i.below + under + at_a, between)
            elif at < under + at_a + between + at_b:
                found[k] = b
            else:
                past = under + at_a + between + at_b
                open_[k] = Interval(i.column, b, i.high, i.below + past, i.inside - past)
    return found


def quantiles(df: DataFrame, shares: dict[str, list[float]], few: int = FEW) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of numeric columns (column -> shares); None without a value. NULL and NaN don't count."""
    values = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in shares))
    counts = values.agg(*(F.count(c).alias(c) for c in shares)).first().asDict()
    places = {c: [(counts[c] - 1) * s for s in ss] for c, ss in shares.items()}
    wanted = {c: sorted({r for p in ps for r in (int(p), min(int(p) + 1, counts[c] - 1))}) for c, ps in places.items() if counts[c]}
    at = nth_values(values, wanted, counts, few)
    between = lambda c, p: at[c, int(p)] * (int(p) + 1 - p) + at[c, min(int(p) + 1, counts[c] - 1)] * (p - int(p))
    return {c: [between(c, p) if counts[c] else None for p in ps] for c, ps in places.items()}
