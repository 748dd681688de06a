"""Database tables read in parallel by ranges of a key that hold about equally many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Ranges that the key is counted by; the driver holds one count for each.
COUNTED = 1000


def read(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def even_ranges(counts: list[tuple[int, int]], low: int, width: int, rows: int) -> list[tuple[int | None, int | None]]:
    """Half-open ranges of the key (None: unbounded) of at most ``rows`` rows each, as far as single counted ranges allow.

    ``counts``: (number of a counted range, rows in it); range k starts at low + k * width.
    """
    cuts, held = [], 0
    for number, n in sorted(counts):
        if held and held + n > rows:
            cuts.append(low + number * width)
            held = 0
        held += n
    ends = [None, *cuts, None]
    return list(zip(ends, ends[1:]))


def table(spark: SparkSession, url: str, name: str, key: str, rows_per_part: int = 1_000_000, counted: int = COUNTED, **options: str) -> DataFrame:
    """A database table in partitions of about ``rows_per_part`` rows, by ranges of a whole-number column (``key``, as its SQL writes it).

    The database says the key's bounds, then how many rows each of ``counted`` equal ranges has; neighbours are put together to
    even partitions, so a key with gaps or crowded stretches makes none that is much larger. NULL keys are a partition of their
    own. Filters and columns of what follows go to the database.
    """
    bounds = read(spark, url, f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT(*) AS n, COUNT({key}) AS k FROM {name}) b", **options).first()
    low, high, rows, keyed = bounds
    if keyed == 0 or rows <= rows_per_part:
        return read(spark, url, name, **options)
    low, high = int(low), int(high)
    width = -(-(high - low + 1) // counted)
    histogram = read(spark, url, f"(SELECT r, COUNT(*) AS n FROM (SELECT ({key} - ({low})) / {width} AS r FROM {name} WHERE {key} IS NOT NULL) x GROUP BY r) h", **options)
    counts = [(int(r[0]), int(r[1])) for r in histogram.collect()]
    clauses = []
    for a, b in even_ranges(counts, low, width, rows_per_part):
        ends = [f"{key} >= {a}"] * (a is not None) + [f"{key} < {b}"] * (b is not None)
        clauses.append(" AND ".join(ends) or f"{key} IS NOT NULL")
    if rows > keyed:
        clauses.append(f"{key} IS NULL")
    return spark.read.jdbc(url, name, predicates=clauses, properties=dict(options))
