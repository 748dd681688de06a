"""Files in and out: yearly delimited files, appended tables, profiles and schema checks."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def headered_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, sep=sep, encoding=encoding)


def yearly_csv(spark: SparkSession, path: str, schema: str, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """Delimited files of several years; file_year is the first year in a file's path below ``path``."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).csv(path, header=True, sep=sep, encoding=encoding)
    below = F.substring_index(F.col("_metadata.file_path"), f"/{path.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    return df.select("*", F.regexp_extract(below, r"((?:19|20)\d{2})", 1).try_cast("bigint").alias("file_year"))


def append_stamped(df: DataFrame, path: str) -> None:
    """Append rows with the time of the write."""
    df.withColumn("date", F.current_timestamp()).write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str, prompts: list[str] | None = None, column: str = "prompt", latest: tuple[list[str], list[str]] | None = None) -> None:
    """Write ``df`` with a header; ``prompts``: only their rows; ``latest``: (keys, order), only the last row of each key."""
    chosen = df if prompts is None else df.where(F.col(column).isin(prompts))
    if latest:
        keys, order = latest
        chosen = chosen.groupBy(*keys).agg(F.max_by(F.struct(*chosen.columns), F.struct(*order)).alias("row")).select("row.*")
    chosen.write.option("header", True).csv(path)


def clean_names(names: list[str]) -> list[str]:
    """Trimmed, lower-case names without accents and brackets, with _ for spaces."""
    plain = (unicodedata.normalize("NFKD", n.strip().lower()).encode("ascii", "ignore").decode() for n in names)
    return [n.replace(" ", "_").replace("(", "").replace(")", "") for n in plain]


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_columns, n_chars) of each table, n_chars the length of all values as text."""
    def one(name: str, df: DataFrame) -> DataFrame:
        chars = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
        return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.sum(chars).cast("bigint").alias("n_chars")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "n_chars")

    return reduce(DataFrame.unionByName, (one(n, df) for n, df in tables.items()))


def column_profile(df: DataFrame) -> DataFrame:
    """(column_name, n, n_distinct, has_min) of every column, in one pass."""
    each = [F.struct(F.lit(c).alias("column_name"), F.count(c).cast("bigint").alias("n"), F.count_distinct(c).cast("bigint").alias("n_distinct"), F.min(c).isNotNull().alias("has_min")) for c in df.columns]
    return df.agg(F.array(*each).alias("x")).select(F.inline("x"))


def schema_check(df: DataFrame, name: str, required: list[str]) -> DataFrame:
    """One row: whether all required columns are there and whether the table has no row."""
    missing = [c for c in required if c not in df.columns]
    one = df.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))
    return one.select(F.lit(name).alias("table_name"), F.lit(not missing).alias("complete"), "is_empty", F.lit(len(missing)).cast("bigint").alias("n_missing"))
