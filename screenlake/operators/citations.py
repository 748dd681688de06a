"""Ids quoted in texts and labels for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cited(texts: DataFrame, patterns: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, cited, at): every id that one of the patterns' first groups finds, once, at its first place in the text."""
    found = None
    for pattern in patterns:
        hits = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
        one = texts.select(id_col, text_col, F.explode(F.array_distinct(hits)).alias("hit"))
        one = one.select(id_col, F.regexp_extract("hit", pattern, 1).try_cast("bigint").alias("cited"), F.instr(F.col(text_col), F.col("hit")).cast("bigint").alias("at"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy(id_col, "cited").agg(F.min("at").alias("at"))


def labels(df: DataFrame, id_col: str, name: str, event: str, date: str) -> DataFrame:
    """(id, label): 'name | event | dd Mon yyyy'; rows without one of them are an error."""
    text = F.concat(F.col(name), F.lit(" | "), F.col(event), F.lit(" | "), F.date_format(date, "dd MMM yyyy"))
    return df.select(id_col, F.coalesce(text, F.raise_error(F.concat(F.lit("no metadata for "), F.col(id_col).cast("string")))).alias("label"))
