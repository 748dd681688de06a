"""From raw documents to encoded training text, in five stages over the operators of ``screenlake.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Stages drop rows only by
their own decision: language ID those without a letter, or whose best language has less than
LEAST_LANGUAGE of the text; the quality classifier those scored below LEAST_QUALITY; near-dedup all of
a group but its smallest id. Mixing drops and repeats documents by their source's rate. Columns are those of the
documents, in order, whatever their names, until the last stage, which adds its results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.llm import bpe, language_id, mixing, near_dedup, quality
from screenlake.llm.common import column, fold, staged, table

LEAST_LANGUAGE = 0.4
LEAST_QUALITY = 0.2
#: Names of a stage's own columns, which no table has.
OWN = ("_stage_a", "_stage_b")


def as_before(judged: DataFrame, docs: DataFrame) -> DataFrame:
    return judged.select([column(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text has a letter and a language with at least LEAST_LANGUAGE of it.

    Null, empty and letterless texts go; rows that repeat stay or go together; nulls in other columns don't
    matter. Without any labelled text no language is known and every row goes; an empty table gives an empty one.
    """
    model = language_id.fit(docs.where(fold(F.col("doc_id")) != 1))
    judged = language_id.predict(docs, model, names=OWN)
    return as_before(judged.where((F.col(OWN[0]) != language_id.UNKNOWN) & (F.col(OWN[1]) >= LEAST_LANGUAGE)), docs)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text scores at least LEAST_QUALITY; the classifier learns from ``labels``.

    Null and empty texts have the score of no difference; rows that repeat have the same score; without labels
    every score is 0.5 and all rows stay; an empty table gives an empty one.
    """
    model = quality.fit(docs.where(fold(F.col("doc_id")) != 1), table(spark, sf_dir, "labels"))
    return as_before(quality.score(docs, model, names=OWN).where(F.col(OWN[0]) >= LEAST_QUALITY), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; five words, similarity 0.8.

    Null ids and texts without words stay; of rows that repeat an id one stays; an empty table gives an empty one.
    """
    return near_dedup.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its draw says, so that all sources have equal shares of the characters.

    A null source is one of them; rows with a null id are drawn by their text; rows that repeat have the same
    draw; sources with empty texts only have rate 1; an empty table gives an empty one.
    """
    return as_before(mixing.mix(docs, names=OWN), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows without the text, with n_tokens, ids_sha256, decoded_sha256 and ids; a null text has no ids.

    Near-duplicates are gone by now, so chunks are shared within workers and no text is shuffled for them.
    """
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True, across=False).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained models and an external vocabulary decide; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
