"""Documents from ordered turns, requests for a scorer, and its results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import as_count, rounded, token_estimate

RESULT = "custom_id STRING, response STRUCT<body: STRUCT<choices: ARRAY<STRUCT<message: STRUCT<content: STRING>>>, usage: STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT>>>"


#: Bytes of text that a scorer gets at once.
SCORED = 2 << 20
#: What stands for an absent type and speaker, and what else than these characters is removed.
DEFAULT_KIND, DEFAULT_SPEAKER = "Comment", "Call Participant"
KEPT = r"\x20-\x7E\n\t -￿"
ENDS = r"(?U)^[\s\x1c-\x1f]++|[\s\x1c-\x1f]++$"


def assembled(turns: DataFrame, doc: str, order: str, kind: str, speaker: str, text: str) -> DataFrame:
    """(doc, n_turns, text): 'kind from speaker: text' of each turn in order, a blank line between and a newline at the end.

    Texts are stripped, a doubled backslash is one, and characters outside KEPT (control characters, those beyond U+FFFF) go.
    """
    line = F.concat(F.coalesce(F.col(kind), F.lit(DEFAULT_KIND)), F.lit(" from "), F.coalesce(F.col(speaker), F.lit(DEFAULT_SPEAKER)), F.lit(": "), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), ENDS, ""), F.lit("\n"))
    plain = F.regexp_replace(F.replace(line, F.lit("\\\\"), F.lit("\\")), f"[^{KEPT}]", "")
    lines = turns.groupBy(doc).agg(as_count(F.count(F.lit(1))).alias("n_turns"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), plain.alias("line")))).alias("lines"))
    return lines.select(doc, "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def requests(docs: DataFrame, system: str, model: str, id_col: str = "doc_id", text_col: str = "text", repeat: int = 1) -> DataFrame:
    """(custom_id, line): request lines as JSON, numbered within a document."""
    seq = docs.withColumn("_seq", F.explode(F.sequence(F.lit(1), F.lit(repeat))))
    custom = F.concat_ws("-", F.lit("request"), F.col(id_col).cast("string"), F.col("_seq").cast("string"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", F.col(text_col))).alias("messages"))
    return seq.select(custom.alias("custom_id"), F.to_json(F.struct(custom.alias("custom_id"), body.alias("body"))).alias("line"))


def ingested(lines: DataFrame, column: str = "value") -> DataFrame:
    """(custom_id, doc_id, content, prompt_tokens, completion_tokens): wrappers that aren't JSON or lack an id are left out."""
    r = lines.select(F.from_json(column, RESULT).alias("r")).where("r.custom_id IS NOT NULL")
    body = F.col("r.response.body")
    return r.select("r.custom_id", F.try_element_at(F.split("r.custom_id", "-"), F.lit(2)).try_cast("bigint").alias("doc_id"), F.get(body["choices"], F.lit(0))["message"]["content"].alias("content"), body["usage"]["prompt_tokens"].alias("prompt_tokens"), body["usage"]["completion_tokens"].alias("completion_tokens"))


def rejected(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.where(F.from_json(column, RESULT)["custom_id"].isNull())


def batch_cost(requests_: DataFrame, by: str, prompt_tokens: int, input_price: float, output_price: float, output_tokens: int) -> DataFrame:
    """Requests, tokens and cost of each batch; prices are for a million tokens."""
    total = F.sum(F.col("tokens") + prompt_tokens)
    return requests_.groupBy(by).agg(as_count(F.count(F.lit(1))).alias("n_requests"), as_count(total).alias("n_tokens"), rounded(total * input_price / 1e6).alias("input_cost"), rounded(F.count(F.lit(1)) * output_tokens * output_price / 1e6).alias("output_cost"))


def halved(texts: pd.Series, scorer: Callable[[pd.Series], pd.Series]) -> pd.DataFrame:
    """score and error of each text: where the scorer fails, on each half again, until the texts it fails on stand alone."""
    try:
        scores = pd.Series(scorer(texts))
        if len(scores) != len(texts):
            raise ValueError(f"{len(scores)} scores for {len(texts)} texts")
        return pd.DataFrame({"score": scores.astype(float).to_numpy(), "error": None}, index=texts.index)
    except Exception as e:  # a user's scorer
        if len(texts) == 1:
            return pd.DataFrame({"score": float("nan"), "error": f"{type(e).__name__}: {e}"}, index=texts.index)
    middle = len(texts) // 2
    return pd.concat([halved(texts.iloc[:middle], scorer), halved(texts.iloc[middle:], scorer)])


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows with about ``limit`` bytes of text, one row at least."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if total and total + n > limit:
            yield start, i - start
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts) - start


def scored(docs: DataFrame, scorer: Column | Callable[[pd.Series], pd.Series], text_col: str = "text") -> DataFrame:
    """``docs`` with score and error: by a column expression, or by a function of a batch of texts.

    A text that the function fails on has its error and no score; the others of its batch keep theirs. The function gets
    the texts of some rows, about SCORED bytes of them; other columns stay as they came.
    """
    if isinstance(scorer, Column):
        return docs.withColumns({"score": scorer.cast("double"), "error": F.lit(None).cast("string")})

    at, names = docs.columns.index(text_col), [*docs.columns, "score", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(at), SCORED):
                rows = batch.slice(start, n)
                found = halved(rows.column(at).to_pandas(), scorer)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found["score"], pa.float64(), from_pandas=True), pa.array(found["error"], pa.string(), from_pandas=True)], names)
        pa.default_memory_pool().release_unused()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{ddl}, score double, error string").withColumn("score", F.nanvl("score", F.lit(None)))


def lexicon_score(text: Column, words: list[str]) -> Column:
    """Words of the list that the text holds, as a percentage of the list."""
    return 100.0 * sum((F.contains(F.lower(text), F.lit(w.lower())).cast("int") for w in words), F.lit(0)) / len(words)


def tokens_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select("doc_id", F.length(text_col).cast("bigint").alias("n_chars"), token_estimate(F.col(text_col)).alias("n_tokens"))
