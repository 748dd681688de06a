"""Selecting and averaging repeated runs. Four rules of which run counts are kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import as_count, rounded
from ..functions.parsing import flag_number, response_fields
from .ranks import numbered_across, running_sums


def numbered(df: DataFrame, keys: list[str], *order: Column, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in ``order``."""
    return numbered(df, keys, *order, name="_rn").where("_rn = 1").drop("_rn")


def latest_runs(runs: DataFrame) -> DataFrame:
    return first_by(runs, ["doc_id", "prompt"], F.desc("run_at"), F.desc("run_id"))


def first_run(runs: DataFrame) -> DataFrame:
    """The earliest run of each prompt and document, parseable or not."""
    return first_by(runs, ["prompt", "doc_id"], F.asc("run_at"), F.asc("run_id"))


def first_usable_run(runs: DataFrame) -> DataFrame:
    """The earliest run with a score of each model and document, and the number of attempts."""
    tries = runs.groupBy("model", "doc_id").agg(as_count(F.count(F.lit(1))).alias("attempts"))
    usable = first_by(runs.where("score IS NOT NULL"), ["model", "doc_id"], F.asc("run_at"), F.asc("run_id"))
    return tries.join(usable, ["model", "doc_id"]).select("model", "doc_id", "run_id", "score", "attempts")


def original_scores(runs: DataFrame, prompt: str, model: str) -> DataFrame:
    """The score of each document's smallest run over all models, if that run is the model's; unparseable is 0."""
    mine = runs.where(F.col("prompt") == prompt)
    first = mine.groupBy("doc_id").agg(F.min("run_id").alias("run_id"))
    return mine.join(first, ["doc_id", "run_id"], "left_semi").where(F.col("model") == model).select("doc_id", "run_id", F.coalesce("score", F.lit(0.0)).alias("original_score"))


def repeat_aggregate(runs: DataFrame, repeats: int = 11, response: str | None = None) -> DataFrame:
    """First score, mean of the first ``repeats`` rows (NULL with fewer rows), mean of all, first scores, rows.

    ``response``: the column of responses; then also the reasoning and the excerpts of the first one, which alone is parsed.
    """
    r = numbered(runs, ["doc_id"], F.asc("run_id"))
    head = F.when(F.col("rn") <= repeats, F.struct("rn", "score"))
    first = [F.min_by(response, "rn").alias("_response")] if response else []
    agg = r.groupBy("doc_id").agg(F.min_by("score", "rn").alias("first_score"), F.avg(F.when(F.col("rn") <= repeats, F.col("score"))).alias("m"), F.avg("score").alias("all_mean"), F.sort_array(F.collect_list(head)).alias("head"), as_count(F.count(F.lit(1))).alias("n_runs"), *first)
    read = response_fields(F.col("_response")) if response else None
    fields = [read["reasoning"].alias("first_reasoning"), F.array_join(read["excerpts"], "; ").alias("first_excerpts")] if response else []
    return agg.select("doc_id", "first_score", rounded(F.when(F.col("n_runs") >= repeats, F.col("m"))).alias("repeat_mean"), rounded("all_mean").alias("all_mean"), F.transform("head", lambda x: x["score"]).alias("first_scores"), "n_runs", *fields)


def followup_aggregate(runs: DataFrame, followups: DataFrame) -> DataFrame:
    """Mean and number of follow-up scores of each document, 0 for none."""
    per = followups.join(runs.select(F.col("run_id").alias("parent_id"), "doc_id"), "parent_id").groupBy("doc_id").agg(rounded(F.avg("score")).alias("followup_mean"), as_count(F.count(F.lit(1))).alias("n_followups"))
    return runs.select("doc_id").distinct().join(per, "doc_id", "left").withColumn("n_followups", F.coalesce("n_followups", F.lit(0).cast("bigint")))


def avg_first_n(runs: DataFrame, repeats: int = 11, strict: bool = True) -> DataFrame:
    """Mean score and mean flag, by model, of the first ``repeats`` rows of each prompt and document over all models.

    Strict: NULL for a model with fewer of those rows. Flag-like text counts as 0 or 1, anything else not at all.
    """
    r = numbered(runs.withColumn("_flag", flag_number(F.col("flag"))), ["prompt", "doc_id"], F.asc("run_at"), F.asc("run_id")).where(F.col("rn") <= repeats)
    mean = lambda c: rounded(F.when((F.count(F.lit(1)) >= repeats) | F.lit(not strict), F.avg(c)))
    return r.groupBy("prompt", "doc_id", "model").agg(mean("score").alias("mean_score"), mean("_flag").alias("mean_flag"), F.min("run_at").alias("first_at"), as_count(F.count(F.lit(1))).alias("n"))


def screening_stages(runs: DataFrame, followups: DataFrame, threshold: float = 75, followup_threshold: float = 75, repeats: int = 11) -> DataFrame:
    """Flagged (first score), validated (mean of the first runs if flagged and repeated) and the score after follow-ups."""
    r = numbered(runs.where("score IS NOT NULL"), ["model", "doc_id"], F.asc("run_id"))
    agg = r.groupBy("model", "doc_id").agg(F.min_by("score", "rn").alias("flagged"), F.avg(F.when(F.col("rn") <= repeats, F.col("score"))).alias("mean"), F.count(F.lit(1)).alias("n"), F.min("run_id").alias("run_id"))
    agg = agg.withColumn("validated", F.when((F.col("flagged") >= threshold) & (F.col("n") > 1), F.col("mean")).otherwise(F.col("flagged")))
    follow = followups.groupBy(F.col("parent_id").alias("run_id")).agg(F.avg("score").alias("follow"))
    zero = (F.col("validated") >= threshold) & (F.col("follow") < followup_threshold)
    return agg.join(follow, "run_id", "left").select("model", "doc_id", "flagged", rounded("validated").alias("validated"), rounded(F.when(zero, F.lit(0.0)).otherwise(F.col("validated"))).alias("with_followup"))


def run_deficits(runs: DataFrame, docs: DataFrame, target: int) -> DataFrame:
    """A row (doc_id, missing_no) for each run that a document lacks to the target; where some document has
    no run at all, the target of this phase is 1."""
    counts = docs.select("doc_id").distinct().join(runs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    phase = counts.agg(F.when(F.min("n") == 0, F.lit(1)).otherwise(F.lit(target)).alias("goal"))
    short = counts.crossJoin(F.broadcast(phase)).withColumn("missing", F.col("goal") - F.col("n")).where("missing > 0")  # one row on the right
    return short.select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("missing"))).alias("missing_no"))


def packed(requests: DataFrame, cap: int) -> DataFrame:
    """Which requests of each prompt fit under the token cap: the longest prefix, at least one."""
    r = running_sums(requests.select("prompt", "run_id", "tokens"), ["prompt"], "run_id", {"running": F.col("tokens"), "rn": F.lit(1).cast("bigint")})
    return r.select("prompt", "run_id", "tokens", "running", ((F.col("running") <= cap) | (F.col("rn") == 1)).alias("kept"))


def submittable(batches: DataFrame, cap: int, live: tuple[str, ...]) -> DataFrame:
    """Pending batches, in order of creation within a queue, that fit into what live ones leave of the cap."""
    used = batches.groupBy("queue").agg(F.coalesce(F.sum(F.when(F.col("status").isin(*live), F.col("tokens"))), F.lit(0)).alias("used"))
    pending = batches.where("status = 'pending'").select("queue", "batch_id", "tokens")
    r = running_sums(pending, ["queue"], "batch_id", {"running": F.col("tokens")}).join(used, "queue")
    return r.where(F.col("running") <= F.greatest(F.lit(0), F.lit(cap) - F.col("used"))).select("queue", "batch_id", "tokens", "running")


def entity_batches(requests: DataFrame, docs: DataFrame, entity: str, prompt_tokens: int, context: int) -> DataFrame:
    """A batch for each entity of a queue (prompt) with a sized document: its number by entity, totals and diagnostics.

    ``requests``: (prompt, entity, tokens), tokens NULL for a document without a size, which isn't sent; ``docs``: (entity, n_chars).
    n_intended requests, n_sent of them with a size, n_missing without, n_tokens with the prompt's own, the largest
    document, requests over the context, and the characters sent. Entities without anything to send have no batch.
    """
    sized, whole = F.col("tokens").isNotNull(), F.col("tokens") + prompt_tokens
    n = F.count(F.lit(1))
    per = requests.join(docs, entity, "left").groupBy("prompt", entity).agg(as_count(n).alias("n_intended"), as_count(F.count("tokens")).alias("n_sent"), as_count(n - F.count("tokens")).alias("n_missing"), as_count(F.sum(whole)).alias("n_tokens"), as_count(F.max("tokens")).alias("largest"), as_count(F.count_if(whole > context)).alias("n_over"), as_count(F.coalesce(F.sum(F.when(sized, F.col("n_chars"))), F.lit(0))).alias("n_chars"))
    return numbered_across(per.where("n_sent > 0"), ["prompt"], entity, name="batch_no")
