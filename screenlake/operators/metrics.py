"""Classifier metrics from predictions and labels (1, 0 or NULL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import as_count, percent, ratio_or_zero, rounded


def confusion(truth: Column, guess: Column) -> list[Column]:
    """Counts of pairs without NULL."""
    return [as_count(F.count_if((truth == t) & (guess == g))).alias(name) for name, t, g in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))]


def with_rates(df: DataFrame) -> DataFrame:
    """precision, recall, specificity and F1 from the counts; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return df.withColumns({"precision": rounded(ratio_or_zero(tp, tp + fp)), "recall": rounded(ratio_or_zero(tp, tp + fn)), "specificity": rounded(ratio_or_zero(tn, tn + fp)), "f1": rounded(ratio_or_zero(2 * tp, 2 * tp + fp + fn))})


def confusion_metrics(df: DataFrame, by: list[str], truth: str = "truth", guess: str = "guess") -> DataFrame:
    grouped = df.groupBy(*by) if by else df.groupBy()
    return with_rates(grouped.agg(*confusion(F.col(truth), F.col(guess))))


def prediction(score: Column, flag: Column, threshold: float = 75) -> Column:
    """From the score if there is one, else from the flag."""
    return F.when(score.isNotNull(), (score >= threshold).cast("int")).when(flag.isNotNull(), (flag >= 0.5).cast("int"))


def label_sources(df: DataFrame, rater_threshold: float = 50) -> DataFrame:
    """Three rows a rated row: truth by rater A, by rater B, and pooled (B, else A)."""
    a = F.when(F.col("rater_a").isNotNull(), (F.col("rater_a") >= rater_threshold).cast("int"))
    b = F.col("rater_b").cast("int")
    listed = F.array(*[F.struct(F.lit(n).alias("label_source"), c.alias("truth")) for n, c in (("rater_a", a), ("rater_b", b), ("pooled", F.coalesce(b, a)))])
    return df.withColumn("_l", F.explode(listed)).select(*[c for c in df.columns], "_l.label_source", "_l.truth")


def agreement(df: DataFrame, label: str, flags: list[str]) -> DataFrame:
    """For each class of a 0/1 label its rows and how many have each flag, with the odds ratio of the flag in class 1 against class 0.

    The ratio is NULL where class 0 has the flag never or always, or class 1 always. Unlabelled rows don't count.
    """
    n = F.count(F.lit(1))
    per = df.where(F.col(label).isNotNull()).groupBy(label).agg(as_count(n).alias("n"), *(as_count(F.count_if(f)).alias(f"n_{f}") for f in flags))
    share = lambda f, k: F.max(F.when(F.col(label) == k, F.col(f"n_{f}") / F.col("n"))).alias(f"_{f}{k}")
    shares = per.agg(*(share(f, k) for f in flags for k in (0, 1)))
    odds = lambda p: p / (1 - p)

    def columns(f: str) -> list[Column]:
        low, high = F.col(f"_{f}0"), F.col(f"_{f}1")
        return [F.col(f"n_{f}"), rounded(percent(F.col(f"n_{f}"), F.col("n"))).alias(f"{f}_pct"), rounded(F.when((low > 0) & (low < 1) & (high < 1), odds(high) / odds(low))).alias(f"{f}_odds_ratio")]

    return per.crossJoin(F.broadcast(shares)).select(label, "n", *(c for f in flags for c in columns(f)))  # one row on the right


def grid_summary(grid: DataFrame, primary: str, shown: str, source: str = "pooled") -> DataFrame:
    """One row over a grid of metrics (model, approach, label_source, ...): the best configuration, the worst model and what approaches gain.

    Best is the greatest F1 above 0 by the labels ``source``; worst is the model with the least F1 in the approach ``shown``;
    the improvement is from the worst to the best approach of the ``primary`` model, in percent, 0 where the worst is 0.
    """
    g = grid.where(F.col("label_source") == source)
    high, low = F.max(F.when(F.col("model") == primary, F.col("f1"))), F.min(F.when(F.col("model") == primary, F.col("f1")))
    order = F.struct(-F.col("f1"), F.col("model"), F.col("approach"))
    best = F.min_by(F.when(F.col("f1") > 0, F.struct("model", "approach", "f1", "precision", "recall", "specificity")), order)
    worst = F.min_by("model", F.when(F.col("approach") == shown, F.struct("f1", "model")))
    return g.agg(as_count(F.count_distinct("model")).alias("n_models"), best.alias("b"), worst.alias("worst_model"), rounded(F.when(low > 0, (high - low) / low * 100).otherwise(0.0)).alias("improvement_pct")).select("n_models", F.col("b.model").alias("best_model"), F.col("b.approach").alias("best_approach"), "b.f1", "b.precision", "b.recall", "b.specificity", "worst_model", "improvement_pct")
