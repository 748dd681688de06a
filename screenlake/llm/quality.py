"""Quality scores from compression: which of two zstandard dictionaries suits a text better.

One dictionary is built from text labelled good, one from text labelled bad. A text is compressed with
each, in independent windows of WINDOW bytes so that long texts don't drown the dictionaries; the
difference of the two sizes over their sum becomes a score by a logistic curve fitted to labelled texts
that built neither dictionary. The fit reads a sample of bounded size: about ``docs_per_label`` labelled
documents of each label. Of several labels of a document the larger counts; of several texts of an id one trains.
Scoring reads whole texts, in tasks, and needs no shuffle.

Cases: null and empty texts have difference 0 and so the curve's score at 0; with no labels, or labels
of one kind, the score is the share of label 1 (0.5 without labels); labels other than 0 and 1 and null
texts don't train; other columns and repeated rows are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, sample_by_hash, with_text_columns

WINDOW = 2048
DICTIONARY_BYTES = 65_536
LEVEL = 3
#: Bytes of one sampled text that train; longer ones give their windows at even distances.
TRAIN_BYTES = 16_384


def parts(raw: bytes) -> list[bytes]:
    return [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    shift: float

    def differences(self, texts: list[str | None]) -> list[float]:
        """(bad - good) / (bad + good) compressed bytes of each text."""
        if not self.good:
            return [0.0] * len(texts)
        import zstandard

        good, bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False).compress for d in (self.good, self.bad))
        out = []
        for text in texts:
            g = b = 0
            for part in parts((text or "").encode("utf-8", "replace")):
                g += len(good(part))
                b += len(bad(part))
            out.append((b - g) / (b + g) if b else 0.0)
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        return [round(1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * d + self.shift)))), 6) for d in self.differences(texts)]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method with a small ridge."""
    scale = float(np.abs(x).std()) or 1.0
    a, b = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -40, 40)))
        w = weight * p * (1 - p) + 1e-9
        step = np.linalg.solve((a * w[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (weight * (y - p)) - 1e-3 * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(b[0])) / scale, float(b[1])


def train(texts: list[str], labels: list[int], share: float | None = None) -> QualityModel:
    """Of each label's texts, in the order given, every second builds its dictionary and the others fit the curve.

    ``share`` of label 1 among all labelled documents: the curve is fitted with labels weighted to it.
    """
    import zstandard

    if share is None:
        share = sum(labels) / len(labels) if labels else 0.5
    by = [[t for t, y in zip(texts, labels) if y == k] for k in (0, 1)]
    if min(map(len, by)) >= 4:
        dictionaries = []
        for group in by:
            samples = []
            for text in group[::2]:
                raw = parts(text.encode("utf-8", "replace"))
                samples += raw[:: max(1, -(-len(raw) * WINDOW // TRAIN_BYTES))]
            size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 4))
            try:
                dictionaries.append(zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes())
            except zstandard.ZstdError:  # too few or too uniform samples for its trainer
                dictionaries.append(b"".join(samples)[:size] or b" " * 8)
        model = QualityModel(dictionaries[1], dictionaries[0], 1.0, 0.0)
        rest = [(t, k) for k in (0, 1) for t in by[k][1::2]]
        x, y = np.array(model.differences([t for t, _ in rest])), np.array([k for _, k in rest], dtype=float)
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        model.slope, model.shift = logistic(x, y, weight)
        return model
    p = min(0.999, max(0.001, share))
    return QualityModel(b"", b"", 0.0, math.log(p / (1 - p)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", docs_per_label: int = 1200) -> QualityModel:
    """Train on the rows of ``docs`` that ``labels`` marks 0 or 1, a bounded sample of them."""
    marks = labels.where(column(label_col).isin(0, 1)).groupBy(column(id_col).alias("_id")).agg(F.max(column(label_col)).cast("int").alias("_label"))
    chosen = sample_by_hash(marks, F.col("_id"), "_label", docs_per_label, "quality")
    texts = docs.where(column(text_col).isNotNull()).select(column(id_col).alias("_id"), column(text_col).alias("_text"))
    # a text's bytes beyond a bound would not train in any case (see TRAIN_BYTES)
    spread = F.when(F.length("_text") <= TRAIN_BYTES, F.col("_text")).otherwise(F.concat(*[F.substring("_text", F.floor(F.length("_text") * i / 8).cast("int") + F.lit(1), F.lit(TRAIN_BYTES // 8)) for i in range(8)]))
    # of texts that share an id the one with the least hash: a row an id reaches the driver
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min_by(spread, F.xxhash64("_text")).alias("_text"))
    sample = sorted((r["_id"], r["_text"], r["_label"]) for r in rows.collect())
    share = marks.agg(F.avg("_label")).first()[0]
    return train([t for _, t, _ in sample], [y for _, _, y in sample], share)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with the score and the label it predicts, as ``names``; columns of these names, in any case, are replaced."""

    def start():
        def compute(texts: pa.Array) -> list[pa.Array]:
            scores = model.scores(texts.to_pylist())
            return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]

        return compute

    return with_text_columns(docs, text_col, [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())], start)
