"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in consecutive windows, in both directions, and labels every
byte position with a language; a document's probabilities are the mean over all of its positions.
Training is back-propagation through time in numpy on the driver, on a sample of bounded size: at most
``docs_per_language`` documents of each of the MOST_LANGUAGES most frequent languages, of which
WINDOWS_A_DOC windows each are read. Rows that repeat an id and a text are one document there.
Prediction reads whole texts, in tasks, and needs no shuffle.

Cases: a text that is null or has no letter gets UNKNOWN with score 0 and is not trained on, so a language
with no other text is not known to the network; an empty training set makes all predictions UNKNOWN; ties go to the language that sorts first; other columns and repeated rows are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, sample_by_hash, with_text_columns

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
HIDDEN = 8
LENGTH = 64
WINDOWS_A_DOC = 6
LANES = 1024
MOST_LANGUAGES = 1000


def windows(raw: bytes) -> np.ndarray:
    """The text as rows of LENGTH bytes, zeros after its end."""
    rows = -(-len(raw) // LENGTH)
    return np.frombuffer(raw.ljust(rows * LENGTH, b"\0"), dtype=np.uint8).reshape(rows, LENGTH)


class Direction:
    """One gated recurrent layer. Arrays are feature by lane, so that every operation runs over long rows."""

    def __init__(self, rng: np.random.Generator):
        self.p = {"w": rng.normal(0, 0.3, (3 * HIDDEN, 256)).astype("f4"), "u": rng.normal(0, 0.3, (3 * HIDDEN, HIDDEN)).astype("f4")}

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """``x``: bytes by step and lane; the hidden states by step, feature and lane."""
        w, u, k = self.p["w"].copy(), self.p["u"].copy(), 2 * HIDDEN
        w[:k] *= 0.5  # sigmoid(x) = 0.5 + 0.5 tanh(x / 2)
        u[:k] *= 0.5
        lanes = x.shape[1]
        out, states = np.empty((len(x), HIDDEN, lanes), dtype="f4"), []
        h = np.zeros((HIDDEN, lanes), dtype="f4")
        g, a = np.empty((3 * HIDDEN, lanes), dtype="f4"), np.empty((3 * HIDDEN, lanes), dtype="f4")
        for t, codes in enumerate(x):
            np.take(w, codes, axis=1, out=g, mode="clip")
            np.matmul(u, h, out=a)
            gates = g[:k]
            gates += a[:k]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r, n = gates[:HIDDEN], gates[HIDDEN:], g[k:]
            if keep:
                an = a[k:].copy()
                n += r * an
                np.tanh(n, out=n)
                states.append((codes, h, z.copy(), r.copy(), n.copy(), an))
            else:
                r *= a[k:]
                n += r
                np.tanh(n, out=n)
            new = out[t]
            np.subtract(h, n, out=new)
            new *= z
            new += n
            h = new
        return out, states

    def backward(self, states: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        u = self.p["u"]
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        dh = np.zeros_like(d_out[0])
        for t in range(len(states) - 1, -1, -1):
            codes, h, z, r, n, an = states[t]
            dh = dh + d_out[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            d_rec = np.concatenate([dz, dr, dn * r])
            order = np.argsort(codes, kind="stable")
            firsts = np.flatnonzero(np.diff(codes[order], prepend=np.int16(-1)))
            grads["w"][:, codes[order][firsts]] += np.add.reduceat(np.concatenate([dz, dr, dn])[:, order], firsts, axis=1)
            grads["u"] += d_rec @ h.T
            dh = dh * z + u.T @ d_rec
        return grads


class Network:
    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.sides = [Direction(rng), Direction(rng)]
        self.top = {"o": rng.normal(0, 0.3, (len(languages), 2 * HIDDEN)).astype("f4"), "b": np.zeros((len(languages), 1), dtype="f4")}

    def hidden(self, x: np.ndarray, keep: bool = False):
        right, a = self.sides[0].forward(x, keep)
        left, b = self.sides[1].forward(x[::-1], keep)
        return right, left[::-1], (a, b)

    def positions(self, right: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Probabilities by step, language and lane: every position gets its label."""
        o = self.top["o"]
        logits = np.matmul(o[:, :HIDDEN], right)
        logits += np.matmul(o[:, HIDDEN:], left)
        logits += self.top["b"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 300, batch: int = 192, rate: float = 0.02, seed: int = 0) -> None:
        """Adam on the mean cross-entropy of all positions; ``x``: rows of windows, ``y``: language numbers."""
        rng = np.random.default_rng(seed)
        params = [self.sides[0].p, self.sides[1].p, self.top]
        moments = [{k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()} for p in params]
        by_class = [np.flatnonzero(y == c) for c in range(len(self.languages))]
        for step in range(1, steps + 1):
            chosen = np.concatenate([rng.choice(rows, max(1, batch // len(by_class))) for rows in by_class])
            codes, labels = np.ascontiguousarray(x[chosen].T), y[chosen]
            right, left, (a, b) = self.hidden(codes, keep=True)
            d = self.positions(right, left)
            d[:, labels, np.arange(len(labels))] -= 1
            d *= (codes != 0)[:, None]
            d /= max(1, (codes != 0).sum())
            o = self.top["o"]
            d_right, d_left = np.matmul(o[:, :HIDDEN].T, d), np.matmul(o[:, HIDDEN:].T, d)
            flat = d.transpose(1, 0, 2).reshape(len(o), -1)
            both = np.concatenate([right, left], axis=1).transpose(1, 0, 2).reshape(2 * HIDDEN, -1)
            grads = [self.sides[0].backward(a, d_right), self.sides[1].backward(b, d_left[::-1]), {"o": flat @ both.T, "b": flat.sum(axis=1, keepdims=True)}]
            now = rate * (1 - step / (steps + 1))
            for p, g, m in zip(params, grads, moments):
                for k in p:
                    m[k][0] = 0.9 * m[k][0] + 0.1 * g[k]
                    m[k][1] = 0.999 * m[k][1] + 0.001 * g[k] ** 2
                    p[k] -= (now * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.999**step)) + 1e-8)).astype("f4")

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text (zeros for an empty one)."""
        rows = [-(-len(t) // LENGTH) for t in texts]
        out = np.zeros((len(texts), len(self.languages)))
        if not sum(rows):
            return out
        x = np.concatenate([windows(t) for t in texts if t])
        sums = np.empty((len(x), len(self.languages)))
        for k in range(0, len(x), LANES):
            codes = np.ascontiguousarray(x[k : k + LANES].T)
            p = self.positions(*self.hidden(codes)[:2])
            if not codes[-1].all():
                p *= (codes != 0)[:, None]
            sums[k : k + LANES] = p.sum(axis=0).T
        some = np.flatnonzero(rows)
        starts = np.concatenate([[0], np.cumsum([rows[i] for i in some])[:-1]])
        totals = np.add.reduceat(sums, starts, axis=0)
        out[some] = totals / np.maximum(totals.sum(axis=1, keepdims=True), 1e-9)
        return out


@dataclass
class LanguageModel:
    network: Network | None

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.network and known:
            p = self.network.documents([texts[i].encode("utf-8", "replace") for i in known])
            for i, row in zip(known, p):
                best = int(row.argmax())
                names[i], scores[i] = self.network.languages[best], round(float(row[best]), 6)
        return names, scores


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 150, id_col: str = "doc_id") -> LanguageModel:
    """Train on rows with text and language, a bounded sample of them (see above)."""
    key = column(id_col).cast("string") if id_col in labelled.columns else F.lit(None).cast("string")
    lettered = labelled.where(column(lang_col).isNotNull() & column(text_col).rlike(r"\p{L}"))
    rows = lettered.select(column(text_col).alias("text"), column(lang_col).alias("lang"), F.concat_ws("|", key, F.xxhash64(column(text_col))).alias("key"))
    size = F.length("text")
    pieces = [F.substring(F.col("text"), (F.pmod(F.xxhash64(F.col("text"), F.lit(i)), F.greatest(size - LENGTH, F.lit(1))) + 1).cast("int"), F.lit(LENGTH)) for i in range(WINDOWS_A_DOC)]
    sample = sample_by_hash(rows, F.col("key"), "lang", docs_per_language, "language", MOST_LANGUAGES).select("lang", F.array(*pieces).alias("parts")).collect()
    sample = sorted((r["lang"], list(r["parts"])) for r in sample)
    pairs = [(windows(p.encode("utf-8", "replace")[:LENGTH]), lang) for lang, parts in sample for p in parts if LETTER.search(p)]
    languages = sorted({lang for _, lang in pairs})
    if not pairs:
        return LanguageModel(None)
    network = Network(languages)
    if len(languages) > 1:
        network.train(np.concatenate([x for x, _ in pairs]), np.array([languages.index(lang) for _, lang in pairs]))
    return LanguageModel(network)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its share of the text, as ``names``; columns of these names, in any case, are replaced."""

    def start():
        def compute(texts: pa.Array) -> list[pa.Array]:
            found, scores = model.predict(texts.to_pylist())
            return [pa.array(found, pa.string()), pa.array(scores, pa.float64())]

        return compute

    return with_text_columns(docs, text_col, [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())], start)
