"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the letters of a text (lower case, words between blanks),
weighted by count and inverse document frequency over *all* training documents, and scaled to unit
length.  The weights are trained with follow-the-regularised-leader (per-coordinate steps, L1 and
L2 penalties) on a bounded sample, a fifth of which is set aside to calibrate a temperature.

The sample is bounded: ``sample_docs`` different rows over all languages, those of least hash of id and
text in each, and of these, in order of hash, as many as have ``SAMPLE_NUMBERS`` features together, so
the driver trains in bounded memory whatever the ids are.  Rows of equal id and text count as one there.
The ``MOST_LABELS`` most frequent labels are learned.  Document frequencies cover all training rows.

Defined results: null text, or text without a letter, is ``und`` with score 0; rows without a
label are not learned from; without training rows everything is ``und``; ties go to the first
label by code point; texts of any length are read whole; repeated rows are predicted alike, and null or
equal ids change nothing but the sample; empty table: empty result; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import stash

HASH_BITS = 15
SAMPLE_DOCS = 8000
SAMPLE_NUMBERS = 12_000_000  # features of the sampled rows together
MOST_LABELS = 500
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)


def ngram_counts(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of a text and how often each occurs; None if it has no letter."""
    words = _LETTERS.findall((text or "").lower())
    if words and not "".join(words).isalpha():  # numbers such as "½" are part of words for ``re``, but no letters
        words = [part for w in words for part in "".join(c if c.isalpha() else " " for c in w).split()]
    if not words:
        return None
    a = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    grams, h = [], np.zeros(len(a), np.uint64)
    for n in range(3):
        h = (h[: len(a) - n] * _MULT[n] + a[n:] + np.uint64(n + 1)) * _MULT[1]
        grams.append((h & np.uint64(0xFFFFFFFF)) * _MULT[0] >> np.uint64(16) & np.uint64((1 << bits) - 1))
        h = h & np.uint64(0xFFFFFFFF)
    counts = np.bincount(np.concatenate(grams).astype(np.int64), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    bits: int

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = n * self.idf[at]
        return x / max(float(np.sqrt((x * x).sum())), 1e-12)

    def scores(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or (got := ngram_counts(text, self.bits)) is None:
            return UNKNOWN, 0.0
        z = self.scores(got[0], self.vector(*got)) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        return self.languages[k], float(p[k] / p.sum())


def train(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], *, epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
    """FTRL-proximal, one row at a time; the weights go to ``model``."""
    shape = (1 << model.bits, len(model.languages))
    z, n = np.zeros(shape), np.zeros(shape)
    zb, nb = np.zeros(shape[1]), np.zeros(shape[1])

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for at, x, k in rows:
            w, b = weights(z[at], n[at]), -zb / ((beta + np.sqrt(nb)) / alpha)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[k] -= 1
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
            grown = nb + p * p
            zb += p - (np.sqrt(grown) - np.sqrt(nb)) / alpha * b
            nb = grown
    model.weights, model.bias = weights(z, n), -zb / ((beta + np.sqrt(nb)) / alpha)


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """The temperature with the least mean log loss on ``rows`` (golden-section search on its logarithm)."""
    if not rows or len(model.languages) < 2:
        return
    s, k = np.array([model.scores(at, x) for at, x, _ in rows]), np.array([k for _, _, k in rows])

    def loss(log_t: float) -> float:
        z = s / np.exp(log_t)
        m = z.max(axis=1)
        return float((m + np.log(np.exp(z - m[:, None]).sum(axis=1)) - z[np.arange(len(k)), k]).mean())

    a, b, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    model.temperature = float(np.exp((a + b) / 2))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = HASH_BITS, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from all rows of ``docs`` with a label."""
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    per_lang = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LABELS)
    sizes = {r["lang"]: r["n"] for r in per_lang.collect()}  # a row a language
    each = max(1, sample_docs // max(1, len(sizes)))
    span = 1 << 30
    limits = docs.sparkSession.createDataFrame([(k, min(span, 2 * each * span // n + 64)) for k, n in sizes.items()], "lang string, most long")
    chosen = known.join(F.broadcast(limits), "lang", "left").select("lang", "h", (F.pmod("h", F.lit(span)) < F.col("most")).alias("chosen"), "text")
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("at", pa.binary()), ("n", pa.binary()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, seen = np.zeros(1 << bits, np.int64), 0, set()
        for batch in batches:
            rows: list[tuple] = []
            for lang, h, own, text in zip(*[batch.column(i) for i in range(4)], strict=True):
                if (got := ngram_counts(text.as_py(), bits)) is not None:
                    df[got[0]] += 1
                    n += 1
                    if own.as_py() and (lang.as_py(), h.as_py()) not in seen:
                        seen.add((lang.as_py(), h.as_py()))
                        rows.append((lang.as_py(), h.as_py(), got[0].astype("<u4").tobytes(), got[1].astype("<u4").tobytes(), None))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema=schema)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"lang": [None], "h": [0], "at": [at.astype("<u4").tobytes()], "n": [df[at].astype("<u8").tobytes()], "docs": [n]}, schema=schema)

    got = stash(chosen.mapInArrow(run, "lang string, h long, at binary, n binary, docs long"), "langid")
    df, total = np.zeros(1 << bits), 0
    for r in got.where("docs is not null").toLocalIterator():  # a row a task
        df[np.frombuffer(bytes(r["at"]), "<u4")] += np.frombuffer(bytes(r["n"]), "<u8")
        total += r["docs"]
    place = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(span)), "h")
    once = got.where("docs is null").dropDuplicates(["lang", "h"]).withColumn("place", F.row_number().over(place))
    sample, numbers = [], 0
    for r in once.where(F.col("place") <= each).orderBy("place", "lang").select("lang", "h", "at", "n").toLocalIterator():  # sample_docs rows at most
        numbers += len(r["at"]) // 4
        if numbers > SAMPLE_NUMBERS and sample:
            break
        sample.append(r)
    languages = sorted({r["lang"] for r in sample}, key=str.encode)
    model = Model(languages, np.zeros((1 << bits, len(languages))), np.zeros(len(languages)), np.log((1 + total) / (1 + df)) + 1, 1.0, bits)
    rows = []
    for r in sorted(sample, key=lambda r: (r["h"] * 0x9E3779B97F4A7C15 % 2**64, r["lang"], bytes(r["at"]), bytes(r["n"]))):
        at = np.frombuffer(bytes(r["at"]), "<u4").astype(np.int64)
        rows.append((at, model.vector(at, np.frombuffer(bytes(r["n"]), "<u4")), languages.index(r["lang"])))
    train(model, [r for i, r in enumerate(rows) if i % 5])
    calibrate(model, rows[::5])
    return model


def predict(docs: DataFrame, model: Model, *, keep: list[Column | str], text_col: str = "text") -> DataFrame:
    """``keep``, lang_pred and score of every row."""
    kept = docs.select(*keep)
    names, n = kept.columns, len(kept.columns)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, np.asarray(model.weights, np.float32), model.bias, model.idf, model.temperature, model.bits))  # 2**bits numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    schema = kept.schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)
