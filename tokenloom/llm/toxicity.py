"""Toxicity: a convolutional text classifier with hashed word embeddings, trained in numpy.

A word's embedding adds up the rows of its hashed features in one table: the whole word and its character
n-grams (3 to 6 characters, with marks at both ends), so inflected and new forms of a word share most of it.
Filters of several widths run over the words of a text, each filter keeps its largest response (max pooling
over the whole text, however long), and a linear layer gives the logit.  Rows of features that fewer than
``MIN_DOCS`` sampled texts have are zero, and responses have no bias before pooling, so words of which nothing
is known neither raise nor lower a maximum; without evidence the logit is ``BIAS``, below every threshold.

Training (Adagrad on the log loss, both labels weighing alike) takes all labelled rows, after a start from some of them
(``learn``).  All different texts are dealt to shards of about ``SHARD_DOCS``; each shard goes once through its own from the start,
and what it changed is averaged, for each row of the table over the shards that changed it (``refine``).  Numbers of texts that have a
feature and of those by language come from all rows.  A fifth of all is not trained on; the thresholds are chosen on all of
it, on a grid of 1/``CELL`` of the logit.  Languages beyond the ``LANGUAGES`` most frequent count as one.

The start takes a bounded sample: ``sample_docs`` different texts of each label at most, those of least hash, and of these as many as have
``SAMPLE_WORDS`` words together (a longer first text is taken alone).  One text of each group of near copies in
the sample is kept (a shared least hash of five-word shingles), so what one document and its copies repeat is
not learned.  A fifth of the sample is set aside; on it a threshold is chosen for each language (the cut with
the fewest errors, in the middle of its gap; languages with too few labels of either kind take the
threshold of all, a small sample that of all its texts), and the score is the logistic function of the logit's distance from it, so 0.5 is the
threshold.  The language itself comes from the words (log odds learned on the same sample), never from a column.

Defined results: null and empty texts have no words, so every maximum is 0 and they get the score of that;
labels other than 0 and 1 are not learned from, an id with both counts as 1; without rows of both labels every
score is the share of label 1, but below 0.5; equal texts count once in the sample; null ids have no label, null
languages are like others; texts of any length are read whole; empty table: empty result; other columns are never read.
"""

from __future__ import annotations

import itertools
import math
import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import dump, load, stash

HASH_BITS = 18
DIM = 16
GRAMS = (3, 4, 5, 6)
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
SAMPLE_DOCS = 2500  # of each label
SAMPLE_WORDS = 1_500_000
MIN_DOCS = 2
#: Texts of a shard, rows of the table that are added up together, the rate of a shard, languages, and cells of a unit of the logit.
SHARD_DOCS, CHUNK, SHARD_RATE, LANGUAGES, CELL = 8000, 1024, 0.02, 100, 256
#: Passes over the sample, and steps that small samples get at least.
EPOCHS, LEAST_STEPS = 6, 6000
#: Logit of a text of which nothing is known, and the least threshold: label 1 takes evidence.
BIAS, LEAST_THRESHOLD = -2.0, -1.0
#: Labels of either kind that a language needs for a threshold of its own.
LEAST_LABELS = 15
#: Words that a task remembers, and words that are read in one go.
REMEMBERED = 1 << 18
PIECE_WORDS = 100_000
#: New words whose features are looked at together, and most bits of the marks of labelled texts.
STEP_WORDS, MARK_BITS = 1024, 1 << 26
_WORD = re.compile(r"[^\W_]+")
_SPAN = 1 << 30
_PART = pa.schema([("chunk", pa.int64()), ("data", pa.binary())])
_COLS = sum(WIDTHS) * FILTERS


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mixing step (multiply and shift, twice)."""
    h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def pieces(text: str | None) -> Iterator[list[str]]:
    """The words of a text, in pieces of bounded size."""
    low = (text or "").lower()
    if len(low) <= 2 * PIECE_WORDS:
        if got := _WORD.findall(low):
            yield got
        return
    found = (m.group() for m in _WORD.finditer(low))
    while got := list(itertools.islice(found, PIECE_WORDS)):
        yield got


class Numbers(dict):
    """Words by number, in the order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words: list[str], kind: type = np.int64) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), kind, len(words))

    def since(self, n: int) -> list[str]:
        """The words from number ``n`` on."""
        return list(itertools.islice(reversed(self), len(self) - n))[::-1]


def features(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, offset, rows): 64-bit hashes of words; the features of word i are rows[offset[i]:offset[i + 1]], its own first."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    of = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(code)) - starts[of]
    whole = np.add.reduceat(mixed(code + (place.astype(np.uint64) << np.uint64(24)), 7), starts[:-1]) if len(words) else np.zeros(0, np.uint64)
    per_gram = [np.maximum(sizes - n + 1, 0) for n in GRAMS]
    offset = np.concatenate([[0], np.cumsum(1 + sum(per_gram))])
    rows = np.empty(offset[-1], np.int32 if bits < 32 else np.int64)
    shift, first = np.uint64(64 - bits), offset[:-1] + 1
    rows[offset[:-1]] = mixed(whole, 0) >> shift
    room = sizes[of] - place
    h = code.copy()
    for n in range(2, max(GRAMS) + 1):
        h = mixed(h[: len(code) - n + 1], n) + code[n - 1 :] if len(code) >= n else h[:0]
        if n in GRAMS:
            fits = np.flatnonzero(room[: len(h)] >= n)
            rows[first[of[fits]] + place[fits]] = mixed(h[fits], n) >> shift
            first = first + per_gram[GRAMS.index(n)]
    return whole, offset, rows


def added(table: np.ndarray, offset: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Embeddings of words: sums of their rows, scaled by the root of their number."""
    if len(offset) < 2:
        return np.zeros((0, table.shape[1]), np.float32)
    return np.add.reduceat(table[rows], offset[:-1]) / np.sqrt(np.diff(offset), dtype=np.float32)[:, None]


def spans(words: np.ndarray, offset: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and rows of some words of a vocabulary, put together."""
    n = offset[words + 1] - offset[words]
    ends = np.cumsum(n)
    return np.concatenate([[0], ends]), rows[np.repeat(offset[words] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def summed(table: np.ndarray, offset: np.ndarray, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Embeddings of the words of a text, by their places in a vocabulary."""
    distinct, inverse = np.unique(words, return_inverse=True)
    return added(table, *spans(distinct, offset, rows))[inverse]


@dataclass
class Model:
    bits: int
    table: np.ndarray  # 2**bits x DIM
    filters: np.ndarray  # DIM x _COLS: for each width, each place in it, FILTERS columns
    out: np.ndarray
    bias: float
    share: float = 0.0  # of label 1, where nothing could be learned
    languages: list[str] = field(default_factory=list)
    odds: np.ndarray | None = None  # 2**bits x languages
    thresholds: np.ndarray | None = None  # a row a language, and the last for all
    scale: float = 1.0

    @staticmethod
    def new(bits: int, seed: int = 0) -> Model:
        rng = np.random.default_rng(seed)
        filters = np.concatenate([rng.normal(0, 1 / np.sqrt(DIM * w), (DIM, w * FILTERS)) for w in WIDTHS], axis=1).astype(np.float32)
        return Model(bits, rng.normal(0, 0.1, (1 << bits, DIM)).astype(np.float32), filters, rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), BIAS)

    def logit(self, best: np.ndarray) -> float:
        return float(best @ self.out + self.bias)

    def score(self, best: np.ndarray, language: int) -> float:
        if self.thresholds is None:
            return min(self.share, 0.49)
        z = (self.logit(best) - self.thresholds[language]) * self.scale
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def responses(per_word: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first column, responses) of each width; ``per_word``: what each word adds to every filter at every place."""
    first = 0
    for width in WIDTHS:
        n = len(per_word) - width + 1
        if n > 0:
            r = per_word[:n, first : first + FILTERS]
            for k in range(1, width):
                r = r + per_word[k : n + k, first + k * FILTERS : first + (k + 1) * FILTERS]
            yield first, r
        else:
            yield first, np.zeros((0, FILTERS), np.float32)
        first += width * FILTERS


def pooled(per_word: np.ndarray) -> np.ndarray:
    """Largest response of each filter, 0 at least."""
    return np.concatenate([r.max(axis=0, initial=0) for _, r in responses(per_word)])


class Reader:
    """Scores texts; what is known of a word is remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, Numbers()
        self.per_word, self.odds = np.zeros((0, _COLS), np.float32), np.zeros((0, len(model.languages)), np.float32)

    def places(self, words: list[str]) -> np.ndarray:
        """Where the words are in ``per_word`` and ``odds``, which ``learn_words`` fills."""
        return self.known.of(words)

    def learn_words(self, at: int) -> None:
        """Fill in what is known of the words from number ``at`` on."""
        m, new = self.model, self.known.since(at)
        if at + len(new) > len(self.per_word):  # grown by halves, so that words are copied seldom
            room = at + max(len(new), at // 2 + 1024)
            self.per_word, self.odds = (np.concatenate([a[:at], np.zeros((room - at, a.shape[1]), np.float32)]) for a in (self.per_word, self.odds))
        for a in range(0, len(new), STEP_WORDS):
            _, offset, rows = features(new[a : a + STEP_WORDS], m.bits)
            own = slice(at + a, at + a + len(offset) - 1)
            self.per_word[own] = added(m.table, offset, rows) @ m.filters
            if m.odds is not None:
                self.odds[own] = m.odds[rows[offset[:-1]]]

    def read_all(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, int]]:
        """For each text the pooled responses of the whole of it, and the place of its language.  New words of several texts are looked at together."""
        pending: list[list[str] | None] = []  # pieces of texts; None ends a text
        words = 0
        state = self.begun()
        for text in texts:
            for piece in pieces(text):
                pending.append(piece)
                words += len(piece)
                if words >= PIECE_WORDS:
                    yield from self.worked(pending, state)
                    pending, words = [], 0
            pending.append(None)
        yield from self.worked(pending, state)

    def read(self, text: str | None) -> tuple[np.ndarray, int]:
        return next(self.read_all([text]))

    def begun(self) -> list:
        """Of a text not read yet: best responses, the last words' share, log odds of languages, whether there was a word."""
        return [np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros((0, _COLS), np.float32), np.zeros(len(self.model.languages)), False]

    def worked(self, pending: list[list[str] | None], state: list) -> Iterator[tuple[np.ndarray, int]]:
        m = self.model
        if len(self.known) > REMEMBERED:
            self.known = Numbers()
        before = len(self.known)
        placed = [None if words is None else self.places(words) for words in pending]
        if len(self.known) > before:
            self.learn_words(before)
        for at in placed:
            if at is None:
                best, _, odds, any_word = state
                state[:] = self.begun()
                yield best, int(odds.argmax()) if any_word and m.languages and m.odds is not None else len(m.languages)
                continue
            x = self.per_word[at]
            if len(state[1]):
                x = np.concatenate([state[1], x])
            state[:] = [np.maximum(state[0], pooled(x)), x[len(x) - min(len(x), max(WIDTHS) - 1) :], state[2] + self.odds[at].sum(axis=0, dtype=float), True]


def batches_by_words(texts: Iterator[tuple]) -> Iterator[tuple[list[str], list[tuple]]]:
    """Texts, first in their tuples, as many together as have ``SAMPLE_WORDS`` words; a longer one alone.  Comes with their vocabulary and as places in it."""
    known, held, words = Numbers(), [], 0
    for text, *more in texts:
        before = len(known)
        at = np.concatenate([known.of(p, np.int32) for p in pieces(text)] or [np.zeros(0, np.int32)])
        if held and words + len(at) > SAMPLE_WORDS:
            own = list(known)
            yield own[:before], held
            known, held, words = Numbers(), [], 0
            at = known.of([own[i] for i in at], np.int32)
        held.append((at, *more))
        words += len(at)
    if held:
        yield list(known), held


def train(model: Model, vocabulary: tuple[np.ndarray, np.ndarray], docs: list[np.ndarray], labels: np.ndarray, *, epochs: int | None = None, rate: float = 0.1, decay: float = 1e-4, seed: int = 0, weights: tuple[float, float] | None = None) -> None:
    """Adagrad, one text at a time; only features of the words at the maxima move.  ``vocabulary``: offset and rows of its words; ``docs``: places of words."""
    rng = np.random.default_rng(seed)
    offset, rows = vocabulary
    n1 = labels.sum()
    of_0, of_1 = weights or (len(labels) / (2 * (len(labels) - n1)), len(labels) / (2 * n1))
    weight = np.where(labels == 1, of_1, of_0)
    seen, seen_f = np.full(model.table.shape, 1e-2, np.float32), np.full(model.filters.shape, 1e-2, np.float32)
    seen_o = np.full(model.out.shape, 1e-2, np.float32)
    cols = np.arange(FILTERS)
    distinct = [np.unique(d, return_inverse=True) for d in docs]

    for _ in range(epochs or max(EPOCHS, -(-LEAST_STEPS // len(docs)))):
        for d in rng.permutation(len(docs)):
            words, inverse = distinct[d]
            if not len(words):
                continue
            own, of = spans(words, offset, rows)
            e = added(model.table, own, of)
            got = list(responses((e @ model.filters)[inverse]))
            at = [r.argmax(axis=0) if len(r) else np.zeros(FILTERS, np.int64) for _, r in got]
            best = np.concatenate([np.maximum(r[a, cols], 0) if len(r) else np.zeros(FILTERS, np.float32) for (_, r), a in zip(got, at, strict=True)])
            g = (1 / (1 + np.exp(-np.clip(model.logit(best), -60, 60))) - labels[d]) * weight[d]
            if abs(g) < 0.01:
                continue
            g_best = g * model.out
            grad_f, moved, grads = decay * model.filters, [], []
            for k, (first, _) in enumerate(got):
                on = np.flatnonzero(best[k * FILTERS : (k + 1) * FILTERS] > 0)
                gb = g_best[k * FILTERS + on]
                for j in range(WIDTHS[k] if len(on) else 0):
                    w = inverse[at[k][on] + j]
                    c = first + j * FILTERS + on
                    grad_f[:, c] += (e[w] * gb[:, None]).T
                    moved.append(w)
                    grads.append(gb[:, None] * model.filters[:, c].T)
            if moved:
                w, turn = np.unique(np.concatenate(moved), return_inverse=True)
                per = np.zeros((len(w), DIM), np.float32)
                np.add.at(per, turn, np.concatenate(grads))
                n = np.diff(own)[w]
                per /= np.sqrt(n, dtype=np.float32)[:, None]
                _, touched = spans(words[w], offset, rows)
                unique, turn = np.unique(touched, return_inverse=True)
                grad = decay * model.table[unique]
                np.add.at(grad, turn, np.repeat(per, n, axis=0))
                seen[unique] += grad * grad
                model.table[unique] -= rate * grad / np.sqrt(seen[unique])
                seen_f += grad_f * grad_f
                model.filters -= rate * grad_f / np.sqrt(seen_f)
            g_out = g * best + decay * model.out
            seen_o += g_out * g_out
            model.out -= rate * g_out / np.sqrt(seen_o)


def threshold(z: np.ndarray, y: np.ndarray, count: np.ndarray | None = None) -> float:
    """The cut with the fewest errors, in the middle of its gap; of equal ones the widest gap.  ``count``: how often each is there."""
    order = np.argsort(z, kind="stable")
    n = np.ones(len(z)) if count is None else count[order].astype(float)
    z, y = z[order], y[order] * n
    cuts = np.flatnonzero(z[1:] > z[:-1])
    if not len(cuts):
        return max(LEAST_THRESHOLD, float(z[0]) + 1) if len(z) else 0.0
    errors = np.cumsum(y)[cuts] + (n - y).sum() - np.cumsum(n - y)[cuts]
    least = cuts[errors == errors.min()]
    k = least[np.argmax(z[least + 1] - z[least])]
    return max(LEAST_THRESHOLD, float((z[k] + z[k + 1]) / 2))


def shingle_marks(h: np.ndarray, n: int = 5, marks: int = 4) -> list[int]:
    """Least hashes of the n-word shingles under ``marks`` salts: near copies share most of them."""
    if not len(h):
        return []
    parts = [h[k : max(1, len(h) - n + 1) + k] for k in range(min(n, len(h)))]
    s = parts[0].copy()
    for p in parts[1:]:
        s = mixed(s, 3) + p
    return [int(mixed(s, 10 + k).min()) for k in range(marks)]


def vocabulary_of(words: list[str], bits: int, size: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``features`` of many words, some at a time."""
    got = [features(words[a : a + size], bits) for a in range(0, len(words), size)] or [features([], bits)]
    ends = np.cumsum([0] + [g[1][-1] for g in got])
    return np.concatenate([g[0] for g in got]), np.concatenate([[0]] + [g[1][1:] + e for g, e in zip(got, ends, strict=False)]), np.concatenate([g[2] for g in got])


def learn(sample: list[tuple[str, int, str | None]], *, bits: int = HASH_BITS) -> Model:
    """A model from (text, label, language) of the sampled texts."""
    model, marks, kept = Model.new(bits), set(), []
    known = Numbers()
    hashes = np.zeros(0, np.uint64)
    for text, y, lang in sample:
        at = np.concatenate([known.of(part, np.int32) for part in pieces(text)] or [np.zeros(0, np.int32)])
        if len(known) > len(hashes):
            hashes = np.concatenate([hashes, vocabulary_of(known.since(len(hashes)), bits)[0]])
        own = shingle_marks(hashes[at])
        if not any(m in marks for m in enumerate(own)):
            marks.update(enumerate(own))
            kept.append((at, y, lang))
    model.share = float(np.mean([y for _, y, _ in sample])) if sample else 0.0
    labels = np.array([y for _, y, _ in kept], float)
    if not len(labels) or labels.min() == labels.max():
        return model
    _, offset, rows = vocabulary_of(list(known), bits)
    del known, hashes
    docs = [at for at, _, _ in kept]
    live = np.zeros(1 << bits, np.int32)
    for d in docs:
        live[np.unique(spans(np.unique(d), offset, rows)[1])] += 1
    model.table[live < MIN_DOCS] = 0
    held = np.zeros(len(kept), bool)
    for y in (0, 1):
        held[np.flatnonzero(labels == y)[::5]] = (labels == y).sum() >= 10
    train(model, (offset, rows), [d for d, x in zip(docs, held, strict=True) if not x], labels[~held])
    model.table[live < MIN_DOCS] = 0

    model.languages = sorted({lang for _, _, lang in kept if lang is not None}, key=str.encode)
    if model.languages:
        n = np.zeros((1 << bits, len(model.languages)), np.float32)
        for d, (_, _, lang) in zip(docs, kept, strict=True):
            if lang is not None:
                n[np.unique(rows[offset[np.unique(d)]]), model.languages.index(lang)] += 1
        model.odds = np.log(n + 0.1) - np.log(n.sum(axis=0) + 0.1 * len(n))
    z = np.array([model.logit(pooled(summed(model.table, offset, rows, d) @ model.filters)) for d in docs])
    nowhere = len(model.languages)
    spoken = np.array([int(model.odds[rows[offset[d]]].sum(axis=0, dtype=float).argmax()) if len(d) and nowhere else nowhere for d in docs])
    few = lambda part: min(labels[part].sum(), (1 - labels[part]).sum()) < LEAST_LABELS
    cut = np.ones(len(kept), bool) if few(held) else held
    model.thresholds = np.full(nowhere + 1, threshold(z[cut], labels[cut]))
    for k in range(nowhere):
        own = cut & (spoken == k)
        if not few(own):
            model.thresholds[k] = threshold(z[own], labels[own])
    model.scale = float(3 / max(np.median(np.abs(z - model.thresholds[spoken])), 1e-6))
    return model


def shard(model: Model, rows: Iterator[tuple[str, int, int]], weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(change of the table, of the filters, of the output, texts by feature, texts by word and language) of (text, label, place of the language) trained once."""
    start = model.table.copy(), model.filters.copy(), model.out.copy()
    live, odds, marks = np.zeros(1 << model.bits, np.int32), np.zeros((1 << model.bits, len(model.languages)), np.int32), set()
    for known, part in batches_by_words(rows):
        hashes, offset, of = vocabulary_of(known, model.bits)
        kept = []
        for at, y, lang in part:
            own = shingle_marks(hashes[at])
            if any(m in marks for m in enumerate(own)):
                continue  # of near copies in a shard one is trained on
            marks.update(enumerate(own))
            kept.append((at, y))
            words = np.unique(at)
            live[np.unique(spans(words, offset, of)[1])] += 1
            if lang < len(model.languages):
                odds[np.unique(of[offset[words]]), lang] += 1
        if kept:
            train(model, (offset, of), [d for d, _ in kept], np.array([y for _, y in kept], float), epochs=1, rate=SHARD_RATE, weights=weights)
    return model.table - start[0], model.filters - start[1], model.out - start[2], live, odds


def refine(model: Model, texts: DataFrame) -> Model:
    """The model after all rows (h, text, y, lang) were gone through, with thresholds from those that were not trained on."""
    spark = texts.sparkSession
    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    n = sum(sizes.values())
    by_lang = texts.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    names = sorted((r["lang"] for r in by_lang[:LANGUAGES]), key=str.encode)
    model.languages = names + ["other"] * (len(by_lang) > LANGUAGES)
    fresh = Model.new(model.bits).table
    unknown = ~model.table.any(axis=1)
    model.table[unknown] = fresh[unknown]  # features that the start's texts do not have
    places, rest = {x: i for i, x in enumerate(names)}, len(names)
    weights = n / (2 * sizes[0]), n / (2 * sizes[1])
    held = F.pmod(F.xxhash64("h"), F.lit(5)) == 0
    shared = spark.sparkContext.broadcast(model)  # 2**bits rows

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(pickle.dumps(shared.value))  # noqa: S301
        rows = ((t, y, places.get(lang, rest) if lang is not None else 1 << 30) for b in batches for t, y, lang in zip(*(b.column(c).to_pylist() for c in ("text", "y", "lang")), strict=True))
        table, filters, out, live, odds = shard(own, rows, weights)
        if not live.any():
            return
        moved = table.any(axis=1)
        for k in range(0, len(table), CHUNK):
            part = slice(k, k + CHUNK)
            yield pa.RecordBatch.from_pylist([{"chunk": k, "data": dump(table[part].ravel(), moved[part].astype(np.int32), live[part], odds[part].ravel())}], _PART)
        yield pa.RecordBatch.from_pylist([{"chunk": -1, "data": dump(filters.ravel(), out, np.ones(1, np.int32))}], _PART)

    def together(parts: pa.Table) -> pa.Table:
        """A part of the model from all shards."""
        total = None
        for data in parts.column("data"):
            got = [a.astype(float) for a in load(data.as_py())]
            total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        return pa.Table.from_pylist([{"chunk": parts.column("chunk")[0].as_py(), "data": dump(*total)}], _PART)

    dealt = texts.where(~held).repartition(max(1, -(-n // SHARD_DOCS)), "h").sortWithinPartitions("h")
    sums = dealt.mapInArrow(learned, "chunk long, data binary").groupBy("chunk").applyInArrow(together, "chunk long, data binary")
    live, odds = np.zeros(1 << model.bits), np.zeros((1 << model.bits, len(model.languages)), np.float32)
    for r in sums.toLocalIterator():  # the model's parts, one at a time
        got, k = load(bytes(r["data"])), r["chunk"]
        if k < 0:
            model.filters += (got[0] / got[2][0]).reshape(model.filters.shape).astype(np.float32)
            model.out += (got[1] / got[2][0]).astype(np.float32)
        else:
            model.table[k : k + CHUNK] += (got[0].reshape(-1, DIM) / np.maximum(got[1], 1)[:, None]).astype(np.float32)
            live[k : k + CHUNK], odds[k : k + CHUNK] = got[2], got[3].reshape(-1, len(model.languages))
    model.table[live < MIN_DOCS] = 0
    model.odds = (np.log(odds + 0.1) - np.log(odds.sum(axis=0) + 0.1 * len(odds))).astype(np.float32) if model.languages else None

    final = spark.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(final.value)
        for b in batches:
            got = [(k, int(np.floor(np.clip(final.value.logit(best), -64, 64) * CELL))) for best, k in reader.read_all(t.as_py() for t in b.column("text"))]
            spoken, cells = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(spoken, pa.int64()), pa.array(cells, pa.int64()), b.column("y").cast(pa.int64())], names=["spoken", "cell", "y"])

    def counted(rows: DataFrame) -> tuple[np.ndarray, ...]:
        cells = rows.select("text", "y").mapInArrow(judged, "spoken long, cell long, y long").groupBy("spoken", "cell", "y").count().collect()  # cells, however many rows
        return tuple(np.array([r[c] for r in cells], np.int64) for c in ("spoken", "cell", "y", "count"))

    few = lambda y, c: min(c[y == 1].sum(), c[y == 0].sum()) < LEAST_LABELS
    spoken, cell, y, count = counted(texts.where(held))
    if few(y, count):
        spoken, cell, y, count = counted(texts)
    z = (cell + 0.5) / CELL
    nowhere = len(model.languages)
    model.thresholds = np.full(nowhere + 1, threshold(z, y.astype(float), count))
    for k in range(nowhere):
        own = spoken == k
        if not few(y[own], count[own]):
            model.thresholds[k] = threshold(z[own], y[own].astype(float), count[own])
    far = np.abs(z - model.thresholds[spoken])
    order = np.argsort(far)
    middle = far[order][np.searchsorted(np.cumsum(count[order]), count.sum() / 2)]
    model.scale = float(3 / max(middle, 1e-6))
    model.share = sizes[1] / n
    return model


def labelled_texts(texts: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """h, text, y, lang of the ``n`` different labelled texts.  ``keys``: (h, y, lang, id), with the id of one row that has the text.

    A bitmap of hashed ids (16 bits an id, ``MARK_BITS`` at most) goes to all tasks, so that nearly no other texts are sent; the join decides.
    """
    bits = min(MARK_BITS, 1 << max(15, math.ceil(math.log2(16 * max(n, 1)))))
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    part, bit = F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at)
    marks = keys.select(part, bit.alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("marks"))
    marked = texts.select("h", "text", part, bit.alias("bit")).join(F.broadcast(marks), "part")
    marked = marked.where("shiftright(CAST(conv(hex(substring(marks, CAST(bit DIV 8 AS INT) + 1, 1)), 16, 10) AS INT), CAST(bit % 8 AS INT)) & 1 = 1")
    return marked.groupBy("h").agg(F.min("text").alias("text")).join(keys.drop("id"), "h")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", bits: int = HASH_BITS, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from all rows of ``docs`` with a label of 0 or 1 in ``labels`` (an id with both: 1)."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    narrow = docs.select(F.col(id_col).alias("id"), F.struct(F.col(lang_col).alias("lang")).alias("of"), F.xxhash64(text_col).alias("h")).join(known, "id")  # texts stay where they are
    keys = stash(narrow.groupBy("h").agg(F.max("y").alias("y"), F.min("of").alias("of"), F.min("id").alias("id")).select("h", "y", "of.lang", "id"), "toxic-keys")
    sizes = {r["y"]: r["n"] for r in keys.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    most = F.lit(0).cast("long")
    for y, n in sizes.items():
        most = F.when(F.col("y") == y, min(_SPAN, 2 * sample_docs * _SPAN // n + 64 * _SPAN // max(n, 64))).otherwise(most)
    place = Window.partitionBy("y").orderBy(F.pmod("h", F.lit(_SPAN)), "h")  # about twice sample_docs rows a label
    every = stash(labelled_texts(texts, keys, sum(sizes.values())).select("h", "text", "y", "lang"), "toxic-texts")
    keys = keys.where(F.pmod("h", F.lit(_SPAN)) < most).withColumn("place", F.row_number().over(place)).where(F.col("place") <= sample_docs)
    chosen = every.join(F.broadcast(keys.select("h", "place")), "h")  # 2 * sample_docs keys at most
    chosen = stash(chosen.select("place", "y", "lang", "text"), "toxic-sample", 2 * sample_docs)
    sample, words = [], 0
    for r in chosen.orderBy("place", "y").toLocalIterator():  # 2 * sample_docs rows at most
        words += sum(map(len, pieces(r["text"])))
        if words > SAMPLE_WORDS and sample:
            break
        sample.append((r["text"], r["y"], r["lang"]))
    model = learn(sample, bits=bits)
    if len(sizes) < 2:
        return model
    return refine(model, every)


def score(docs: DataFrame, model: Model, *, keep: list[Column | str], text_col: str = "text") -> DataFrame:
    """``keep``, score and predicted of every row."""
    kept = docs.select(*keep)
    names, n = kept.columns, len(kept.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            got = np.array([reader.model.score(*r) for r in reader.read_all(t.as_py() for t in batch.column(n))], float)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32), pa.int32())], names=[*names, "score", "predicted"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, kept.schema.add("score", "double").add("predicted", "integer"))
