"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants: one for each context, all sharing one parent, whose own base is uniform over the
learned words and one place for all others.  The context of a token is the token before it (its
hash; the start of a text is a context of its own), so contexts grow with the words.  Every table of
a context restaurant sends one customer to the parent.

Seating is sampled by Gibbs, all contexts of a word at once.  A word with c customers in the parent weighs
there as the c-th moment of a positive variable: Poisson many jumps, one for each table, beside a stable variable
tilted by exp(-x).  That variable is drawn given the customers and tables in the parent (``shared_weight``);
given it, the contexts of the word are independent, an old table having weight (customers - discount), a new one
(strength + discount * tables) / (strength + customers of the parent) times the variable.  All customers of a word
in a context leave together and their number of tables, all that scores need, is drawn from its law
(``draw_tables``); then the tables in the parent are drawn from theirs.
Predictive probabilities of ``SAMPLES`` seatings are averaged; their base-10 logarithms add up to
the score, whose mean over tokens gives the perplexity.

Every draw takes its random number from a hash of word, context and sweep, and all sums that pass
between tasks are of integers, so scores do not depend on partitions, shards or executors (but for
the order in which a document's logarithms are added).

Distribution: documents are packed in blocks; each block sends the occurrences of its words to
shards by word hash (packed, so a frequent word is a run of small numbers, not rows).  A shard holds
everything about its words, seats them, and gives sums per document, which a task adds up over all its shards before they
are sent.  Only the numbers of
customers and tables of each context pass between shards: a shard sends those of its contexts to
ranges of context hashes, which add them up and send each shard the totals of its own contexts, so
nobody holds all contexts; the ranges also number the contexts, and later exchanges send small
numbers in place of hashes.  The totals of a first round of seating steer the second, and those of
the second normalise the scores.  The numbers of shards and ranges follow the text, so their
memory does not.  A block that holds more of a shard's words than a task should gather from all
blocks sends them to one of several cells of the shard; only the cells' tables of distinct pairs are
then merged for seating, so a word that is a third of all tokens is spread too.

Words are told apart by 63 bits of a hash.

Defined results
---------------
* null text: the empty text, which is one end token;
* a null id counts as the text "" for the split, so it is learned from; rows of equal id are rows of their own;
* without training documents: N = V = 0, every token has probability 1 / (V + 1) = 1;
* texts of any length are scored whole; a text with every token unknown has the probabilities of the place for others;
* repeated rows and ties: each row is scored for itself, equal texts alike up to the order in which logarithms are added;
* empty table: empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xxhash import xxh3_64_intdigest

from tokenloom.llm.common import bucketed, dump, free_shuffles, load, narrow, stash
from tokenloom.llm.components import map_groups

BLOCK_BYTES = 16_000_000
SHARD_CHARS = 6_000_000  # text for each shard
CELL_CHARS = 10_000_000  # text whose occurrences of a shard's words are held together
CELLS = 1 << 20  # most cells of a shard
TASKS = 4  # tasks to a shard that gather cells, so few of them meet in one
ADDERS = 48  # tasks that score; each adds up what its shards give to a document
ROOM = 1 << 23  # numbers
STRENGTH = 0.3
BURN_IN, SAMPLES = 2, 2
SMALL = 256  # customers up to which the law of tables is tabulated
GRID = 500_000  # numbers of tables weighed at a time
_U = np.uint64
_START, _END = 0, 0xFF00  # the context at the start of a text and the hash of the end token, below all words'
_PARENT, _GAMMA, _STABLE = 1, 0x100, 0x4000  # in a context's place: numbers drawn for a word as a whole


def _hashed(words: list[bytes]) -> np.ndarray:
    """63 bits of identity below a set one, and the end token."""
    out = np.fromiter(map(xxh3_64_intdigest, words), _U, len(words)) | _U(1 << 63)
    return np.append(out, _U(_END))


def uniform(words: np.ndarray, contexts: np.ndarray | int, sweep: int) -> np.ndarray:
    """Numbers between 0 and 1 that depend on word, context and sweep only."""
    x = words ^ (np.asarray(contexts, _U) * _U(0xD1342543DE82EF95)) ^ _U((sweep + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (32, 0xD6E8FEB86659FD93)):
        x = (x ^ (x >> _U(shift))) * _U(odd)
    return ((x ^ (x >> _U(31))) >> _U(11)).astype(float) * 2.0**-53


def _gaps(x: np.ndarray) -> np.ndarray:
    """Differences modulo 2^32, of narrow numbers if they fit: documents rise within a word, so most are small."""
    out = np.diff(x, prepend=x.dtype.type(0))
    low = out.astype(np.int16)
    return low if (low.astype(np.int64) == out.astype(np.int32)).all() else out


def _ungapped(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x.astype(np.int64)).astype(np.uint32)


def _planes(x: np.ndarray) -> np.ndarray:
    """Rising hashes as gaps, first bytes of all, then second bytes, and so on: the high ones are nearly all 0."""
    return np.diff(x, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T.ravel()


def _hashes(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(x.reshape(8, -1).T).view(_U).ravel(), dtype=_U)


def _scatter(shards: int, chars: int):
    """Blocks of documents -> a row (cell, block, data) for each shard that a block has words for, and one with its documents (cell -1 - block).

    Cell c belongs to shard c div CELLS.
    """
    schema = pa.schema([("cell", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        hashes: list[np.ndarray] = []
        learned: list[bool] = []
        ids: list[int | None] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal hashes, learned, ids, size, n
            h = np.concatenate(hashes)
            lengths = np.array([len(x) for x in hashes])
            doc = np.repeat(np.arange(len(hashes), dtype=np.uint32), lengths)
            context = np.concatenate([np.array([_START], _U), h[:-1]])
            context[np.cumsum(lengths)[:-1]] = _START
            order = np.argsort(h, kind="stable")
            h, doc, context = h[order], doc[order], context[order]
            shard = ((h >> _U(32)) * _U(0x9E3779B1) % _U(1 << 32) * _U(shards) >> _U(32)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            h, doc, context, shard = h[order], doc[order], context[order], shard[order]
            cuts = [*np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist(), len(h)]
            seen = np.array(learned)
            rows = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                heads = np.flatnonzero(np.concatenate([[True], h[a + 1 : b] != h[a : b - 1]]))
                runs = np.diff([*heads, b - a]).astype(np.uint32)
                own, at = np.unique(context[a:b], return_inverse=True)
                rows.append(dump(h[a:b][heads], runs, _gaps(doc[a:b]), _planes(own), at.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32), seen[doc[a:b]]))
            block = part << 32 | n
            rows.append(dump(np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids]), seen, lengths))
            # By its own share of these words, a block tells how many cells they need.
            need = np.ceil(np.diff(cuts) / len(h) * chars / CELL_CHARS).clip(1, CELLS).astype(np.int64)
            to = np.append(shard[cuts[:-1]] * CELLS + (block * 0x9E3779B97F4A7C15 % 2**64 >> 32) % need, -1 - block)
            hashes, learned, ids, size, n = [], [], [], 0, n + 1
            return pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(len(rows), block)), pa.array(rows, pa.binary())], schema=schema)

        for batch in batches:
            for i, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                hashes.append(_hashed(words))
                learned.append(own)
                ids.append(i)
                size += sum(map(len, words)) + len(words)
                if size >= BLOCK_BYTES:
                    yield close()
        if hashes:
            yield close()

    return run


#: Places of the sums that shards add up: tokens, words, pairs and words seen once and twice, pairs.
_N, _V, _PAIR1, _PAIR2, _WORD1, _WORD2, _PAIRS = range(7)
_HEAD = _PAIRS  # how many come before the pairs


def _gather():
    """All blocks' words of a cell -> its table of words and pairs (word, context) with counts, and the occurrences by block."""
    schema = pa.schema([("shard", pa.int64()), ("words", pa.binary()), ("data", pa.binary())])

    def run(group: pa.RecordBatch) -> pa.RecordBatch:
        cell = group.column("cell")[0].as_py()
        if cell < 0:
            return pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([None], pa.binary()), group.column("data")], schema=schema)
        parts = [load(x.as_py()) for x in group.column("data")]
        for p in parts:
            p[3] = _hashes(p[3])
        words, contexts = np.unique(np.concatenate([p[0] for p in parts])), np.unique(np.concatenate([p[3] for p in parts]))
        # The largest arrays, of occurrences, are made once and in place: a shard of a frequent word has many.
        ends = np.cumsum([len(p[2]) for p in parts])
        key, doc, seen = np.empty(ends[-1], np.int64), np.empty(ends[-1], np.uint32), np.empty(ends[-1], bool)
        for i, b in enumerate(ends.tolist()):
            head, runs, docs, own, at, learned = parts[i]
            a, parts[i] = b - len(docs), None
            key[a:b] = np.repeat(np.searchsorted(words, head) * len(contexts), runs)
            key[a:b] += np.searchsorted(contexts, own)[at]
            doc[a:b], seen[a:b] = _ungapped(docs), learned
        pairs, pair = np.unique(key, return_inverse=True)
        pair = pair.astype(np.int32)
        del key
        count = np.bincount(pair[seen], minlength=len(pairs)).astype(np.int64)
        table = dump(words, (pairs // len(contexts)).astype(np.int32), (pairs % len(contexts)).astype(np.int32), count, contexts)
        del pairs, count, seen
        data = dump(group.column("block").to_numpy(), np.diff(ends, prepend=0), _gaps(doc), pair)
        return pa.RecordBatch.from_arrays([pa.array([cell // CELLS]), pa.array([table], pa.binary()), pa.array([data], pa.binary())], schema=schema)

    return run


def _merge(group: pa.RecordBatch) -> pa.RecordBatch:
    """One table from those of a shard's cells."""
    parts = [load(x) for x in group.column("words").to_pylist()]
    words, number = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    of_part = np.split(number, np.cumsum([len(p[0]) for p in parts])[:-1])
    contexts, number = np.unique(np.concatenate([p[4] for p in parts]), return_inverse=True)
    context_of = np.split(number, np.cumsum([len(p[4]) for p in parts])[:-1])
    pairs, at = np.unique(np.concatenate([n[p[1]] * len(contexts) + c[p[2]] for n, c, p in zip(of_part, context_of, parts, strict=True)]), return_inverse=True)
    count = np.bincount(at, np.concatenate([p[3] for p in parts]), len(pairs)).astype(np.int64)
    table = dump(words, (pairs // len(contexts)).astype(np.int32), (pairs % len(contexts)).astype(np.int32), count, contexts)
    return pa.RecordBatch.from_arrays([group.column("shard").slice(0, 1), pa.array([table], pa.binary())], names=["shard", "words"])


def table_sums(table: bytes) -> np.ndarray:
    words, word, _, count, _ = load(table)
    of_word = np.bincount(word, count, len(words))
    return np.array([count.sum(), (of_word > 0).sum(), (count == 1).sum(), (count == 2).sum(), (of_word == 1).sum(), (of_word == 2).sum(), (count > 0).sum()], float)


def _send(ranges: int):
    """Tables of shards -> a row (range, shard, data) of customers and pairs by context for each range of context hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, table in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, _, context, count, contexts = load(table.as_py())
                sums = [narrow(np.bincount(context, x, len(contexts)).astype(np.int64)) for x in (count, count > 0)]
                of = ((contexts & _U((1 << 63) - 1)) >> _U(31)) * _U(ranges) >> _U(32)  # rises with the hash
                cuts = [*np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist(), len(of)]
                rows = [dump(_planes(contexts[a:b]), *[x[a:b] for x in sums]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield _sent(of[cuts[:-1]], shard, rows)

    return run


_TO_RANGE = pa.schema([("range", pa.int64()), ("shard", pa.int64()), ("data", pa.binary())])


def _sent(to: np.ndarray, shard: int, rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(to.astype(np.int64)), pa.array(np.full(len(rows), shard, np.int64)), pa.array(rows, pa.binary())], schema=_TO_RANGE)


def _send_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, words, held, seats) -> the tables of each sample by context, under the numbers that the ranges gave the contexts."""
    for batch in batches:
        for shard, table, held, seats in zip(batch.column(0).to_pylist(), *[batch.column(i) for i in (1, 2, 3)], strict=True):
            _, _, context, _, contexts = load(table.as_py())
            _, _, gaps, to, lengths = load(held.as_py())
            sums = [narrow(np.bincount(context, x, len(contexts)).astype(np.int64)) for x in load(seats.as_py())[::2]]
            ends = np.cumsum(lengths.astype(np.int64)).tolist()
            yield _sent(to, shard, [dump(gaps[a:b], *[x[a:b] for x in sums]) for a, b in zip([0, *ends], ends, strict=False)])


def _add(first: bool):
    """All shards' sums of a range -> for each shard the totals of its contexts, in its order (at first with the gaps between their numbers)."""

    def run(group: pa.RecordBatch) -> pa.RecordBatch:
        parts = [load(x) for x in group.column("data").to_pylist()]
        if first:
            contexts, number = np.unique(np.concatenate([_hashes(p[0]) for p in parts]), return_inverse=True)
            n = len(contexts)
        else:
            number = np.concatenate([np.cumsum(p[0].astype(np.int64)) for p in parts])
            n = int(number.max()) + 1
        totals = [np.bincount(number, np.concatenate(x), n).astype(np.int64) for x in zip(*[p[1:] for p in parts], strict=True)]
        rows = [dump(*[narrow(x[at]) for x in totals], *([narrow(np.diff(at, prepend=0))] if first else [])) for at in np.split(number, np.cumsum([len(p[1]) for p in parts])[:-1])]
        return pa.RecordBatch.from_arrays([group.column("shard"), group.column("range"), pa.array(rows, pa.binary())], names=["shard", "range", "data"])

    return run


def _join(first: bool):
    """The totals of a shard's contexts, of all ranges (at first also the gaps, the ranges and how many contexts are in each)."""

    def run(group: pa.RecordBatch) -> pa.RecordBatch:
        to, data = group.column("range").to_numpy(), group.column("data").to_pylist()
        order = np.argsort(to)
        parts = [load(data[i]) for i in order]
        more = [narrow(to[order]), narrow(np.array([len(p[0]) for p in parts]))] if first else []
        rows = [dump(*map(np.concatenate, zip(*parts, strict=True)), *more)]
        return pa.RecordBatch.from_arrays([group.column("shard").slice(0, 1), pa.array(rows, pa.binary())], names=["shard", "totals"])

    return run


def _exchanged(sent: DataFrame, first: bool, shards: int) -> DataFrame:
    added = map_groups(sent, ["range"], _add(first), "shard bigint, range bigint, data binary")
    return bucketed(map_groups(added, ["shard"], _join(first), "shard bigint, totals binary"), "shard", shards)


def count_contexts(tables: DataFrame, shards: int) -> DataFrame:
    """shard, totals: customers and pairs of the contexts of each shard (shard, words), summed over all shards, and their numbers."""
    return _exchanged(tables.mapInArrow(_send(shards), "range bigint, shard bigint, data binary"), True, shards)


def count_tables(seated: DataFrame, shards: int) -> DataFrame:
    """shard, totals: tables of the contexts of each shard, summed over all shards, for each sample.  ``seated``: shard, words, held, seats."""
    return _exchanged(seated.select("shard", "words", "held", "seats").mapInArrow(_send_tables, "range bigint, shard bigint, data binary"), False, shards)


def _total(df: DataFrame, col: str, of: Callable[[bytes], np.ndarray] = lambda x: np.frombuffer(x, float)) -> np.ndarray | None:
    """Sum of arrays of numbers: one row per task comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                a = of(x)
                total = a if total is None else total + a
        if total is not None:
            yield pa.RecordBatch.from_pydict({"x": [total.tobytes()]}, schema=pa.schema([("x", pa.binary())]))

    out = None
    for r in df.where(F.col(col).isNotNull()).select(col).mapInArrow(run, "x binary").toLocalIterator():
        a = np.frombuffer(bytes(r["x"]), float)
        out = a if out is None else out + a
    return out


def discount(once: float, twice: float) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once + twice else 0.5


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers."""
    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


@functools.lru_cache(4)
def _small_ways(d: float) -> np.ndarray:
    """log of the weight of all seatings of n customers at t tables, by n and t - 1, up to SMALL customers, exactly."""
    out = np.full((SMALL + 1, SMALL), -np.inf)
    out[1, 0] = 0
    for n in range(1, SMALL):
        t = np.arange(1, n + 1)
        out[n + 1, :n] = out[n, :n] + np.log(n - d * t)
        out[n + 1, 1 : n + 1] = np.logaddexp(out[n + 1, 1 : n + 1], out[n, :n])
    return out


def log_ways(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same for n > SMALL in the rows and t (1 to n) in their columns, less log n!.

    It is (coefficient of z^n in (1 - (1 - z)^d)^t) / (t! d^t): where t is small against n^d by its
    binomial expansion, else by its saddle point with the correction of Stirling's formula for n - t.
    """
    n = np.broadcast_to(n[:, None], t.shape).astype(float)
    t = t.astype(float)
    out = np.full(t.shape, np.nan)
    near = np.nonzero((t * n**-d < 3).any(axis=1))[0]
    if len(near):
        nn, tt = n[near], t[near]
        total, most, ways, term = np.zeros(tt.shape), np.zeros(tt.shape), np.ones(tt.shape), np.zeros(tt.shape)
        for j in range(1, 61):
            ways = ways * np.maximum(tt - j + 1, 0) / -j
            whole = log_gamma(nn[:, :1] - j * d) - log_gamma(nn[:, :1] + 1) - (log_gamma(nn[:, :1] - d) - log_gamma(nn[:, :1] + 1))
            term = ways * np.exp(whole + math.lgamma(1 + j * d)) / math.pi
            total, most = total - term * math.sin(math.pi * j * d), np.maximum(most, np.abs(term))
        with np.errstate(divide="ignore", invalid="ignore"):
            fine = (total > most * 1e-6) & (np.abs(term) < total * 1e-9)
            out[near] = np.where(fine, np.log(total) + log_gamma(nn - d) - log_gamma(nn + 1), np.nan)
    todo = np.nonzero(np.isnan(out) & (t < n))
    if len(todo[0]):
        nn, tt = n[todo], t[todo]
        ratio = np.log(nn / tt)
        a = 2 * ratio / (1 - d)  # 1 - z is exp(-a); Newton from above, of a convex function
        for _ in range(12):
            e, f = -np.expm1(-a), -np.expm1(-d * a)
            a = a - (math.log(d) + np.log(e) + a * (1 - d) - np.log(f) - ratio) / ((1 - e) / e + (1 - d) - d * (1 - f) / f)
        e, f, k = -np.expm1(-a), -np.expm1(-d * a), nn - tt
        spread = nn * (1 + (1 - d) * np.expm1(a) - nn / tt)
        late = log_gamma(k + 1) - (k * np.log(k) - k + 0.5 * np.log(2 * math.pi * k))
        out[todo] = tt * np.log(f) - nn * np.log(e) - 0.5 * np.log(2 * math.pi * np.maximum(spread, 1e-9)) - late
    out[t == n] = n[t == n] * math.log(d)
    return out - log_gamma(t + 1) - t * math.log(d)


def _window(n: np.ndarray, new: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and most tables that can be told from impossible."""
    low, high = np.full(len(n), math.log(1e-15)), np.log((np.maximum(np.log(n / new), 0) + 5) / (1 - d) + 5)
    for _ in range(50):
        mid = (low + high) / 2
        a = np.exp(mid)
        under = np.log(new) + np.log(-np.expm1(-a)) + a * (1 - d) < np.log(n)
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    a = np.exp(low)
    mean = np.clip(new / d * -np.expm1(-d * a), 1, n)
    reach = 10 * np.sqrt(np.maximum(mean - n / (1 + (1 - d) * np.expm1(np.minimum(a, 600))), 1)) + 20
    return np.maximum(np.floor(mean - reach), 1).astype(np.int64), np.minimum(np.ceil(mean + reach), n).astype(np.int64)


def draw_tables(n: np.ndarray, new: np.ndarray, d: float, at_random: np.ndarray) -> np.ndarray:
    """Tables of dishes whose n customers all leave and are seated anew, from their joint law; ``new``: weight of a new table; ``at_random``: uniform numbers.

    P(t) is as new^t times the weight of all seatings of n customers at t tables; sizes of tables matter no further.
    """
    out = np.minimum(n, 1).astype(np.int64)

    def choose(at: np.ndarray, first: np.ndarray, weight: np.ndarray) -> None:
        total = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        out[at] = first + (total < at_random[at][:, None] * total[:, -1:]).sum(axis=1)

    many = np.flatnonzero((n > 1) & (n <= SMALL))
    many = many[np.argsort(n[many], kind="stable")]
    ways = _small_ways(d)
    for group in np.split(many, np.flatnonzero(np.diff(n[many])) + 1) if len(many) else []:
        k = int(n[group[0]])
        for a in range(0, len(group), max(1, GRID // k)):
            at, t = group[a : a + max(1, GRID // k)], np.arange(1, k + 1)
            choose(at, np.int64(1), ways[k, :k] + np.log(new[at])[:, None] * t)
    large = np.flatnonzero(n > SMALL)
    low, high = _window(n[large], new[large], d)
    order = np.argsort(high - low, kind="stable")
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * (high[order[b]] - low[order[b]] + 1) <= GRID:
            b += 1
        own = order[a:b]
        t = low[own][:, None] + np.arange(int((high[own] - low[own]).max()) + 1)
        inside = t <= high[own][:, None]
        at = large[own]
        t = np.minimum(t, high[own][:, None])
        choose(at, low[own], np.where(inside, t * np.log(new[at])[:, None] + log_ways(n[at], t, d), -np.inf))
        a = b
    return out


def _gamma(shape: np.ndarray, draw: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Gamma variables of given shapes (squeezed normals, rejected); ``draw``: uniform numbers of rows, by stream."""
    out, todo, k = np.zeros(len(shape)), np.arange(len(shape)), 1
    d = np.where(shape < 1, shape + 1, shape) - 1 / 3
    while len(todo):
        e = d[todo]
        z = np.sqrt(-2 * np.log(1 - draw(todo, k))) * np.cos(2 * math.pi * draw(todo, k + 1))
        v = np.maximum(1 + z / np.sqrt(9 * e), 1e-9) ** 3
        good = np.log(1 - draw(todo, k + 2)) < z * z / 2 + e - e * v + e * np.log(v)
        out[todo[good]] = (e * v)[good]
        todo, k = todo[~good], k + 3
    return np.where(shape < 1, out * (1 - draw(np.arange(len(shape)), 0)) ** (1 / np.minimum(shape, 1)), out)


def _tilted_stable(n: int, scale: float, d: float, draw: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """n variables with Laplace transform exp(scale - scale * (1 + s)^d): sums of pieces of scale 1 or less.

    A piece is a stable variable, kept with probability exp(-x), so at least once in e tries.
    """
    pieces, total, k = max(1, math.ceil(scale)), np.zeros(n), 0
    shift = math.log(scale / pieces) / d
    for _ in range(pieces):
        todo = np.arange(n)
        while len(todo):
            u = math.pi * (draw(todo, k) + 2.0**-54)
            e = np.log(-np.log(1 - draw(todo, k + 1)) + 1e-300)
            x = shift + np.log(np.sin(d * u)) - np.log(np.sin(u)) / d + (1 - d) / d * (np.log(np.sin((1 - d) * u)) - e)
            x = np.exp(np.minimum(x, 9))  # beyond, none is kept
            good = draw(todo, k + 2) < np.exp(-x)
            total[todo[good]] += x[good]
            todo, k = todo[~good], k + 3
    return total


def shared_weight(words: np.ndarray, customers: np.ndarray, tables: np.ndarray, base: float, d: float, sweep: int) -> np.ndarray:
    """For words with customers at tables in the parent, the variable given which their contexts are independent.

    With new tables of weight ``base``, the weights W(c) of all seatings of c customers have the generating function
    sum of W(c) z^c / c! = exp(base * (1 - (1 - z)^d) / d), which is the mean of exp(z X) for a stable variable
    X of scale base / d tilted by exp(-x); so W(c) is the mean of X^c.  Given c customers at k tables X is
    a gamma variable of shape c - k d and a fresh such variable.
    """
    draw = lambda first: lambda at, k: uniform(words[at], np.array([first + k], _U), sweep)
    x = _gamma(customers - d * tables, draw(_GAMMA)) + _tilted_stable(len(words), base / d, d, draw(_STABLE))
    return np.maximum(x, 1e-280)


def parent_probability(customers: np.ndarray, tables: np.ndarray, all_customers: float, all_tables: float, v: float, d: float) -> np.ndarray:
    return (customers - d * tables + (STRENGTH + d * all_tables) / (v + 1)) / (STRENGTH + all_customers)


def seatings(table: bytes, sums: np.ndarray, tables: np.ndarray, parent_tables: float, burn_in: int, samples: int, all_tables: float | None = None, start: tuple[np.ndarray, np.ndarray] | None = None, sweep: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tables of each pair and, in the parent, of each word, in each sample.

    ``tables``: of each of the shard's contexts, from the last round; ``all_tables``: of all contexts together (without it, these are all).
    ``start``: the last seating; ``sweep``: how many sweeps came before.
    """
    words, word, context, count, contexts = load(table)
    d, d0, v = discount(sums[_PAIR1], sums[_PAIR2]), discount(sums[_WORD1], sums[_WORD2]), sums[_V]
    all_tables = tables.sum() if all_tables is None else all_tables
    t, n = (start[0] if start is not None else count > 0).astype(np.int64), len(words)
    base = (STRENGTH + d0 * parent_tables) / (v + 1)
    new = (STRENGTH + d * tables[context]) / (STRENGTH + all_tables)
    many = np.flatnonzero(count > 1)  # a single customer has a single table
    busy, of = np.unique(word[many], return_inverse=True)
    customers, t0, out = np.bincount(word, t, n).astype(np.int64), np.zeros(n, np.int64), []

    def seat_parent(at: np.ndarray, k: int) -> None:
        t0[at] = draw_tables(customers[at], np.full(len(at), base), d0, uniform(words[at], np.array([_PARENT], _U), k))

    seat_parent(busy, sweep)
    for k in range(sweep, sweep + burn_in + samples):
        x = shared_weight(words[busy], customers[busy], t0[busy], base, d0, k)
        t[many] = draw_tables(count[many], new[many] * x[of], d, uniform(words[word[many]], contexts[context[many]], k))
        customers = np.bincount(word, t, n).astype(np.int64)
        sample = k >= sweep + burn_in
        seat_parent(np.arange(n) if sample else busy, k + 1)
        if sample:
            out.append((t.copy(), t0.copy()))
    return out


def _sample(sums: np.ndarray, all_tables: float, parent_tables: float, burn_in: int, samples: int, sweep: int):
    schema = pa.schema([("shard", pa.int64()), ("seats", pa.binary()), ("totals", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.column(3) if batch.num_columns > 3 else pa.nulls(batch.num_rows)
            for shard, table, totals, seat in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), last, strict=True):
                tables = load(totals.as_py())[0 if seat.is_valid else 1].astype(np.int64)
                start = [x.astype(np.int64) for x in load(seat.as_py())[-2:]] if seat.is_valid else None
                got = seatings(table.as_py(), sums, tables, parent_tables, burn_in, samples, all_tables, start, sweep)
                flat = [narrow(a) for pair in got for a in pair]
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([dump(*flat)], pa.binary()), pa.array([np.array([a.sum() for pair in got for a in pair], float).tobytes()], pa.binary())], schema=schema)

    return run


def _score(sums: np.ndarray, totals: np.ndarray):
    """``totals``: of each sample, the tables of all contexts and of the parent."""
    schema = pa.schema([("block", pa.int64()), ("data", pa.binary())])
    n, v = sums[_N], sums[_V]
    d, d0 = discount(sums[_PAIR1], sums[_PAIR2]), discount(sums[_WORD1], sums[_WORD2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table, whole, data, seats, held, sat in zip(*[batch.column(i) for i in range(6)], strict=True):
                words, word, context, count, contexts = load((whole if whole.is_valid else table).as_py())
                flat, p, of_word = [x.astype(np.int64) for x in load(seats.as_py())], np.zeros(len(word)), np.bincount(word, count, len(words))
                customers = load(held.as_py())[0].astype(np.int64)
                for k, (tables, (all_tables, parent_tables)) in enumerate(zip(load(sat.as_py()), totals, strict=True)):
                    t, t0 = flat[2 * k], flat[2 * k + 1]
                    p0 = parent_probability(np.bincount(word, t, len(words)), t0, all_tables, parent_tables, v, d0)
                    tables = tables.astype(np.int64)
                    p += (count - d * t + (STRENGTH + d * tables[context]) * p0[word]) / (STRENGTH + customers[context])
                blocks, runs, gaps, pair = load(data.as_py())
                doc = _ungapped(gaps)
                if whole.is_valid:
                    own_words, own_word, own_context, _, own_contexts = load(table.as_py())
                    key = np.searchsorted(words, own_words)[own_word] * len(contexts) + np.searchsorted(contexts, own_contexts)[own_context]
                    pair = np.searchsorted(word.astype(np.int64) * len(contexts) + context, key)[pair]
                score = np.log10(p / len(totals))
                base = np.log10((of_word + 1) / (n + v + 1))[word]
                known = (of_word > 0)[word]
                ends = np.cumsum(runs)
                for block, a, b in zip(blocks.tolist(), (ends - runs).tolist(), ends.tolist(), strict=True):
                    x, y = doc[a:b], pair[a:b]
                    at = np.flatnonzero(np.bincount(x))
                    n_known, own_base, own_score = (np.bincount(x, w[y])[at] for w in (known, base, score))
                    part = dump(np.diff(at, prepend=0).astype(np.uint32), n_known.astype(np.uint32), own_base, own_score)
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part], pa.binary())], schema=schema)

    return run


class _Room:
    """Zeros: the first ``ROOM`` numbers in memory, more in files of the task."""

    def __init__(self) -> None:
        self.free = np.zeros(ROOM)

    def zeros(self, n: int) -> np.ndarray:
        if n > len(self.free):
            with tempfile.TemporaryFile() as f:
                f.truncate(8 * max(n, ROOM))
                self.free = np.memmap(f, float, "r+", shape=max(n, ROOM))
        out, self.free = self.free[:n], self.free[n:]
        return out


def _added_up(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``_score`` of many shards, with one sum for each document: what is sent does not grow with the number of shards."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, held = _Room(), {}
        single = (b.slice(i, 1) for b in batches for i in range(b.num_rows))
        for got in run(single):
            block, (gaps, *cols) = got.column("block")[0].as_py(), load(got.column("data")[0].as_py())
            at = np.cumsum(gaps.astype(np.int64))
            n, own = int(at[-1]) + 1, held.get(block)
            if own is None or own.shape[1] < n:
                new = room.zeros(len(cols) * (n if own is None else 2 * n)).reshape(len(cols), -1)
                if own is not None:
                    new[:, : own.shape[1]] = own
                held[block] = own = new
            for total, x in zip(own, cols, strict=True):
                total[at] += x
        for block, own in held.items():
            at = np.flatnonzero(own.any(axis=0))  # of other documents there is nothing to add
            if not len(at):
                continue
            part = dump(np.diff(at, prepend=0).astype(np.uint32), own[0][at].astype(np.uint32), own[1][at], own[2][at])
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part], pa.binary())], names=["block", "data"])

    return together


def _finish(train_tokens: int):
    names = ["id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head, parts in zip(batch.column(0), batch.column(1), strict=True):
                ids, has_id, learned, lengths = load(head.as_py())
                sums = np.zeros((3, len(ids)))
                for gaps, *cols in sorted((load(x) for x in parts.as_py() or []), key=lambda p: (len(p[0]), p[0].tobytes(), p[3].tobytes())):
                    sums[:, np.cumsum(gaps)] += cols
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=~has_id), pa.array(learned), pa.array(lengths.astype(np.int64)), pa.array(np.rint(sums[0]).astype(np.int64)), pa.array(np.full(len(ids), train_tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                    names=names,
                )

    return run


def score(docs: DataFrame, learned: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, learned, n_tokens, n_known, train_tokens, base_score, score of every row; ``learned``: which rows to learn from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(learned, F.lit(False)).alias("learned"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    shards = max(1, math.ceil(chars / SHARD_CHARS))
    held = bucketed(map_groups(rows.mapInArrow(_scatter(shards, chars), "cell bigint, block bigint, data binary"), ["cell"], _gather(), "shard bigint, words binary, data binary", TASKS * shards), "shard", shards)
    own = held.where("shard >= 0")
    cells = own.groupBy("shard").agg(F.count("*").alias("cells")).where("cells > 1").select("shard")
    several = cells.limit(1).count() > 0
    whole = own.select("shard", "words")
    if several:  # a single cell's table is the shard's
        cells = stash(cells, "shard-cells", shards)
        merged = bucketed(map_groups(whole.join(cells, "shard", "left_semi"), ["shard"], _merge, "shard bigint, words binary"), "shard", shards)
        whole = bucketed(whole.join(cells, "shard", "left_anti").unionByName(merged), "shard", shards)  # every exchange reads it

    sums = _total(whole, "words", table_sums)
    sums = np.zeros(_HEAD + 1) if sums is None else sums

    def sampled(rows: DataFrame, all_tables: float, parent_tables: float, burn_in: int, samples: int, sweep: int) -> tuple[DataFrame, np.ndarray]:
        got = bucketed(rows.mapInArrow(_sample(sums, all_tables, parent_tables, burn_in, samples, sweep), "shard bigint, seats binary, totals binary"), "shard", shards)
        total = _total(got, "totals")
        return got.select("shard", "seats"), np.zeros((samples, 2)) if total is None else total.reshape(samples, 2)

    counts = count_contexts(whole, shards)
    held_by = counts.withColumnRenamed("totals", "held")
    seats, totals = sampled(whole.join(counts, "shard"), sums[_PAIRS], sums[_V], BURN_IN, 1, 0)
    sat_by = count_tables(whole.join(held_by, "shard").join(seats, "shard"), shards)
    seats, totals = sampled(whole.join(sat_by, "shard").join(seats, "shard"), *totals[0], BURN_IN, SAMPLES, BURN_IN + 1)
    sat_by = count_tables(whole.join(held_by, "shard").join(seats, "shard"), shards)
    # Everything small is joined first: the occurrences go through a single join.
    known = seats.join(held_by, "shard").join(sat_by.withColumnRenamed("totals", "sat"), "shard")
    if several:
        known = known.join(merged.withColumnRenamed("words", "whole"), "shard", "left")
    else:
        known = known.withColumn("whole", F.lit(None).cast("binary"))  # the same
    scored = own.select("shard", "words", "data").join(known, "shard")
    free_shuffles(spark)
    parts = scored.select("words", "whole", "data", "seats", "held", "sat").coalesce(ADDERS).mapInArrow(_added_up(_score(sums, totals)), "block bigint, data binary")
    parts = parts.groupBy("block").agg(F.collect_list("data").alias("parts"))  # one of each adder at most
    heads = held.where("shard < 0").select((-1 - F.col("shard")).alias("block"), F.col("data").alias("head"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, learned boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return heads.join(parts, "block", "left").select("head", "parts").mapInArrow(_finish(int(sums[_N])), schema)
