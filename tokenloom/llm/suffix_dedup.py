"""Removal of repeated passages: every byte covered by a string of ``length`` bytes that also starts in an earlier document.

1. Documents are packed into blocks of a megabyte or two, written once (bucketed by block).
2. Every window of ``length`` bytes has an anchor: the 16-byte gram in it with the least hash.  Equal
   windows have equal anchors, so a window can repeat only if its anchor's hash does: anchors are
   counted over all documents (least and greatest document per hash).
3. Around each anchor that occurs in two documents or more, the bytes of the windows that belong to
   it are sent to one place by its hash.  (An anchor that occurs very often sends its windows one
   by one, by their own hash, so that no group grows with a common line.)
   What a block sends to a range of hashes is one packed row.
4. There, equal pieces are merged, windows that cannot repeat (no other piece has their hash) are
   cut off, and the distinct rest is put into one suffix array, by linear grouping (``gsaca``).
   Neighbours in it that agree in ``length`` bytes are one string; its least document decides.
5. Each block gets bit masks of windows to remove and returns spans and the remaining bytes.

Hashes only narrow the work: what is removed follows from the bytes compared in the suffix array or
found equal as whole pieces.

Defined results
---------------
* null text: the empty text; texts shorter than ``length`` lose nothing;
* rows of equal id never remove from each other; a row with a null id neither loses nor causes loss;
* bytes are judged on the input; spans are maximal removed runs of bytes;
* empty table: empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import bucketed, dump, load, stash
from tokenloom.llm.components import map_groups
from tokenloom.llm.gsaca import equal_runs, suffix_array

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 1_500_000
STEP = 1 << 16  # places whose anchors are found together
CHUNK_BYTES = 1_000_000
BUCKET_CHARS = 32_000_000  # text whose blocks are joined in one task
RANGE_CHARS = 8_000_000  # text for each range of hashes
OFTEN = 100_000  # occurrences of an anchor beyond which its windows travel one by one (so a group has about 8 MB at most)
KEPT_BITS = 48  # of an anchor's hash while anchors are counted: equal bits of unequal anchors only add candidates
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def _grams(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as a number."""
    h = data.astype(_U)
    for s in (1, 2, 4):
        h = h[:-s] | (h[s:] << _U(8 * s))
    return h


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """Minimum (or maximum) of each window of ``width`` values."""
    have = 1
    while have * 2 <= width:
        x, have = least(x[:-have], x[have:]), have * 2
    rest = width - have
    return least(x[: len(x) - rest], x[rest:]) if rest else x


class Anchors:
    """Anchors of the windows of a block: places (ascending) and hashes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int):
        self.width = length - GRAM + 1
        self.length, self.starts = length, starts
        self.at, self.hash = np.zeros(0, np.int64), np.zeros(0, _U)
        if len(data) < length:
            return
        inside = np.ones(len(data) + 1, bool)  # windows that end in their document
        for s in starts[1:]:
            inside[max(0, s - length + 1) : s] = False
        found = [self._between(data, inside, a) for a in range(0, len(data) - GRAM + 1, STEP)]
        self.at, self.hash = (np.concatenate(x) for x in zip(*found, strict=True))

    def _between(self, data: np.ndarray, inside: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchors at places from ``a``, STEP of them: the arrays of one step fit a core's cache."""
        low_end = max(0, a - self.width + 1)
        part = data[low_end : a + STEP + self.width + GRAM - 2]
        if len(part) < self.length:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        e = _grams(part)
        g = _mix(_mix(e[:-8]) + e[8:]) | _U(1)
        low = _slide(g, self.width, np.minimum)
        low = np.where(inside[low_end : low_end + len(low)], low, _U(0))
        pad = np.zeros(self.width - 1, _U)
        high = _slide(np.concatenate([pad, low, pad]), self.width, np.maximum)
        own = slice(a - low_end, a - low_end + STEP)
        at = np.flatnonzero(high[own] == g[own])
        return at + a, g[own][at]

    def documents(self) -> np.ndarray:
        return np.searchsorted(self.starts, self.at, "right") - 1

    def windows(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window that belongs to each of the anchors numbered ``k`` (last < first: none)."""
        at, hashes, doc = self.at, self.hash, self.documents()[k]
        p, h = at[k], hashes[k]
        first = np.maximum(p - self.width + 1, self.starts[doc])
        last = np.minimum(p, self.starts[doc + 1] - self.length)
        open_, t = np.arange(len(k)), 1
        while len(open_):  # an earlier anchor with at most this hash ends the windows to the left
            q = k[open_] - t
            open_, q = open_[q >= 0], q[q >= 0]
            near = at[q] >= first[open_]
            open_, q = open_[near], q[near]
            wins = hashes[q] <= h[open_]
            first[open_[wins]] = at[q[wins]] + 1
            open_, t = open_[~wins], t + 1
        open_, t = np.arange(len(k)), 1
        while len(open_):  # a later one with a smaller hash ends those to the right
            q = k[open_] + t
            open_, q = open_[q < len(at)], q[q < len(at)]
            near = at[q] <= last[open_] + self.width - 1
            open_, q = open_[near], q[near]
            wins = hashes[q] < h[open_]
            last[open_[wins]] = at[q[wins]] - self.width
            open_, t = open_[~wins], t + 1
        return first, last


def _window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window of ``length`` bytes."""
    e = _grams(data)
    n = len(data) - length + 1
    h = np.zeros(n, _U)
    for s in [*range(0, length - 8, 8), length - 8]:
        h = _mix(h * _U(0xD1342543DE82EF95) + e[s : s + n])
    return h


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    pack = zstandard.ZstdCompressor(level=3)
    ids: list = []
    texts: list[bytes] = []
    size = 0

    def close() -> pa.RecordBatch:
        nonlocal ids, texts, size, n
        row = {
            "block": [part << 32 | n],
            "ids": [np.array([i or 0 for i in ids], "<i8").tobytes()],
            "known": [np.array([i is not None for i in ids], "<u1").tobytes()],
            "sizes": [np.array([len(t) for t in texts], "<i8").tobytes()],
            "data": [pack.compress(b"".join(texts))],
        }
        ids, texts, size, n = [], [], 0, n + 1
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("ids", "known", "sizes", "data")]]))

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            ids.append(i)
            texts.append(data)
            size += len(data)
            if size >= BLOCK_BYTES:
                yield close()
    if ids:
        yield close()


class _Block:
    def __init__(self, batch: pa.RecordBatch, k: int):
        col = lambda c: batch.column(c)[k].as_py()
        self.block = col("block")
        self.ids, self.known, sizes = np.frombuffer(col("ids"), "<i8"), np.frombuffer(col("known"), "<u1").astype(bool), np.frombuffer(col("sizes"), "<i8")
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(col("data"), max(1, int(self.starts[-1]))), np.uint8)


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Hashes of anchors are least ones, so small; this one-to-one map spreads them evenly."""
    return hashes * _U(0x9E3779B97F4A7C15)


def _short(hashes: np.ndarray) -> np.ndarray:
    return _spread(hashes) >> _U(64 - KEPT_BITS)


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which of equal ranges of 48-bit numbers each (ascending) key falls in."""
    return ((keys >> _U(16)) * _U(ranges) >> _U(32)).astype(np.int64)


def _slices(which: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else np.zeros(0, int)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(which)], strict=True):
        yield int(which[a]), slice(a, b)


def _counted(b: _Block, a: Anchors) -> tuple[np.ndarray, ...]:
    """Short hashes of a block's anchors, ascending, with least and greatest document and number of each, and what belongs to which.

    The last two are the anchors used (those of documents with an id) and, for each, the place of its hash.
    """
    doc = a.documents()
    used = np.flatnonzero(b.known[doc]) if len(doc) else np.zeros(0, int)
    h, d = _short(a.hash[used]), b.ids[doc[used]]
    if not len(h):
        return h, d, d, used, used, used
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    cut, place = np.flatnonzero(new), np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    return h[cut], np.minimum.reduceat(d, cut), np.maximum.reduceat(d, cut), np.diff([*cut, len(h)]), used, place


_SENT = pa.schema([("span", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_SENT.types)], schema=_SENT)


def _occurrences(length: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = _Block(batch, k)
                h, low, high, n = _counted(b, Anchors(b.data, b.starts, length))[:4]
                if len(h):
                    base = low.min()
                    yield _sent([(r, b.block, dump(np.diff(h[x], prepend=_U(0)), np.array([base]), (low[x] - base).astype(_U), (high[x] - low[x]).astype(_U), n[x].astype(np.uint32))) for r, x in _slices(_range(h, ranges))])

    return run


def _answer(group: pa.RecordBatch) -> pa.RecordBatch:
    """Of each block's anchors in a range, which occur in two documents or more, and which very often (as bits)."""
    parts = [load(x) for x in group.column("data").to_pylist()]
    sizes = np.array([len(p[0]) for p in parts])
    h = np.concatenate([np.cumsum(p[0], dtype=_U) for p in parts])
    low = np.concatenate([p[1][0] + p[2].astype(np.int64) for p in parts])
    high = low + np.concatenate([p[3].astype(np.int64) for p in parts])
    order = np.argsort(h, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    runs = np.diff([*cut, len(h)])
    shared = np.minimum.reduceat(low[order], cut) < np.maximum.reduceat(high[order], cut)
    often = shared & (np.add.reduceat(np.concatenate([p[4] for p in parts])[order].astype(np.int64), cut) > OFTEN)
    flags = np.zeros((2, len(h)), bool)
    flags[:, order] = np.repeat(np.stack([shared, often]), runs, axis=1)
    rows = []
    for block, end, n in zip(group.column("block").to_pylist(), np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
        own = flags[:, end - n : end]
        if own[0].any():
            rows.append((group.column("span")[0].as_py(), block, dump(np.packbits(own[0]), np.packbits(own[1]))))
    return _sent(rows)


def _pieces(length: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = _Block(batch, k)
                a = Anchors(b.data, b.starts, length)
                counted, _, _, _, used, number = _counted(b, a)
                place = dict(_slices(_range(counted, ranges)))
                flags = np.zeros((2, len(counted)), bool)
                for span, data in ((x["span"], x["data"]) for x in batch.column("answers")[k].as_py()):
                    at = place[span]
                    flags[:, at] = [np.unpackbits(bits, count=at.stop - at.start) for bits in load(data)]
                shared = flags[0][number]
                at, single = used[shared], flags[1][number[shared]]
                first, last = a.windows(at)
                h, doc = _spread(a.hash[at]), b.ids[a.documents()[at]]
                if single.any():
                    reps = np.where(single, last - first + 1, 1).clip(0)
                    begin = np.repeat(first, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                    own, h = np.repeat(single, reps), np.repeat(h, reps)
                    h[own] = _window_hashes(b.data, length)[begin[own]]
                    first, last, doc = begin, np.where(own, begin, np.repeat(last, reps)), np.repeat(doc, reps)
                keep = last >= first
                order = np.flatnonzero(keep)[np.argsort(h[keep], kind="stable")]
                first, last, h, doc = first[order], last[order], h[order], doc[order]
                raw, rows = b.data.tobytes(), []
                for span, x in _slices(_range(h >> _U(64 - KEPT_BITS), ranges)):
                    text = b"".join([raw[s : e + length] for s, e in zip(first[x].tolist(), last[x].tolist(), strict=True)])
                    rows.append((span, b.block, dump(np.diff(h[x], prepend=_U(0)), first[x].astype(np.uint32), np.array([doc[x].min()]), (doc[x] - doc[x].min()).astype(_U), (last[x] - first[x]).astype(np.uint8), np.frombuffer(text, np.uint8))))
                if rows:
                    yield _sent(rows)

    return run


def repeats(pieces: list[bytes], docs: np.ndarray, length: int) -> np.ndarray:
    """For each piece a bit mask of its windows (at most 64) that also start in a piece of a smaller document."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(p, len(number)) for p in pieces])
    distinct = list(number)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, which, docs)
    sizes = np.array([len(p) for p in distinct])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(distinct), np.uint8)
    n_windows = sizes - length + 1
    offset = np.cumsum(n_windows) - n_windows  # of a piece's windows in the list of all windows
    owner = np.repeat(np.arange(len(distinct)), n_windows)
    place = np.arange(n_windows.sum()) - offset[owner] + begins[owner]
    minimum = least[owner]
    if len(distinct) > 1:
        h = _window_hashes(data, length)[place]
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        again = count[back] > 1
        # Maximal runs of windows that may repeat, each distinct run once.
        at = np.flatnonzero(again)
        if len(at):
            new = np.concatenate([[True], (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])])
            heads = at[new]
            tails = at[np.concatenate([new[1:], [True]])]
            raw = data.tobytes()
            runs: dict[bytes, int] = {}
            run_of = [runs.setdefault(raw[place[s] : place[e] + length], len(runs)) for s, e in zip(heads.tolist(), tails.tolist(), strict=True)]
            texts = list(runs)
            joined = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int64) + 1
            stop = np.cumsum([len(t) + 1 for t in texts])
            joined[stop - 1] = 0
            begin = stop - [len(t) + 1 for t in texts]
            valid = np.ones(len(joined), bool)
            for e in stop:
                valid[max(0, e - length) : e] = False
            if len(texts) > 1:
                order = np.array(suffix_array(joined.tolist()))
                same = equal_runs(joined, valid, order, length)
                name = np.zeros(len(joined), np.int64)
                name[order] = np.cumsum(~same)
            else:
                name = np.arange(len(joined))
            # Names of all windows of all runs, then the least document of each name.
            lengths = tails - heads + 1
            windows = np.repeat(heads, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            names = name[np.repeat(begin[run_of], lengths) + windows - np.repeat(heads, lengths)]
            best = np.full(int(names.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(best, names, minimum[windows])
            minimum = minimum.copy()
            minimum[windows] = best[names]
    counts = n_windows[which]
    ends = np.cumsum(counts)
    within = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
    hit = minimum[np.repeat(offset[which], counts) + within] < np.repeat(docs, counts)
    return np.bitwise_or.reduceat(hit.astype(_U) << within.astype(_U), ends - counts)


def _masks(length: int):
    """All pieces of a range -> for each block the windows to remove."""

    def run(group: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = [load(x) for x in group.column("data").to_pylist()]
        blocks = np.repeat(group.column("block").to_numpy(), [len(p[0]) for p in parts])
        h = np.concatenate([np.cumsum(p[0], dtype=_U) for p in parts])
        start = np.concatenate([p[1] for p in parts])
        doc = np.concatenate([p[2][0] + p[3].astype(np.int64) for p in parts])
        size = np.concatenate([p[4].astype(np.int64) for p in parts]) + length
        text = b"".join(p[5].tobytes() for p in parts)
        ends = np.cumsum(size)
        order = np.argsort(h, kind="stable")
        mask = np.zeros(len(h), _U)
        # Chunks of bounded size; pieces of one hash stay together.
        cut = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        chunk = np.cumsum(np.add.reduceat(size[order], cut)) // CHUNK_BYTES
        for _, x in _slices(chunk):
            own = order[cut[x.start] : cut[x.stop] if x.stop < len(cut) else len(order)]
            pieces = [text[e - n : e] for e, n in zip(ends[own].tolist(), size[own].tolist(), strict=True)]
            mask[own] = repeats(pieces, doc[own], length)
        at = np.flatnonzero(mask)
        if not len(at):
            return None
        at = at[np.argsort(blocks[at], kind="stable")]
        rows = [(group.column("span")[0].as_py(), int(block), dump(start[at[x]], mask[at[x]])) for block, x in _slices(blocks[at])]
        return _sent(rows)

    return run


def _apply(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = _Block(batch, k)
                begins = np.zeros(len(b.data) + length, np.int32)  # windows to remove, ``length`` places later
                for data in batch.column("marks")[k].as_py() or []:
                    start, mask = load(data)
                    row, bit = np.nonzero(np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                    begins[start[row].astype(np.int64) + bit + length] = 1
                begun = np.cumsum(begins, dtype=np.int32)
                gone = begun[length:] > begun[: len(b.data)]  # one begins here or less than ``length`` places before
                rows: list[list] = [[], [], [], []]
                for i in range(len(b.ids)):
                    s, e = int(b.starts[i]), int(b.starts[i + 1])
                    g = gone[s:e]
                    spans: list[dict] = []
                    kept = b.data[s:e]
                    if g.any():
                        d = np.diff(np.concatenate([[0], g.view(np.int8), [0]]))
                        spans = [{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1), strict=True)]
                        kept = kept[~g]
                    for out, v in zip(rows, (int(b.ids[i]) if b.known[i] else None, e - s, spans, kept.tobytes()), strict=True):
                        out.append(v)
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, rows, strict=True)), schema=schema)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes) and kept (the remaining bytes) of every row."""
    if not GRAM + 1 <= length <= GRAM + 63:
        raise ValueError(f"length must be {GRAM + 1} to {GRAM + 63}")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = docs.agg(F.sum(F.length(text_col))).collect()[0][0] or 0
    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_pack, "block bigint, ids binary, known binary, sizes binary, data binary")
    blocks = bucketed(packed, "block", max(n, math.ceil(chars / BUCKET_CHARS)))

    ranges = max(n, math.ceil(chars / RANGE_CHARS))
    row = "span bigint, block bigint, data binary"
    counted = map_groups(blocks.mapInArrow(_occurrences(length, ranges), row), ["span"], _answer, row, ranges)
    answers = stash(counted.groupBy("block").agg(F.collect_list(F.struct("span", "data")).alias("answers")), "anchors-shared")  # bounded: bits of a block's anchors
    pieces = blocks.join(answers, "block").mapInArrow(_pieces(length, ranges), row)
    masks = map_groups(pieces, ["span"], _masks(length), row, ranges)
    marks = stash(masks.groupBy("block").agg(F.collect_list("data").alias("marks")), "repeat-marks")
    return blocks.join(marks, "block", "left").select("block", "ids", "known", "sizes", "data", "marks").mapInArrow(_apply(length), "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
