"""Incremental decoding with a key-value cache as keyed state.

The cache of a sequence is map state keyed by (branch and layer, block of positions): a step writes one block
of each layer and folds the stored blocks into a running softmax one at a time, so a task holds one block
whatever the length of the sequence, and nothing that was computed is computed again.  ``decode_stream`` takes
the rows of sequences as they come; ``generate_stream`` is the whole loop: the guidance branches of a sample are
read, each step puts their last outputs together, makes a token of them, and feeds it to all branches.

In a table all rows of a sequence are there, so nothing needs to outlive the task: the same steps take many sequences
of one length side by side, and the cache is a map of the task that goes to a file beyond ``HELD_BYTES``.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tokenloom.operators import kernels as K
from tokenloom.operators.tiled import fold

#: Positions of a block of the cache.
CACHE_BLOCK = 64
#: Positions that go through the layers together.
PREFILL = 256
#: Of a table: rows of the sequences that go side by side, rows of a sequence that goes alone as it comes, and bytes of a cache in memory.
SIDE_BY_SIDE, LONG, HELD_BYTES = 8192, 4096, 1 << 26


class Cache:
    """Keys and values of all layers of one sequence, or of some side by side, in blocks, behind any map of (layer, block) to lists."""

    def __init__(self, state, kv_heads: int, block: int = CACHE_BLOCK, first: int = 0, side: tuple[int, ...] = ()):
        """``first``: number of the first layer in the state, where several branches share it; ``side``: (sequences,) side by side."""
        self.state, self.kv_heads, self.block, self.first, self.side = state, kv_heads, block, first, side

    def read(self, layer: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(..., positions, kv_heads, width) of keys and of values of a block."""
        if not self.state.containsKey((self.first + layer, b)):
            return np.zeros((*self.side, 0, self.kv_heads, 0)), np.zeros((*self.side, 0, self.kv_heads, 0))
        n, k, v = self.state.getValue((self.first + layer, b))
        return np.asarray(k, float).reshape(*self.side, n, self.kv_heads, -1), np.asarray(v, float).reshape(*self.side, n, self.kv_heads, -1)

    def append(self, layer: int, at: int, k: np.ndarray, v: np.ndarray) -> None:
        """Rows for positions at, at + 1, ...; only the blocks they fall in are written."""
        end = at + k.shape[-3]
        for b in range(at // self.block, (end - 1) // self.block + 1):
            first = max(at, b * self.block)
            last = min(end, (b + 1) * self.block)
            new_k, new_v = k[..., first - at : last - at, :, :], v[..., first - at : last - at, :, :]
            if first > b * self.block:
                old_k, old_v = self.read(layer, b)
                new_k, new_v = np.concatenate([old_k, new_k], axis=-3), np.concatenate([old_v, new_v], axis=-3)
            stored = [x.ravel() if self.side else x.ravel().tolist() for x in (new_k, new_v)]
            self.state.updateValue((self.first + layer, b), (new_k.shape[-3], *stored))

    def attend(self, layer: int, q: np.ndarray, at: int) -> np.ndarray:
        """(..., queries, heads, width): queries of positions at, at + 1, ... over all keys up to their own."""
        n, heads, width = q.shape[-3:]
        per = heads // self.kv_heads
        states: list = [None] * heads
        for b in range((at + n - 1) // self.block + 1):
            k, v = self.read(layer, b)
            seen = b * self.block + np.arange(k.shape[-3]) <= at + np.arange(n)[:, None]
            for h in range(heads):
                scores = np.where(seen, q[..., h, :] @ np.swapaxes(k[..., h // per, :], -1, -2) / np.sqrt(width), -np.inf)
                states[h] = fold(states[h], scores, v[..., h // per, :])
        return np.stack([total / weight[..., None] for _, weight, total in states], axis=-2)


class DictState(dict):
    """A plain map in place of keyed state, for batches and tests."""

    containsKey = dict.__contains__  # noqa: N815
    getValue = dict.__getitem__  # noqa: N815
    updateValue = dict.__setitem__  # noqa: N815


class FileState:
    """A map of one task: the blocks written last are in memory, the others in a file that goes with the task."""

    def __init__(self) -> None:
        self.held, self.size, self.places, self.file = {}, 0, {}, None

    def containsKey(self, key) -> bool:  # noqa: N802
        return key in self.held or key in self.places

    def getValue(self, key) -> tuple:  # noqa: N802
        if key in self.held:
            return self.held[key]
        self.file.seek(self.places[key])
        return pickle.load(self.file)

    def updateValue(self, key, value: tuple) -> None:  # noqa: N802
        bytes_of = lambda v: v[1].nbytes + v[2].nbytes
        if key in self.held:
            self.size -= bytes_of(self.held.pop(key))
        self.held[key] = value
        self.size += bytes_of(value)
        while self.size > HELD_BYTES and len(self.held) > 1:
            old = next(iter(self.held))
            out = self.held.pop(old)
            self.size -= bytes_of(out)
            self.file = self.file or tempfile.TemporaryFile()
            self.places[old] = self.file.seek(0, 2)
            pickle.dump(out, self.file)


def decode_step(x: np.ndarray, at: int, cache: Cache, w: K.Weights, layers: int, heads: int) -> np.ndarray:
    """Hidden states of new rows x (..., positions, width) at positions at, at + 1, ..., through all layers and the final norm."""
    pos = at + np.arange(x.shape[-2])
    for layer in range(layers):
        name = f"layer{layer}"
        h = K.rms_norm(x, w[f"{name}.norm1.w"])
        q, k, v = (K.linear(h, w, f"{name}.{p}") for p in "qkv")
        d = q.shape[-1] // heads
        turned = [np.stack([K.rotate(a[..., j * d : (j + 1) * d], pos) for j in range(a.shape[-1] // d)], axis=-2) for a in (q, k)]
        cache.append(layer, at, turned[1], v.reshape(*x.shape[:-1], -1, d))
        x = x + K.linear(cache.attend(layer, turned[0], at).reshape(*x.shape[:-1], -1), w, f"{name}.o")
        x = x + K.gated_mlp(K.rms_norm(x, w[f"{name}.norm2.w"]), w, f"{name}.mlp")
    return K.rms_norm(x, w["norm.w"])


# ---------------------------------------------------------------- tables


def _vectors(column: pa.Array) -> np.ndarray:
    """Arrays of one width as rows."""
    if len(column) and (column.null_count or len(set(column.value_lengths().to_pylist())) > 1):
        raise ValueError("vectors must have one width")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _runs(columns: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """(start, end) of rows that have the same values."""
    new = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        own = np.array(c.to_pylist(), object) if c.null_count else c.to_numpy()
        new |= own[1:] != own[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(columns[0])]
    return zip(cuts[:-1], cuts[1:], strict=True) if len(columns[0]) else iter(())


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), pa.float64()))


def _decoded(batches: Iterator[pa.RecordBatch], weights: K.Weights, layers: int, heads: int, kv_heads: int, block: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of sequence and position: short sequences wait for others of their length, a long one is read as it comes."""
    waiting, rows = [], 0  # (key, vectors)
    key, parts, n, alone = None, [], 0, None  # the sequence that is read: its vectors not yet decoded, rows so far, its cache if it is long

    def result(keys: list[tuple], first: int, out: np.ndarray) -> pa.RecordBatch:
        size = out.shape[1]
        ids = [pa.array(np.repeat(np.arange(len(keys)), size)) for _ in range(2)]
        named = [pa.array([k[i] for k in keys], pa.int64()).take(at) for i, at in enumerate(ids)]
        return pa.RecordBatch.from_arrays([*named, pa.array(np.tile(np.arange(first, first + size), len(keys))), _lists(out.reshape(-1, out.shape[2]))], names=["sample_id", "branch", "pos", "out"])

    def step(keys: list[tuple], x: np.ndarray, at: int, cache: Cache) -> Iterator[pa.RecordBatch]:
        for a in range(0, x.shape[1], most):
            yield result(keys, at + a, decode_step(x[:, a : a + most], at + a, cache, weights, layers, heads))

    def flush() -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list] = {}
        for k, x in waiting:
            by_size.setdefault(len(x), []).append((k, x))
        for same in by_size.values():
            yield from step([k for k, _ in same], np.stack([x for _, x in same]), 0, Cache(FileState(), kv_heads, block, side=(len(same),)))

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal waiting, rows, parts
        if parts and alone:
            yield from advance()
        elif parts:
            waiting.append((key, np.concatenate(parts)))
            rows += n
            parts = []
            if rows >= SIDE_BY_SIDE:
                yield from flush()
                waiting, rows = [], 0

    def advance() -> Iterator[pa.RecordBatch]:
        nonlocal parts
        x = np.concatenate(parts)
        yield from step([key], x[None], n - len(x), alone)
        parts = []

    for batch in batches:
        sample, branch = batch.column("sample_id"), batch.column("branch")
        pos, vec = batch.column("pos").to_numpy(zero_copy_only=False), _vectors(batch.column("vec"))
        for a, b in _runs([sample, branch]):
            own = sample[a].as_py(), branch[a].as_py()
            if own != key:
                yield from close()
                key, parts, n, alone = own, [], 0, None
            if (pos[a:b] != np.arange(n, n + b - a)).any():
                raise ValueError(f"positions of {key} must follow {n - 1} without a gap")
            parts.append(vec[a:b])
            n += b - a
            if sum(map(len, parts)) >= LONG:
                alone = alone or Cache(FileState(), kv_heads, block, side=(1,))
                yield from advance()
    yield from close()
    yield from flush()


def _generated(batches: Iterator[pa.RecordBatch], weights: K.Weights, layers: int, heads: int, kv_heads: int, token: Callable, embed: Callable, block: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of sample, branch and position: samples whose branches have the same lengths, and that ask for as many tokens, go side by side."""
    waiting, rows = [], 0  # (sample, {branch: vectors}, tokens)
    key, branches, make, any_row = None, {}, 0, False

    def flush() -> Iterator[pa.RecordBatch]:
        alike: dict[tuple, list] = {}
        for s, x, m in waiting:
            alike.setdefault((m, *((b, len(v)) for b, v in x.items())), []).append((s, x))
        for (m, *lengths), same in alike.items():
            state, last, at, made = FileState(), {}, {}, []

            def feed(b: int, x: np.ndarray) -> None:
                cache = Cache(state, kv_heads, block, b * layers, (x.shape[0],))  # noqa: B023
                last[b] = decode_step(x, at.get(b, 0), cache, weights, layers, heads)[:, -1]  # noqa: B023
                at[b] = at.get(b, 0) + x.shape[1]  # noqa: B023

            for b, size in lengths:
                for a in range(0, size, PREFILL):
                    feed(b, np.stack([x[b][a : a + PREFILL] for _, x in same]))
            for n in range(m):
                outputs = np.stack([last[b] for b in sorted(last)], axis=1)
                made.append([np.asarray(token(o, s, n), float) for o, (s, _) in zip(outputs, same, strict=True)])
                if n + 1 < m:
                    new = np.stack([np.asarray(embed(t), float) for t in made[-1]])[:, None]
                    for b in last:
                        feed(b, new)
            ids = pa.array([s for s, _ in same], pa.int64())
            for n, tokens in enumerate(made):
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(same), n)), pa.array(tokens, pa.list_(pa.float64()))], names=["sample_id", "step", "token"])

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal waiting, rows
        if any_row and branches and make > 0:
            waiting.append((key, {b: np.concatenate(x) for b, x in branches.items()}, make))
            rows += sum(len(x) for x in waiting[-1][1].values())
            if rows >= SIDE_BY_SIDE:
                yield from flush()
                waiting, rows = [], 0

    for batch in batches:
        sample, branch = batch.column("sample_id"), batch.column("branch")
        asked = batch.column("make").fill_null(0).to_numpy()
        there = np.asarray(batch.column("pos").is_valid()) & np.asarray(branch.is_valid())
        for a, b in _runs([sample, branch]):
            own = sample[a].as_py()
            if not any_row or own != key:
                yield from close()
                key, branches, make, any_row = own, {}, 0, True
            make += int(asked[a:b].sum())
            if there[a:b].any():
                branches.setdefault(branch[a].as_py(), []).append(_vectors(batch.column("vec").slice(a, b - a).filter(pa.array(there[a:b]))))
    yield from close()
    yield from flush()


# ---------------------------------------------------------------- streams


class _Decode(StatefulProcessor):
    """Rows of a sequence in order of position, a step at a time; ``most`` rows go through the layers together."""

    def __init__(self, weights: K.Weights, layers: int, heads: int, kv_heads: int, block: int, most: int):
        self.weights, self.layers, self.heads, self.kv_heads, self.block, self.most = weights, layers, heads, kv_heads, block, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "layer int, block int", "n int, k array<double>, v array<double>")
        self.next = handle.getValueState("next", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("pos", kind="stable")
        at = self.next.get()[0] if self.next.exists() else 0
        if len(new) and new["pos"].tolist() != list(range(at, at + len(new))):
            raise ValueError(f"positions of {key} must follow {at - 1} without a gap")
        cache = Cache(self.blocks, self.kv_heads, self.block)
        for a in range(0, len(new), self.most):
            part = new.iloc[a : a + self.most]
            out = decode_step(np.array(part["vec"].tolist(), float), at + a, cache, self.weights, self.layers, self.heads)
            yield pd.DataFrame({"sample_id": key[0], "branch": key[1], "pos": part["pos"].to_numpy(), "out": list(out)})
        self.next.update((at + len(new),))

    def close(self) -> None:
        pass


def decode_stream(tokens: DataFrame, weights: K.Weights, *, layers: int, heads: int, kv_heads: int, block: int = CACHE_BLOCK, most: int = PREFILL) -> DataFrame:
    """sample_id, branch, pos, out for a stream (or table) of sample_id, branch, pos, vec (hidden width).

    In a stream each micro-batch brings the next positions of some sequences; a table is one batch that brings all.
    """
    if not tokens.isStreaming:
        sizes = K.check_size(weights), layers, heads, kv_heads, block, most
        rows = tokens.select(*[F.col(c).cast("long").alias(c) for c in ("sample_id", "branch", "pos")], F.col("vec").cast("array<double>").alias("vec"))
        dealt = rows.repartition("sample_id", "branch").sortWithinPartitions("sample_id", "branch", "pos")
        return dealt.mapInArrow(lambda batches: _decoded(batches, *sizes), "sample_id long, branch long, pos long, out array<double>")
    processor = _Decode(K.check_size(weights), layers, heads, kv_heads, block, most)
    return tokens.groupBy("sample_id", "branch").transformWithStateInPandas(processor, "sample_id long, branch long, pos long, out array<double>", "Append", "None")


class _Generate(StatefulProcessor):
    """A sample with all its branches; rows with ``make`` ask for that many more tokens."""

    def __init__(self, weights: K.Weights, layers: int, heads: int, kv_heads: int, block: int, token: Callable, embed: Callable):
        self.weights, self.layers, self.heads, self.kv_heads, self.block, self.token, self.embed = weights, layers, heads, kv_heads, block, token, embed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "layer int, block int", "n int, k array<double>, v array<double>")
        self.branches = handle.getMapState("branches", "branch int", "at long, last array<double>")
        self.made = handle.getValueState("made", "n long")

    def step(self, branch: int, x: np.ndarray) -> np.ndarray:
        """Feeds rows x to a branch; its last output is remembered."""
        at = self.branches.getValue((branch,))[0] if self.branches.containsKey((branch,)) else 0
        cache = Cache(self.blocks, self.kv_heads, self.block, branch * self.layers)
        out = decode_step(x, at, cache, self.weights, self.layers, self.heads)[-1]
        self.branches.updateValue((branch,), (at + len(x), out.tolist()))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        for branch, part in new[new["pos"].notna()].sort_values(["branch", "pos"], kind="stable").groupby("branch"):
            for a in range(0, len(part), PREFILL):
                self.step(int(branch), np.array(part["vec"].iloc[a : a + PREFILL].tolist(), float))
        made = self.made.get()[0] if self.made.exists() else 0
        last = {int(k[0]): np.array(v[1]) for k, v in self.branches.iterator()}
        tokens = []
        for n in range(made, made + int(new["make"].fillna(0).sum()) if last else made):
            tokens.append(self.token(np.stack([last[b] for b in sorted(last)]), key[0], n))
            x = np.asarray(self.embed(tokens[-1]), float)[None]
            last = {b: self.step(b, x) for b in last}
        self.made.update((made + len(tokens),))
        if tokens:
            yield pd.DataFrame({"sample_id": [key[0]] * len(tokens), "step": range(made, made + len(tokens)), "token": tokens})

    def close(self) -> None:
        pass


def generate_stream(rows: DataFrame, weights: K.Weights, *, layers: int, heads: int, kv_heads: int, token: Callable[[np.ndarray, int, int], np.ndarray], embed: Callable[[np.ndarray], np.ndarray], block: int = CACHE_BLOCK) -> DataFrame:
    """sample_id, step, token: the decode loop over a stream (or table) of sample_id, branch, pos, vec, make.

    Rows with a ``pos`` are the beginnings of branches, in order; rows whose ``make`` is set (the others may be null) ask for
    as many more tokens of the sample, in this or a later micro-batch.  ``token``: (last outputs of the branches as rows, sample,
    step) to a token; ``embed``: a token to the input of the next position.
    """
    if not rows.isStreaming:
        sizes = K.check_size(weights), layers, heads, kv_heads, token, embed, block
        table = rows.select(*[F.col(c).cast("long").alias(c) for c in ("sample_id", "branch", "pos", "make")], F.col("vec").cast("array<double>").alias("vec"))
        dealt = table.repartition("sample_id").sortWithinPartitions("sample_id", "branch", "pos")
        return dealt.mapInArrow(lambda batches: _generated(batches, *sizes), "sample_id long, step long, token array<double>")
    processor = _Generate(K.check_size(weights), layers, heads, kv_heads, block, token, embed)
    return rows.groupBy("sample_id").transformWithStateInPandas(processor, "sample_id long, step long, token array<double>", "Append", "None")


def guided(outputs: np.ndarray, cfg: float, cfg_img: float = 1.0) -> np.ndarray:
    """Outputs of one, two (condition, none) or three (condition, image condition, none) branches put together."""
    if len(outputs) == 1:
        return outputs[0]
    if len(outputs) == 2:
        return outputs[1] + cfg * (outputs[0] - outputs[1])
    return outputs[2] + cfg_img * (outputs[1] - outputs[2]) + cfg * (outputs[0] - outputs[1])
