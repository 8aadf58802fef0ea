"""BPE encoding and decoding with a given vocabulary (never trained here).

Merging keeps a heap of (rank, place), packed in one integer, over a doubly linked list of symbols;
an entry whose symbols have meanwhile been merged is stale and skipped.  Decoding concatenates vocabulary strings.

The vocabulary file is JSON as the public ``tokenizers`` library writes it: BPE with an end-of-word
suffix, text normalised to NFC and lower case, white space dropped, words split by the pattern
below, bytes shown as printable characters.  No token crosses white space, so texts are cut into
pieces, each different piece of a batch is encoded once, and encodings of words and odd pieces are
kept in bounded tables in each worker.

Defined results: null text is encoded as the empty text (no ids, decoded to ""); special tokens in
a text are found before normalisation, as the library does; text of any length is encoded whole;
merges of equal rank go from left to right; repeated rows are encoded each for itself; an empty table
gives an empty result; columns are returned by ``encode_documents`` only if asked for (``keep``, which
must not name ids or decoded), and others may have any name.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed values of the format: white space, the word pattern, the end-of-word suffix.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACES + r"\p{L}\p{N}]+"
#: Words (and a third as many other pieces, and decoded pieces) of each of two generations that a worker remembers, and the longest worth remembering.
REMEMBERED, LONGEST = 250_000, 64
#: Bytes of text that are encoded together and handed on, about.
BATCH_BYTES = 8_000_000


def byte_names() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Memory(dict):
    """``make(key)`` of the keys asked for lately: two generations of bounded size."""

    def __init__(self, make: Callable, size: int = REMEMBERED):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str | bytes) -> bytes | str:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.left, self.right, self.merged, self.ranks = [], [], [], {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.merged.append(vocab[a + b])
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], rank)
        names = byte_names()
        self.inner, self.final = [vocab.get(c, -1) for c in names], [vocab.get(c + suffix, -1) for c in names]
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.spaces = regex.compile(f"[{SPACES}]+")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.word_ids, self.piece_ids, self.shown = Memory(self.word), Memory(self.piece, REMEMBERED // 3), Memory(self.decode, REMEMBERED // 3)

    def merge(self, s: list[int]) -> list[int]:
        """Apply merges in order of rank, leftmost first."""
        n, rank_of = len(s), self.ranks.get
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [r << bits | i for i in range(n - 1) if (r := rank_of(s[i] << 32 | s[i + 1])) is not None]
        if not heap:
            return s
        heapq.heapify(heap)
        pop, push, left, right, merged = heapq.heappop, heapq.heappush, self.left, self.right, self.merged
        before, after = list(range(-1, n)), list(range(1, n + 1))
        while heap:
            entry = pop(heap)
            i, r = entry & mask, entry >> bits
            j = after[i]
            if s[i] != left[r] or j >= n or s[j] != right[r]:
                continue  # stale
            s[i], s[j] = merged[r], -1
            after[i] = k = after[j]
            before[k] = i
            if k < n and (r := rank_of(s[i] << 32 | s[k])) is not None:
                push(heap, r << bits | i)
            if (h := before[i]) >= 0 and (r := rank_of(s[h] << 32 | s[i])) is not None:
                push(heap, r << bits | h)
        return [x for x in s if x >= 0]

    def word(self, word: str) -> bytes:
        data = word.encode("utf-8")
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.final[data[-1]]
        got = self.merge([x for x in symbols if x >= 0])
        return struct.pack(f"<{len(got)}I", *got)

    def piece(self, piece: str) -> bytes:
        """Ids of a text without white space (or of any text: words never cross white space)."""
        if self.cut and (parts := self.cut.split(piece)) and len(parts) > 1:
            return b"".join([struct.pack("<I", self.special[x]) if x in self.special else self.piece(x) for x in parts if x])
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        return b"".join([self.word_ids[w] for w in self.words.findall(piece.lower())])

    def pieces(self, text: str) -> list[str]:
        return self.spaces.split(text) if self.odd.search(text) else text.split()

    def of_pieces(self, pieces: pa.Array) -> list[bytes]:
        """Ids of different pieces; an ASCII word, perhaps with a full stop or comma, is looked up as a word at once."""
        dot, comma = pc.ends_with(pieces, "."), pc.ends_with(pieces, ",")
        word = pc.if_else(pc.or_(dot, comma), pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        plain = pc.and_(pc.utf8_is_alpha(word), pc.string_is_ascii(word))
        coded = pc.ascii_lower(word.filter(plain)).dictionary_encode()
        words = list(map(self.word_ids.__getitem__, coded.dictionary.to_pylist()))
        mark = (dot.to_numpy(zero_copy_only=False) + 2 * comma.to_numpy(zero_copy_only=False).astype(np.int8)).tolist()
        plain, marks = plain.to_numpy(zero_copy_only=False), [b"", self.word_ids["."], self.word_ids[","]]
        out: list = [None] * len(pieces)
        for i, k in zip(np.flatnonzero(plain).tolist(), coded.indices.to_numpy().tolist(), strict=True):
            out[i] = words[k] + marks[mark[i]] if mark[i] else words[k]
        rest = np.flatnonzero(~plain)
        for i, p in zip(rest.tolist(), pieces.take(pa.array(rest)).to_pylist(), strict=True):
            out[i] = self.piece_ids[p]
        return out

    def encode_all(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids (binary) and what they decode to, of each text; pieces that are equal are looked up once."""
        odd = np.flatnonzero(pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)).tolist()  # white space for Arrow, not here
        whole = {i: self.encode(texts[i].as_py()) for i in odd}
        if whole:
            texts = pc.if_else(pa.array([i in whole for i in range(len(texts))]), "", texts)
        cut = pc.utf8_split_whitespace(texts)
        coded = cut.values.dictionary_encode()
        found, which = self.of_pieces(coded.dictionary), coded.indices.to_numpy()
        lengths = np.array([len(x) for x in found], np.int64)
        some = lengths[which] > 0  # blanks at the ends of a text give empty pieces
        begin = np.concatenate([[0], np.cumsum(some)])[cut.offsets.to_numpy()].astype(np.int32)
        which = pa.array(which[some])
        ids = pc.binary_join(pa.ListArray.from_arrays(begin, pa.array(found, pa.binary()).take(which)), b"")
        decoded = pc.binary_join(pa.ListArray.from_arrays(begin, pa.array(map(self.shown.__getitem__, found), pa.string()).take(which)), " ")
        if whole:
            ids = pa.array([whole.get(i, x) for i, x in enumerate(ids.to_pylist())], pa.binary())
            decoded = pa.array([self.decode(whole[i]) if i in whole else x for i, x in enumerate(decoded.to_pylist())], pa.string())
        return ids, decoded

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        return b"".join(map(self.piece_ids.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings with a space between, as the library does for a file without a decoder; unknown ids are skipped."""
        got = np.frombuffer(ids, "<u4").tolist()
        try:
            return " ".join(map(self.names.__getitem__, got))
        except KeyError:
            return " ".join(self.names[i] for i in got if i in self.names)


@lru_cache(4)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, vocab_path: str, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ids (binary: little-endian unsigned 32-bit) and decoded (string) of every row."""
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocab_path)
        for batch in batches:
            texts = pc.fill_null(batch.column(n), "")
            upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    ids, decoded = bpe.encode_all(texts.slice(a, b - a))
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(n)], ids, decoded], names=[*names, "ids", "decoded"])

    names = list(keep)
    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return docs.select(*keep, docs[text_col].alias("_text")).mapInArrow(run, schema)
