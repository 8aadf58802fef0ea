"""Token-ID files of directly addressable codes.

An id is cut into chunks of a few bits, lowest first.  Level l holds the l-th chunks of all ids
that have one, with a bitmap that tells which go on, and a directory with the number of set bits
before each block of the bitmap.  The rank of an id's bit is its place on the next level, so any
id is read without decoding a block, and a run of ids is one contiguous run on every level.

File: magic, counts, the document directory (ids of documents, null flags, first token), then for
each level its length, chunks, bitmap and rank directory; all numbers little-endian.

``write_documents`` encodes whole texts with the ``tokenizers`` library (piece by piece: the
vocabulary's tokens never cross white space), in ascending order of id: range partitions, one or
more files each.  Ranges are cut by id, then by the beginning of the text, its digest and the row, so that
rows of one id (or without one) and even equal rows spread over tasks.  Each attempt of a task writes files of its own
name, under a hidden one first; the list that comes back names those that count, and only they are read.

Defined results: null text is the empty text (only the end id); rows of equal id are ordered by
the first 64 characters of their text, then by its md5; null ids come first; texts of any length are encoded whole, a document is never cut between
files; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.bpe import LONGEST
from tokenloom.llm.common import fresh_path, stash, text_of

MAGIC = b"DACIDS01"
WIDTHS = (8, 8, 16)  # bits of the levels; 32 in all
BLOCK = 512  # bits between two entries of a rank directory
FILE_IDS = 4_000_000  # a file is closed after the document that reaches so many ids
HEAD_CHARS = 64  # of the text, in the order of rows of one id
BATCH_BYTES = 4_000_000  # of texts encoded together, about
PIECES = 400_000  # pieces, and words, of each of two generations that a worker remembers
ODD_SPACES = "[\x1c-\x1f]"  # white space for Arrow, not for the library

_FORMATS = [f"<{n}I" for n in range(64)]
_DTYPES = {8: "<u1", 16: "<u2", 32: "<u4"}


def pack(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    """The bytes of a file.  ``starts``: first token of each document, and the number of ids at the end."""
    out = [MAGIC, struct.pack("<QQB", len(ids), len(doc_ids), len(WIDTHS))]
    out += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "<u1").tobytes(), starts.astype("<u8").tobytes()]
    rest = ids.astype(np.uint64)
    for level, width in enumerate(WIDTHS):
        chunk = (rest & np.uint64((1 << width) - 1)).astype(_DTYPES[width])
        rest = rest >> np.uint64(width)
        more = rest > 0 if level + 1 < len(WIDTHS) else np.zeros(len(rest), bool)
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u8")
        out += [struct.pack("<BQ", width, len(chunk)), chunk.tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = rest[more]
    return b"".join(out)


class DacFile:
    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-ID file")
        at = 8

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, dtype, n, at)
            at += got.nbytes
            return got

        self.n_ids, self.n_docs, levels = struct.unpack_from("<QQB", data, at)
        at += 17
        self.doc_ids, self.nulls, self.starts = take("<i8", self.n_docs), take("<u1", self.n_docs), take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            width, n = struct.unpack_from("<BQ", data, at)
            at += 9
            chunks, bits = take(_DTYPES[width], n), take("<u1", -(-n // 8))
            self.levels.append((width, chunks, bits, take("<u8", -(-n // BLOCK) + 1)))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place i."""
        _, _, bits, ranks = self.levels[level]
        first = i // BLOCK * BLOCK
        whole, part = bits[first // 8 : i // 8], i % 8
        n = int(ranks[i // BLOCK]) + int(np.bitwise_count(whole).sum())
        return n + (int(bits[i // 8]) & ((1 << part) - 1)).bit_count() if part else n

    def token(self, i: int) -> int:
        """The i-th id, read from its own chunks alone."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for level, (width, chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            shift, i = shift + width, self._rank(level, i)
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (exclusive)."""
        value, which, shift = np.zeros(b - a, np.uint32), slice(None), 0
        for level, (width, chunks, bits, _) in enumerate(self.levels):
            if b <= a:
                break
            value[which] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            on = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            which = np.flatnonzero(on) if level == 0 else which[on]
            a, b, shift = self._rank(level, a), self._rank(level, a) + int(on.sum()), shift + width
        return value

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


class _Library:
    """The ``tokenizers`` library with bounded memories of pieces between white space and of words.

    Texts are cut into pieces and equal pieces of a batch are put together by Arrow, so each
    different piece is looked up once a batch.  The vocabulary's pattern splits letters from all
    else and lowers letters, so a piece of letters with a full stop or comma is its letters and that
    mark, and words of letters can be encoded many at a time: each ends where a token with the
    end-of-word suffix does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        suffix = self.tokenizer.model.end_of_word_suffix
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.model, self.direct = self.tokenizer.model, False
        probe = ["a", "of", "token", "unbelievably", "qzxjv"]
        self.direct = self.letters(probe) == self.ids(probe) == [struct.pack(_FORMATS[len(x)], *[t.id for t in x]) for x in map(self.model.tokenize, probe)]
        self.marks = self.ids(["", ".", ","])
        self.memories: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {"words": ({}, {}), "pieces": ({}, {})}

    def ids(self, texts: list[str]) -> list[bytes]:
        found = (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))
        return [struct.pack(f"<{len(i)}I", *i) for i in found]

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: ASCII ones in lower case go straight to the library's model, if nothing else would change them."""
        out: list = [None] * len(words)
        tokenize = self.model.tokenize
        rest = []
        for i, w in enumerate(words):
            if self.direct and w.isascii():
                ids = [t.id for t in tokenize(w)]
                out[i] = struct.pack(_FORMATS[len(ids)] if len(ids) < len(_FORMATS) else f"<{len(ids)}I", *ids)
            else:
                rest.append(i)
        if rest:
            (data,) = self.ids([" ".join([words[i] for i in rest])])
            stops = ((np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 1) * 4).tolist()
            found = [data[a:b] for a, b in zip([0, *stops], stops, strict=False)] if len(stops) == len(rest) else self.ids([words[i] for i in rest])
            for i, x in zip(rest, found, strict=True):
                out[i] = x
        return out

    def known(self, names: list[str], make: Callable[[list[str]], list[bytes]], memory: str) -> list[bytes]:
        """Ids of different words or pieces: remembered ones, else made all in one go."""
        now, old = self.memories[memory]
        if len(now) > PIECES:
            now, old = self.memories[memory] = {}, now
        out = list(map(now.get, names))
        missing = [i for i, x in enumerate(out) if x is None]
        for i in missing:
            if (x := old.get(names[i])) is not None:
                out[i] = now[names[i]] = x
        missing = [i for i in missing if out[i] is None]
        for i, x in zip(missing, make([names[i] for i in missing]) if missing else [], strict=True):
            out[i] = x
            if len(names[i]) <= LONGEST:
                now[names[i]] = x
        return out

    def of_pieces(self, pieces: pa.Array) -> list[bytes]:
        """Ids of different pieces."""
        dot, comma = pc.ends_with(pieces, "."), pc.ends_with(pieces, ",")
        word = pc.if_else(pc.or_(dot, comma), pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        plain = pc.utf8_is_alpha(word)
        word = pc.if_else(pc.string_is_ascii(word), pc.ascii_lower(word), word)
        coded = word.filter(plain).dictionary_encode()
        words = self.known(coded.dictionary.to_pylist(), self.letters, "words")
        mark = (dot.to_numpy(zero_copy_only=False) + 2 * comma.to_numpy(zero_copy_only=False).astype(np.int8)).tolist()
        plain = plain.to_numpy(zero_copy_only=False)
        out: list = [None] * len(pieces)
        for i, k in zip(np.flatnonzero(plain).tolist(), coded.indices.to_numpy().tolist(), strict=True):
            out[i] = words[k] + self.marks[mark[i]] if mark[i] else words[k]
        rest = np.flatnonzero(~plain)
        for i, x in zip(rest.tolist(), self.known(pieces.take(pa.array(rest)).to_pylist(), self.ids, "pieces"), strict=True):
            out[i] = x
        return out

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """Ids of each text and the end id."""
        odd = np.flatnonzero(pc.match_substring_regex(texts, ODD_SPACES).to_numpy(zero_copy_only=False))
        whole = {int(i): self.ids([texts[i].as_py()])[0] for i in odd}
        if whole:
            texts = pc.if_else(pa.array([i in whole for i in range(len(texts))]), "", texts)
        cut = pc.utf8_split_whitespace(texts)
        coded = cut.values.dictionary_encode()
        which = coded.indices.to_numpy()
        found = self.of_pieces(coded.dictionary)
        lengths = np.array([len(x) // 4 for x in found], np.int64)
        flat = np.frombuffer(b"".join(found), "<u4")
        first = np.cumsum(lengths) - lengths
        n = lengths[which]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[cut.offsets.to_numpy()]
        ids = np.insert(ids, cuts[1:], end).astype("<u4")
        cuts = cuts + np.arange(len(cuts))
        return [np.append(np.frombuffer(whole[i], "<u4"), np.uint32(end)) if i in whole else ids[a:b] for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]


@lru_cache(4)
def _library(path: str) -> _Library:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return _Library(path)


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Of a folder; what Spark's configuration calls s3a is s3 here."""
    return pafs.FileSystem.from_uri("s3://" + uri.split("://", 1)[1] if uri.startswith(("s3a://", "s3n://")) else uri)


def write_documents(docs: DataFrame, vocab_path: str, to: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files to the folder ``to`` (a URI); returns their list: part, file, name, n_docs, n_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _file_system(to)
        fs.create_dir(folder, recursive=True)
        library = _library(vocab_path)
        context = TaskContext.get()
        part, file = context.partitionId(), 0
        doc_ids, held, n = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, held, n, file
            starts = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            name = f"{part:06d}-{file:06d}-{context.taskAttemptId()}.dac"
            hidden = f"{folder}/_{name}"
            with fs.open_output_stream(hidden) as f:
                f.write(pack(np.concatenate(held), doc_ids, starts))
            fs.move(hidden, f"{folder}/{name}")
            row = pa.RecordBatch.from_pydict({"part": [part], "file": [file], "name": [name], "n_docs": [len(doc_ids)], "n_ids": [n]}, schema=pa.schema([("part", pa.int64()), ("file", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            doc_ids, held, n, file = [], [], 0, file + 1
            return row

        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows = batch.slice(a, b - a)
                for doc_id, got in zip(rows.column(0).to_pylist(), library.encode(rows.column(1), end_id) if b > a else [], strict=True):
                    doc_ids.append(doc_id)
                    held.append(got)
                    n += len(got)
                    if n >= file_ids:
                        yield close()
        if doc_ids:
            yield close()

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.left(text, F.lit(HEAD_CHARS)).alias("head"), F.md5(text.cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange("doc_id", "head", "digest", "row").sortWithinPartitions("doc_id", "head", "digest").select("doc_id", "text")
    return stash(ordered.mapInArrow(run, "part long, file long, name string, n_docs long, n_ids long"), "dac-list")


def read_documents(spark: SparkSession, listed: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary, little-endian 32-bit) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                dac, name = DacFile(content.as_buffer()), path.rsplit("/", 1)[1]
                for a in range(0, dac.n_docs, 1000):
                    ks = range(a, min(a + 1000, dac.n_docs))
                    first = int(dac.starts[a])
                    run_of = dac.tokens(first, int(dac.starts[ks.stop])).astype("<u4").tobytes()
                    cuts = ((dac.starts[a : ks.stop + 1] - first) * 4).tolist()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "name": [name] * len(ks),
                            "doc_id": [None if dac.nulls[k] else int(dac.doc_ids[k]) for k in ks],
                            "inside": [int(dac.starts[k]) for k in ks],
                            "ids": [run_of[x:y] for x, y in zip(cuts, cuts[1:], strict=False)],
                        },
                        schema=pa.schema([("name", pa.string()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("ids", pa.binary())]),
                    )

    parts = listed.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    in_part = Window.partitionBy("part").orderBy("file")
    bases = listed.join(parts, "part").select("name", (F.col("before") + F.sum("n_ids").over(in_part) - F.col("n_ids")).alias("base"))
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.dac").load(folder).select("path", "content")
    rows = files.mapInArrow(run, "name string, doc_id long, inside long, ids binary")
    return rows.join(bases, "name").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "ids")


def write_and_read(docs: DataFrame, vocab_path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    spark = docs.sparkSession
    folder = fresh_path(spark, "dac")
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    listed = write_documents(docs, vocab_path, folder, end_id=end_id, id_col=id_col, text_col=text_col, file_ids=file_ids)
    return read_documents(spark, listed, folder)


def crc32_of_ids(ids: bytes) -> int:
    return zlib.crc32(ids)
