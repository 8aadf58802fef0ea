"""Weight files in the safetensors layout as a Spark source and sink.

A file is an 8-byte little-endian length, a JSON header (name: dtype, shape, data_offsets) and the tensors' bytes.
The source reads only headers when it plans: each tensor, or each range of ``bytes`` of a large one, is an input
partition that reads nothing but its own bytes (small tensors share one), and filters on ``name`` leave the other tensors unread.  The sink
writes a file a task; only files that the job's commit lists get their final names, so a failed or repeated task
leaves nothing behind.

Paths go through pyarrow's file systems (local, s3, hdfs); ``spark.read`` options: ``path`` (a file, or a folder of
files), ``bytes`` (of a partition).  Rows of the source: file, name, dtype, shape, start (of the first element), data.
"""

from __future__ import annotations

import itertools
import json
import math
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from tokenloom.operators.kernels import bicubic_grid

#: Names of element types in the layout, and how their elements are stored.
DTYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}
SUFFIX = ".safetensors"
SCHEMA = "file string, name string, dtype string, shape array<long>, start long, data array<double>"
PART_BYTES = 16 << 20
#: A header longer than this is refused, as readers of the layout do.
MOST_HEADER = 100_000_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; a plain path is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_header(files: fs.FileSystem, path: str) -> tuple[dict, int]:
    """The header's entries and where the tensors' bytes begin."""
    with files.open_input_file(path) as f:
        size = f.size()
        (n,) = struct.unpack("<Q", f.read(8)) if size >= 8 else (MOST_HEADER + 1,)
        if n > min(MOST_HEADER, size - 8):
            raise ValueError(f"{path} has no header in the safetensors layout")
        header = json.loads(f.read(n))
    header.pop("__metadata__", None)
    for name, x in header.items():
        a, b = x["data_offsets"]
        if x["dtype"] not in DTYPES or b - a != int(np.prod(x["shape"], dtype=np.int64)) * np.dtype(DTYPES[x["dtype"]]).itemsize or 8 + n + b > size:
            raise ValueError(f"{path}: entry {name!r} does not fit the file")
    return header, 8 + n


def elements(raw: bytes, dtype: str) -> np.ndarray:
    """Numbers of stored bytes as doubles; a bfloat16 is the upper half of a float32."""
    x = np.frombuffer(raw, DTYPES[dtype])
    return ((x.astype("<u4") << 16).view("<f4") if dtype == "BF16" else x).astype(float)


def stored(x: np.ndarray, dtype: str) -> bytes:
    if dtype == "BF16":  # to the nearest, ties to even; a NaN stays one
        bits = x.astype("<f4").view("<u4").astype(np.uint64)
        rounded = (bits + 0x7FFF + (bits >> np.uint64(16) & np.uint64(1))) >> np.uint64(16)
        return np.where(np.isnan(x), 0x7FC0, rounded).astype("<u2").tobytes()
    return x.astype(DTYPES[dtype]).tobytes()


@dataclass
class _Range:
    path: str
    name: str
    dtype: str
    shape: list
    start: int  # of its first element
    at: int  # of its first byte
    size: int


@dataclass
class _Ranges(InputPartition):
    """What a task reads: a range of one large tensor, or several small tensors."""

    ranges: list[_Range]

    @property
    def size(self) -> int:
        return sum(r.size for r in self.ranges)


class Safetensors(DataSource):
    """spark.read.format("safetensors").load(path), df.write.format("safetensors").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("bytes", PART_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, max(8, most // 8 * 8)
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Filters on the name are applied to headers; the others go back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("name",):
                self.wanted.append(f)
            else:
                yield f

    def _wants(self, name: str) -> bool:
        tests = {EqualTo: lambda f: name == f.value, In: lambda f: name in f.value, StringStartsWith: lambda f: name.startswith(f.value)}
        return all(tests[type(f)](f) for f in self.wanted)

    def partitions(self) -> Sequence[InputPartition]:
        files, path = opened(self.path)
        info = files.get_file_info(path)
        if info.type == fs.FileType.Directory:
            found = sorted(x.path for x in files.get_file_info(fs.FileSelector(path)) if x.path.endswith(SUFFIX) and not x.base_name.startswith((".", "_")))
        else:
            found = [path]
        out = [_Ranges([])]
        for p in found:
            header, base = read_header(files, p)
            for name, x in header.items():
                if not self._wants(name):
                    continue
                (a, b), width = x["data_offsets"], np.dtype(DTYPES[x["dtype"]]).itemsize
                for at in range(a, max(b, a + 1), self.most):  # an empty tensor is a row too
                    size = min(self.most, b - at)
                    if out[-1].ranges and out[-1].size + size > self.most:
                        out.append(_Ranges([]))
                    out[-1].ranges.append(_Range(p, name, x["dtype"], x["shape"], (at - a) // width, base + at, size))
        return out

    def read(self, partition: _Ranges) -> Iterator[tuple]:
        files, _ = opened(self.path)
        for path, ranges in itertools.groupby(partition.ranges, key=lambda r: r.path):
            with files.open_input_file(path) as f:
                for r in ranges:
                    raw = f.read_at(r.size, r.at)
                    if len(raw) != r.size:
                        raise OSError(f"{path} ends within {r.name}")
                    yield path, r.name, r.dtype, r.shape, r.start, elements(raw, r.dtype).tolist()


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    names: list
    size: int


class _Writer(DataSourceWriter):
    """Rows: name, dtype, shape, data (other columns are left out); a tensor is one row."""

    def __init__(self, path: str, schema, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        self.columns = [f.name for f in schema.fields]
        missing = {"name", "dtype", "shape", "data"} - set(self.columns)
        if missing:
            raise ValueError(f"columns {sorted(missing)} are needed")

    def write(self, rows: Iterator) -> _Written:
        """One file with what the task gets, under a name that no other attempt has."""
        files, path = opened(self.path)
        header, parts, at = {}, [], 0
        for r in rows:
            raw = stored(np.array(r["data"], float), r["dtype"])
            if r["name"] in header or len(raw) != int(np.prod(r["shape"], dtype=np.int64)) * np.dtype(DTYPES[r["dtype"]]).itemsize:
                raise ValueError(f"tensor {r['name']!r} is repeated or does not have its shape")
            header[r["name"]] = {"dtype": r["dtype"], "shape": list(r["shape"]), "data_offsets": [at, at + len(raw)]}
            parts.append(raw)
            at += len(raw)
        if not header:
            return _Written(None, [], 0)
        head = json.dumps(header, ensure_ascii=False, separators=(",", ":")).encode()
        head += b" " * (-len(head) % 8)
        files.create_dir(f"{path}/_attempts-{self.job}", recursive=True)
        name = f"{path}/_attempts-{self.job}/{uuid.uuid4().hex}"
        with files.open_output_stream(name) as f:
            f.write(struct.pack("<Q", len(head)) + head)
            for p in parts:
                f.write(p)
        return _Written(name, list(header), at)

    def commit(self, messages: list[_Written | None]) -> None:
        files, path = opened(self.path)
        done = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.names)
        names = [n for m in done for n in m.names]
        if len(set(names)) != len(names):
            self.abort(messages)
            raise ValueError("a tensor name is written by two tasks")
        old = [x.path for x in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.path.endswith((SUFFIX, f"{SUFFIX}.index.json"))]
        if self.overwrite:
            for p in old:
                files.delete_file(p)
        elif old:
            self.abort(messages)
            raise ValueError(f"{path} has weight files")
        files.create_dir(path, recursive=True)
        index = {}
        for k, m in enumerate(done):
            name = f"model-{k + 1:05d}-of-{len(done):05d}{SUFFIX}"
            files.move(m.file, f"{path}/{name}")
            index |= dict.fromkeys(m.names, name)
        with files.open_output_stream(f"{path}/model{SUFFIX}.index.json") as f:
            f.write(json.dumps({"metadata": {"total_size": sum(m.size for m in done)}, "weight_map": index}, indent=2).encode())
        self._clean(files, path)

    def abort(self, messages: list[_Written | None]) -> None:
        files, path = opened(self.path)
        self._clean(files, path)

    def _clean(self, files: fs.FileSystem, path: str) -> None:
        attempts = f"{path}/_attempts-{self.job}"
        if files.get_file_info(attempts).type == fs.FileType.Directory:
            files.delete_dir(attempts)


def register(spark) -> None:
    spark.dataSource.register(Safetensors)


def read_tensors(spark, path: str, names: list[str] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """file, name, dtype, shape, start, data: ranges of the tensors of a file or folder; only ``names`` if given."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("safetensors").option("bytes", part_bytes).load(path)
    return rows if names is None else rows.where(F.col("name").isin(names))


def write_tensors(tensors: DataFrame, path: str, mode: str = "error") -> None:
    """Write name, dtype, shape, data to a folder: a file a partition, and the index of names."""
    register(tensors.sparkSession)
    tensors.select("name", "dtype", "shape", "data").write.format("safetensors").mode("overwrite" if mode == "overwrite" else "append").save(path)


def resampled(tensors: DataFrame, key: str, new_len: int) -> DataFrame:
    """name, dtype, shape, data of whole ``tensors``, with the position table ``key`` (..., side * side, width) resampled to ``new_len`` positions.

    A table that has as many positions already, or whose positions are no square, stays as it is.
    """
    side = math.isqrt(new_len)
    if side * side != new_len:
        raise ValueError(f"{new_len} is not a square")
    old = F.get("shape", F.size("shape") - 2)
    target = F.coalesce((F.col("name") == key) & (F.pow(F.floor(F.sqrt(old)), 2) == old) & (old != new_len), F.lit(False))
    rows = tensors.select("name", "dtype", "shape", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                *lead, n, width = r["shape"]
                data = np.concatenate([bicubic_grid(t, side).ravel() for t in np.array(r["data"], float).reshape(-1, n, width)])
                out.append({"name": r["name"], "dtype": r["dtype"], "shape": [*lead, new_len, width], "data": data})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    return rows.where(target).mapInArrow(run, rows.schema).unionByName(rows.where(~target))
