"""Images as files: a PNG encoder, and a Spark sink with a task's files and the job's commit.

``df.write.format("image_files").option("path", folder).mode("append").save()`` writes rows (name, h, w, ch, data) where
data holds h * w * ch values 0 .. 255, row by row, channels last (1: grey, 2: grey and alpha, 3: RGB, 4: RGBA).  A task writes
under a folder of its attempt; the commit moves the files of successful attempts to their names, so a failed or
repeated task leaves nothing behind.  Names come from ``sources.files.final_names``; the format is that of the name.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tokenloom.sources.files import final_names
from tokenloom.sources.tensors import opened

#: Fixed values of the PNG format: the signature, and colour types by the number of channels.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOUR = {1: 0, 2: 4, 3: 2, 4: 6}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels: np.ndarray, level: int = 6) -> bytes:
    """A PNG file of bytes (height, width, channels); each row is stored as differences from the pixel before it."""
    h, w, ch = pixels.shape
    if not h or not w or ch not in COLOUR:
        raise ValueError(f"no PNG of shape {pixels.shape}")
    before = np.concatenate([np.zeros((h, 1, ch), np.uint8), pixels[:, :-1]], axis=1)
    lines = np.concatenate([np.ones((h, 1), np.uint8), (pixels - before).reshape(h, -1)], axis=1)  # 1: filter "sub"
    head = struct.pack(">IIBBBBB", w, h, 8, COLOUR[ch], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def netpbm(pixels: np.ndarray) -> bytes:
    """A binary PGM or PPM file of one or three channels."""
    h, w, ch = pixels.shape
    if not h or not w or ch not in (1, 3):
        raise ValueError(f"no netpbm file of shape {pixels.shape}")
    return f"P{5 if ch == 1 else 6}\n{w} {h}\n255\n".encode() + pixels.tobytes()


ENCODERS = {"png": png, "pgm": netpbm, "ppm": netpbm}


def encoded(name: str, h: int, w: int, ch: int, data: list[int]) -> bytes:
    kind = name.rpartition(".")[2].lower()
    if kind not in ENCODERS:
        raise ValueError(f"{name}: no encoder for this format")
    values = np.array(data)
    if values.size != h * w * ch or values.size and (values.min() < 0 or values.max() > 255):
        raise ValueError(f"{name}: {values.size} values do not fill {h} x {w} x {ch} bytes")
    return ENCODERS[kind](values.astype(np.uint8).reshape(h, w, ch))


@dataclass
class _Files(WriterCommitMessage):
    moves: list[tuple[str, str]] = field(default_factory=list)


class ImageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return "name string, h int, w int, ch int, data array<int>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Files:
        files, path = opened(self.path)
        folder = f"{path}/_attempts-{self.job}/{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        out = _Files()
        for n, r in enumerate(rows):
            parts = r["name"].split("/")
            if ".." in parts or "" in parts:
                raise ValueError(f"{r['name']!r} is no name in the folder")
            with files.open_output_stream(f"{folder}/{n}") as f:
                f.write(encoded(r["name"], r["h"], r["w"], r["ch"], r["data"]))
            out.moves.append((f"{folder}/{n}", f"{path}/{r['name']}"))
        return out

    def commit(self, messages: list[_Files | None]) -> None:
        files, path = opened(self.path)
        moves = [m for message in messages if message for m in message.moves]
        names = [b for _, b in moves]
        taken = [] if self.overwrite else [x.path for x in files.get_file_info(names) if x.type != fs.FileType.NotFound]
        if len(set(names)) != len(names) or taken:
            self.abort(messages)
            raise ValueError(f"files are there already: {taken[:3]}" if taken else "two images have one name")
        for folder in {b.rpartition("/")[0] for b in names}:
            files.create_dir(folder, recursive=True)
        for a, b in moves:
            if self.overwrite and files.get_file_info(b).type != fs.FileType.NotFound:
                files.delete_file(b)
            files.move(a, b)
        self._clean(files, path)

    def abort(self, messages: list[_Files | None]) -> None:
        self._clean(*opened(self.path))

    def _clean(self, files: fs.FileSystem, path: str) -> None:
        attempts = f"{path}/_attempts-{self.job}"
        if files.get_file_info(attempts).type == fs.FileType.Directory:
            files.delete_dir(attempts)


def there(spark, path: str) -> DataFrame:
    """path: names of the files in a folder, below it included (a listing, not their contents)."""
    files, root = opened(path)
    found = [(x.path.removeprefix(root).lstrip("/"),) for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)) if x.type == fs.FileType.File]
    return spark.createDataFrame(found, "path string")


def save_images(images: DataFrame, folder: str, *, overwrite: bool = False) -> DataFrame:
    """Write images (id, path, h, w, ch, data) and return (id, path, name): nothing is overwritten unless asked.

    Of images that want one path the one with the least id gets it, if no file is there; the others get numbered names.
    """
    spark = images.sparkSession
    spark.dataSource.register(ImageFiles)
    wanted = images.select("id", "path")
    names = wanted.withColumn("name", F.col("path")) if overwrite else final_names(wanted, there(spark, folder))
    rows = images.join(names.select("id", "name"), "id").select("name", *[F.col(c).cast("int").alias(c) for c in ("h", "w", "ch")], F.col("data").cast("array<int>").alias("data"))
    rows.write.format("image_files").option("path", folder).mode("overwrite" if overwrite else "append").save()
    return names.select("id", "path", "name")
