import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import images
from tokenloom.sources import exif


def directory(order, entries):
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    return head + struct.pack(order + "H", len(entries)) + b"".join(entries) + bytes(4)


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def jpeg(block, before=b""):
    body = b"Exif\0\0" + block
    return b"\xff\xd8" + before + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\2"


def test_headers(spark):
    short = lambda order, v: directory(order, [struct.pack(order + "HHIHH", 0x0100, 3, 1, 9, 0), struct.pack(order + "HHIHH", 0x0112, 3, 1, v, 0)])
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13))
    cases = [
        (jpeg(short("<", 6)), 6),
        (jpeg(short(">", 8), b"\xff\xe0\0\4ab\xff\xff\xfe\0\3x"), 8),
        (short("<", 3), 3),
        (png + chunk(b"eXIf", short(">", 5)), 5),
        (jpeg(directory("<", [struct.pack("<HHII", 0x0112, 4, 1, 7)])), 7),
        (jpeg(short("<", 0)), None),
        (jpeg(short("<", 9)), None),
        (jpeg(short("<", 6))[:30], None),
        (b"\xff\xd8\xff\xda\0\2" + jpeg(short("<", 6))[2:], None),  # after the picture's start
        (jpeg(b"II*\0\xff\xff\xff\xff"), None),
        (png, None), (b"", None), (None, None),
    ]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "id int, content binary")
    got = {r[0]: r[1] for r in rows.select("id", exif.orientation(F.col("content"))).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_palette_of_a_file(spark):
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])) + chunk(b"tRNS", b"\x09")
    rows = spark.createDataFrame([(1, png), (2, b"no image"), (3, None)], "id int, content binary")
    got = {r[0]: r[1] for r in rows.select("id", exif.palette(F.col("content"))).collect()}
    assert got == {1: [1, 2, 3, 9, 4, 5, 6, 255], 2: None, 3: None}


def test_upright_equals_turning_arrays(spark):
    """The eight orientations, stated as turns and mirrors of arrays, with three channels and no square."""
    turn = [lambda a: a, np.fliplr, lambda a: np.rot90(a, 2), np.flipud, lambda a: a.swapaxes(0, 1), lambda a: np.rot90(a, -1), lambda a: np.rot90(a.swapaxes(0, 1), 2), np.rot90]
    a = np.arange(2 * 3 * 3).reshape(2, 3, 3)
    rows = spark.createDataFrame([(o, 2, 3, 3, a.ravel().tolist()) for o in [*range(1, 9), 99, None]], "o int, h int, w int, ch int, data array<int>")
    h, w, data = images.upright(*[F.col(c) for c in ("h", "w", "ch", "data", "o")])
    for o, rows_, columns, out in rows.select("o", h, w, data).collect():
        want = turn[o - 1 if o in range(1, 9) else 0](a)
        assert (rows_, columns) == want.shape[:2], o
        assert out == want.ravel().tolist(), o


def test_empty_image_and_unknown_modes(spark):
    rows = spark.createDataFrame([(0, 5, 1, [], 6)], "h int, w int, ch int, data array<int>, o int")
    assert rows.select(*images.upright(*[F.col(c) for c in ("h", "w", "ch", "data", "o")])).first()[:] == (5, 0, [])
    with pytest.raises(Exception, match="unsupported mode"):
        spark.createDataFrame([("HSV", [1, 2, 3])], "m string, d array<int>").select(images.pixel_rgb(F.col("m"), F.col("d"))).collect()
