"""Orientation and palettes from the headers of image files.

The pixels are decoded by Spark's own readers; these columns say how they are to be turned (``images.upright``)
and which colours their indices stand for (``images.pixel_rgb``).  A header is walked in one pass by a small
helper for each file, in Arrow batches; files that are cut short, or hold no such entry, give null.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats.
_ORIENTATION, _SHORT, _LONG = 0x0112, 3, 4
_START_OF_SCAN, _END_OF_IMAGE, _APP1 = 0xDA, 0xD9, 0xE1
_BARE_MARKERS = (0x01, *range(0xD0, 0xD9))
_EXIF = b"Exif\0\0"
_PNG = b"\x89PNG\r\n\x1a\n"


def tiff_orientation(block: bytes) -> int | None:
    """The orientation entry of the first directory of a TIFF block, of either byte order."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8:
        return None
    magic, at = struct.unpack_from(order + "HI", block, 2)
    if magic != 42 or at + 2 > len(block):
        return None
    (entries,) = struct.unpack_from(order + "H", block, at)
    for i in range(entries):
        place = at + 2 + 12 * i
        if place + 12 > len(block):
            return None
        tag, kind, count = struct.unpack_from(order + "HHI", block, place)
        if tag == _ORIENTATION and count == 1 and kind in (_SHORT, _LONG):
            return struct.unpack_from(order + ("H" if kind == _SHORT else "I"), block, place + 8)[0]
    return None


def _jpeg_block(data: bytes) -> bytes | None:
    """The TIFF block of the first Exif segment before the picture."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # padding
            at += 1
        elif marker in _BARE_MARKERS:
            at += 2
        elif marker in (_START_OF_SCAN, _END_OF_IMAGE):
            return None
        else:
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            if marker == _APP1 and body.startswith(_EXIF):
                return body[len(_EXIF) :]
            at += 2 + size
    return None


def png_chunk(data: bytes, name: bytes) -> bytes | None:
    at = len(_PNG)
    while at + 8 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        if data[at + 4 : at + 8] == name:
            return data[at + 8 : at + 8 + size]
        at += 12 + size
    return None


def file_orientation(data: bytes | None) -> int | None:
    """Of JPEG (Exif segment), PNG (eXIf chunk) and TIFF files; 1 to 8, else null."""
    if data is None:
        return None
    data = bytes(data)
    if data[:2] == b"\xff\xd8":
        block = _jpeg_block(data)
    elif data.startswith(_PNG):
        block = png_chunk(data, b"eXIf")
    else:
        block = data
    got = tiff_orientation(block) if block else None
    return got if got is not None and 1 <= got <= 8 else None


def file_palette(data: bytes | None) -> list[int] | None:
    """Red, green, blue and alpha of each colour of an indexed PNG, one after the other."""
    if data is None or not bytes(data).startswith(_PNG):
        return None
    colours, alpha = png_chunk(bytes(data), b"PLTE"), png_chunk(bytes(data), b"tRNS") or b""
    if colours is None:
        return None
    return [x for i in range(len(colours) // 3) for x in (*colours[3 * i : 3 * i + 3], alpha[i] if i < len(alpha) else 255)]


def orientation(content: Column) -> Column:
    """Orientation (1 to 8) that a file's header states, else null."""

    @F.pandas_udf("int")
    def parse(files: pd.Series) -> pd.Series:
        return pd.Series([file_orientation(f) for f in files], dtype="Int32")

    return parse(content)


def palette(content: Column) -> Column:
    """array<int>: red, green, blue, alpha of each colour of an indexed PNG, else null."""

    @F.pandas_udf("array<int>")
    def parse(files: pd.Series) -> pd.Series:
        return pd.Series([file_palette(f) for f in files], dtype=object)

    return parse(content)
