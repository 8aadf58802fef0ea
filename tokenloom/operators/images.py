"""Image values as tables: pixels(img_id, h, w, ch, data) with data in (y, x, channel) order, or one row per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = ("255", "01", "11")  # [0, 255], [0, 1], [-1, 1]


def guess_range(data: Column, dtype: str) -> Column:
    """Bytes are "255"; floats are "11" if any value is negative, else "01"."""
    if dtype == "uint8":
        return F.lit("255")
    if dtype not in ("float16", "float32", "float64"):
        raise TypeError(dtype)
    return F.when(F.array_min(data) < 0, "11").otherwise("01")


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def convert_value(x: Column, source: Column, target: str) -> Column:
    """One value between ranges: clipped; bytes are rounded half to even."""
    unit = F.when(source == "255", x / 255.0).when(source == "11", x / 2.0 + 0.5).otherwise(x)
    if target == "01":
        return _clip(unit, 0.0, 1.0)
    if target == "11":
        return _clip(unit * 2.0 - 1.0, -1.0, 1.0)
    if target == "255":
        return F.when(source == "255", x).otherwise(F.bround(_clip(unit, 0.0, 1.0) * 255.0, 0))
    raise ValueError(target)


def convert(data: Column, source: Column, target: str) -> Column:
    return F.transform(data, lambda x: convert_value(x, source, target))


def assert_image(h: Column, w: Column, ch: Column, data: Column) -> Column:
    """``data``, or an error: one or three channels and h * w * ch values."""
    good = ch.isin(1, 3) & (F.size(data) == h * w * ch)
    return F.when(good, data).otherwise(F.raise_error(F.lit("not an image of one or three channels")).cast("array<double>"))


def alpha_over_white(colour: Column, alpha: Column) -> Column:
    """One channel of an image with alpha (0 to 255) over white, rounded half to even."""
    return F.bround(alpha / 255.0 * colour + (1 - alpha / 255.0) * 255.0, 0)


def to_rgb(rows: DataFrame) -> DataFrame:
    """Samples (img_id, y, x, ch, data: 1 = L, 2 = LA, 3 = RGB, 4 = RGBA values of a pixel) to three channels."""
    d = F.col("data")
    alpha = F.when(F.col("ch") == 4, F.get(d, F.lit(3))).when(F.col("ch") == 2, F.get(d, F.lit(1))).otherwise(255.0)
    colour = [F.when(F.col("ch") >= 3, F.get(d, F.lit(k))).otherwise(F.get(d, F.lit(0))) for k in range(3)]
    known = rows.where(F.col("ch").between(1, 4))
    return known.withColumn("rgb", F.array(*[alpha_over_white(c, alpha) for c in colour])).drop("data")


def pixel_rgb(mode: Column, data: Column, palette: Column | None = None) -> Column:
    """Red, green and blue of a pixel (array of integers, 0 to 255) of mode 1, L, LA, RGB, RGBA, CMYK or P; other modes are an error.

    Alpha goes over white.  ``palette``: red, green, blue, alpha of each colour, for mode P; an index beyond it is black,
    and its alpha does not count, as for any conversion of a palette straight to three channels.
    """
    at = lambda i: F.get(data, F.lit(i))
    ink = 255 - at(3)

    def printed(c: Column) -> Column:  # ink times colour over 255, rounded
        p = c * ink + 128
        return F.greatest(ink - F.shiftright(F.shiftright(p, 8) + p, 8), F.lit(0))

    over = lambda c, a: alpha_over_white(c, a).cast("int")
    grey = lambda c: F.array(c, c, c)
    out = F.when(mode == "1", grey(F.when(at(0) != 0, 255).otherwise(0)))
    out = out.when(mode == "L", grey(at(0))).when(mode == "LA", grey(over(at(0), at(1)))).when(mode == "RGB", F.slice(data, 1, 3))
    out = out.when(mode == "RGBA", F.array(*[over(at(k), at(3)) for k in range(3)])).when(mode == "CMYK", F.array(*[printed(at(k)) for k in range(3)]))
    if palette is not None:
        out = out.when(mode == "P", F.array(*[F.coalesce(F.get(palette, 4 * at(0) + k), F.lit(0)) for k in range(3)]))
    return out.otherwise(F.raise_error(F.concat(F.lit("unsupported mode "), F.coalesce(mode, F.lit("null")))).cast("array<int>"))


def upright(h: Column, w: Column, ch: Column, data: Column, orientation: Column) -> tuple[Column, Column, Column]:
    """Height, width and data (row by row, channels innermost) of an image as it was taken; orientation 1, null or unknown: as it is.

    From 5 on rows and columns change places; what is then mirrored follows from the number alone.
    """
    o = F.coalesce(orientation, F.lit(1))
    turned = o.between(5, 8)
    rows, columns = F.when(turned, w).otherwise(h), F.when(turned, h).otherwise(w)

    def source(i: Column) -> Column:
        y, x, c = F.floor(i / (columns * ch)), F.floor(i / ch) % columns, i % ch
        a, b = F.when(turned, x).otherwise(y), F.when(turned, y).otherwise(x)  # row and column of the stored image
        a = F.when(o.isin(3, 4, 7, 8) & ~turned, h - 1 - a).when(turned & o.isin(7, 6), h - 1 - a).otherwise(a)
        b = F.when(o.isin(2, 3) & ~turned, w - 1 - b).when(turned & o.isin(7, 8), w - 1 - b).otherwise(b)
        return F.get(data, ((a * w + b) * ch + c).cast("int"))

    n = (h * w * ch).cast("int")
    return rows, columns, F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), source)).otherwise(data)


def channels_first(data: Column, h: int, w: int, ch: int) -> Column:
    """(y, x, channel) to (channel, y, x) order."""
    return F.transform(F.sequence(F.lit(0), F.lit(h * w * ch - 1)), lambda i: F.get(data, ((i % (h * w)) * ch + F.floor(i / (h * w))).cast("int")))


def channels_last(data: Column, h: int, w: int, ch: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(h * w * ch - 1)), lambda i: F.get(data, ((i % ch) * (h * w) + F.floor(i / ch)).cast("int")))


def grid(pixels: DataFrame, image: str, h: int, w: int, rows: int, cols: int, gap: int = 0) -> DataFrame:
    """Pixels (image number from 0, y, x) placed in a grid, row by row; images beyond it are left out."""
    inside = pixels.where(F.col(image) < rows * cols)
    return inside.withColumn("gy", F.col("y") + F.floor(F.col(image) / cols) * (h + gap)).withColumn("gx", F.col("x") + (F.col(image) % cols) * (w + gap))


def grid_columns(n: Column, rows: Column, compat: bool = False) -> Column:
    """Columns of a grid of n images: rounded up, or as the tail-dropping form does, down."""
    return F.floor(n / rows) if compat else F.ceil(n / rows)


def pad_to_square(cells: DataFrame, canvas: DataFrame, background: float = 255.0) -> DataFrame:
    """Pixels (img_id, y, x, v) centred on squares: ``canvas`` has img_id, h, w; offsets are rounded down."""
    side = F.greatest("h", "w")
    squares = canvas.withColumn("side", side).withColumn("oy", F.floor((F.col("side") - F.col("h")) / 2)).withColumn("ox", F.floor((F.col("side") - F.col("w")) / 2))
    full = squares.withColumn("sy", F.explode(F.sequence(F.lit(0), F.col("side").cast("int") - 1))).withColumn("sx", F.explode(F.sequence(F.lit(0), F.col("side").cast("int") - 1)))
    full = full.select("img_id", "sy", "sx", (F.col("sy") - F.col("oy")).alias("y"), (F.col("sx") - F.col("ox")).alias("x"))
    return full.join(cells, ["img_id", "y", "x"], "left").select("img_id", F.col("sy").alias("y"), F.col("sx").alias("x"), F.coalesce("v", F.lit(background)).alias("v"))


def resize_dims(h: Column, w: Column, size: Column) -> Column:
    """(halvings, h, w): halve both sides while the shorter is at least twice ``size``, then scale it to ``size``."""
    start = F.struct(F.lit(0).alias("halvings"), h.cast("int").alias("h"), w.cast("int").alias("w"))

    def halve(acc: Column, _: Column) -> Column:
        more = F.least(acc["h"], acc["w"]) >= 2 * size
        down = lambda x: F.when(more, F.floor(x / 2)).otherwise(x).cast("int")
        return F.struct((acc["halvings"] + more.cast("int")).alias("halvings"), down(acc["h"]).alias("h"), down(acc["w"]).alias("w"))

    def finish(acc: Column) -> Column:
        scale = size / F.least(acc["h"], acc["w"])
        side = lambda x: F.bround(x * scale, 0).cast("int")
        return F.struct(acc["halvings"].alias("halvings"), side(acc["h"]).alias("h"), side(acc["w"]).alias("w"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, halve, finish)


def box_of(i: Column, n: Column) -> Column:
    """Which of n // 2 equal boxes holds the middle of pixel i of n (on a border: the lower one)."""
    half = F.floor(n / 2)
    return F.floor(((2 * i + 1) * half + 2 * n - 1) / (2 * n)) - 1


def box_halve(cells: DataFrame, by: list[str], h: Column, w: Column) -> DataFrame:
    """Means of boxes of pixels (by, y, x, v) of an h x w image halved to h // 2 x w // 2; boxes of odd sides take two or three."""
    return cells.groupBy(*by, box_of(F.col("y"), h).alias("y"), box_of(F.col("x"), w).alias("x")).agg(F.avg("v").alias("v"))


def center_crop(cells: DataFrame, h: Column, w: Column, size: int) -> DataFrame:
    """The middle size x size pixels, offsets rounded down, counted from 0 again."""
    oy, ox = F.floor((h - size) / 2), F.floor((w - size) / 2)
    cut = cells.withColumn("_y", F.col("y") - oy).withColumn("_x", F.col("x") - ox).where(F.col("_y").between(0, size - 1) & F.col("_x").between(0, size - 1))
    return cut.withColumn("y", F.col("_y")).withColumn("x", F.col("_x")).drop("_y", "_x")


def upsample_nearest(cells: DataFrame) -> DataFrame:
    """Every pixel (y, x) becomes a 2 x 2 block."""
    twice = cells.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return twice.withColumn("y", F.col("y") * 2 + F.floor(F.col("_d") / 2)).withColumn("x", F.col("x") * 2 + F.col("_d") % 2).drop("_d")


def posterior_affine(sample: Column, scale: float = 0.3611, shift: float = 0.1159) -> Column:
    """Latent of a posterior sample; the constants are fixed values."""
    return (sample - shift) * scale


def posterior_affine_inverse(z: Column, scale: float = 0.3611, shift: float = 0.1159) -> Column:
    return z / scale + shift
