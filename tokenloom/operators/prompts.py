"""Captions, guidance branches and padded token batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions.ordering import running_before
from tokenloom.functions.text import hw_to_string

# Token heights and widths of the aspect-ratio buckets.
ASPECT_RATIOS = [
    (8, 32), (9, 28), (10, 25), (11, 23), (12, 21), (13, 19), (14, 18), (15, 17), (16, 16),
    (17, 15), (18, 14), (19, 13), (21, 12), (23, 11), (25, 10), (28, 9), (32, 8),
]
ANY_ASPECT_RATIO = (0, 0)

# Special tokens and the label that losses ignore.
PAD = "[PAD]"
IMAGE_AREA = "<|image_area|>"
BEGIN_IMAGE = "<|begin_of_image|>"
END_IMAGE = "<|end_of_image|>"
PLACEHOLDER = "<|image_placeholder|>"
SPECIAL_TOKENS = [
    ("pad", PAD),
    ("image_area", IMAGE_AREA),
    ("begin_image", BEGIN_IMAGE),
    ("end_image", END_IMAGE),
    ("image_placeholder", PLACEHOLDER),
    ("begin_prompt_refinement", "<|begin_of_prompt_refinement|>"),
    ("end_prompt_refinement", "<|end_of_prompt_refinement|>"),
    ("begin_thinking", "<|begin_of_thinking|>"),
    ("end_thinking", "<|end_of_thinking|>"),
]
IGNORE_INDEX = -100
MARKER = "<image>"


def aspect_ratios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASPECT_RATIOS, "h int, w int")


def special_tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(SPECIAL_TOKENS)], "ord int, role string, token string")


def hw_base(table: DataFrame) -> DataFrame:
    """One row: the mean of the rounded square roots of h * w, rounded (half to even both times)."""
    return table.agg(F.bround(F.avg(F.bround(F.sqrt(F.col("h") * F.col("w")), 0)), 0).cast("long").alias("hw_base"))


def image_string(h: Column, w: Column, down_factor: int = 16) -> Column:
    """Area token, size in tokens, and a placeholder per token between begin and end."""
    lh, lw = F.floor(h / down_factor).cast("int"), F.floor(w / down_factor).cast("int")
    return F.concat(F.lit(IMAGE_AREA), hw_to_string(lh, lw), F.lit(BEGIN_IMAGE), F.repeat(F.lit(PLACEHOLDER), lh * lw), F.lit(END_IMAGE))


def marker_count(caption: Column) -> Column:
    return F.regexp_count(caption, F.lit(MARKER))


def marker_violations(captions: DataFrame) -> DataFrame:
    """Captions that do not have exactly one marker, with the number they have."""
    return captions.withColumn("markers", marker_count(F.col("caption")).cast("long")).where("markers <> 1")


def substitute_images(captions: DataFrame, images: DataFrame, down_factor: int = 16) -> DataFrame:
    """Replace the k-th marker of all captions (in order of sample_id) by the string of image k.

    captions: sample_id, caption; images: image_idx (from 0), h, w.  Captions without markers stay.
    """
    counted = captions.withColumn("markers", marker_count(F.col("caption")))
    placed = running_before(counted, F.col("markers"), ["sample_id"], "first_image")
    parts = placed.select("sample_id", "first_image", F.posexplode(F.split("caption", MARKER)).alias("part", "text"))
    parts = parts.withColumn("image_idx", F.when(F.col("part") > 0, F.col("first_image") + F.col("part") - 1))
    strings = images.select("image_idx", image_string(F.col("h"), F.col("w"), down_factor).alias("image"))
    joined = parts.join(strings, "image_idx", "left").withColumn("piece", F.concat(F.when(F.col("part") > 0, F.coalesce("image", F.lit(MARKER))).otherwise(""), F.col("text")))
    return joined.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "").alias("caption"))


def repeat_captions(captions: DataFrame, times: int) -> DataFrame:
    """Adjacent copies: (sample_id, rep) is the new order."""
    return captions.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))


def block_repeat(rows: DataFrame, times: int) -> DataFrame:
    """Whole-block copies: (rep, id) is the new order."""
    return rows.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))


def with_positive(caption: Column, positive: str | None) -> Column:
    return F.concat(caption, F.lit(f" {positive}")) if positive else caption


def guidance_branches(cfg: float, cfg_img: float) -> int:
    """Number of branches; combinations that the sampler could not use are rejected."""
    if cfg < 1 or cfg_img < 1 or (cfg == 1 and cfg_img != 1):
        raise ValueError(f"guidance ({cfg}, {cfg_img}) has no branches")
    return 1 + (cfg > 1) + (cfg_img > 1)


def guidance_captions(captions: DataFrame, *, cfg: float, cfg_img: float, negative: str | None = None, down_factor: int = 16) -> DataFrame:
    """``captions`` (with h, w if images guide too) with a branch column: 0 as given, then unconditional ones."""
    n, negative = guidance_branches(cfg, cfg_img), F.lit(negative or "")
    texts = [F.col("caption")]
    if n == 3:
        texts.append(F.concat(image_string(F.col("h"), F.col("w"), down_factor), negative))
    if n >= 2:
        texts.append(negative)
    rows = captions.withColumn("_b", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("branch"), t.alias("caption")) for i, t in enumerate(texts)])))
    return rows.select(*[c for c in captions.columns if c != "caption"], "_b.branch", "_b.caption")


def words(text: Column) -> Column:
    """Stand-in tokeniser: runs of anything but white space."""
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def word_id(word: Column) -> Column:
    """Stand-in vocabulary: crc32 of the word."""
    return F.crc32(word.cast("binary"))


def left_pad(rows: DataFrame, ids: str, pad_id: int, prefix: list[int] | None = None, batch: list[str] | None = None) -> DataFrame:
    """ids and mask of equal length, padded on the left; ``prefix`` is appended on the right with mask 1.

    Rows of one ``batch`` (columns; nulls are a batch of their own) are as long as its longest; without it, all rows as the longest of all.
    """
    if batch is None:
        longest = rows.agg(F.max(F.size(ids)).alias("_longest"))  # one row
        joined = rows.crossJoin(F.broadcast(longest))
    else:
        longest = rows.groupBy(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(batch)]).agg(F.max(F.size(ids)).alias("_longest"))
        same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(batch)]
        joined = rows.join(longest, same).drop(*[f"_b{i}" for i in range(len(batch))])
    gap = F.col("_longest") - F.size(ids)
    tail = F.array(*[F.lit(p).cast("bigint") for p in prefix or []]).cast("array<bigint>")
    padded = F.concat(F.array_repeat(F.lit(pad_id).cast("bigint"), gap), F.col(ids).cast("array<bigint>"), tail)
    mask = F.concat(F.array_repeat(F.lit(0), gap), F.array_repeat(F.lit(1), F.size(ids) + len(prefix or [])))
    return joined.withColumn("padded", padded).withColumn("mask", mask).drop("_longest")


def position_ids(tokens: DataFrame, sample: str = "sample_id", pos: str = "pos", attn: str = "attn") -> DataFrame:
    """Running sum of the mask less one; masked places get 1."""
    w = Window.partitionBy(sample).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.withColumn("position_id", F.when(F.col(attn) == 0, 1).otherwise(F.sum(attn).over(w) - 1).cast("long"))
