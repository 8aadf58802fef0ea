"""Tensor re-layout as index arithmetic; a latent is an array in (c, y, x) order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.ordering import global_index, running_before
from tokenloom.operators.prompts import position_ids


def source_index(tok: Column, lane: Column, h: int, w: int, p: int) -> Column:
    """Place in (c, y, x) order of lane ``lane`` of patch ``tok``: patches row by row, lanes by channel, then inside the patch."""
    per_row, inside = w // p, lane % (p * p)
    c, y, x = F.floor(lane / (p * p)), F.floor(tok / per_row) * p + F.floor(inside / p), (tok % per_row) * p + inside % p
    return (c * (h * w) + y * w + x).cast("int")


def patchify(rows: DataFrame, data: str, c: int, h: int, w: int, p: int) -> DataFrame:
    """One row per patch: tok and vec (c * p * p lanes)."""
    tokens = rows.withColumn("tok", F.explode(F.sequence(F.lit(0), F.lit((h // p) * (w // p) - 1))))
    vec = F.transform(F.sequence(F.lit(0), F.lit(c * p * p - 1)), lambda k: F.get(F.col(data), source_index(F.col("tok"), k, h, w, p)))
    return tokens.withColumn("vec", vec).drop(data)


def patch_lanes(patches: DataFrame) -> DataFrame:
    """Long form of patches: one row per lane."""
    return patches.select(*[c for c in patches.columns if c != "vec"], F.posexplode("vec").alias("lane", "v"))


def unpatchify(lanes: DataFrame, by: str, h: int, w: int, p: int) -> DataFrame:
    """Inverse, in long form: (by, i, v) with i the place in (c, y, x) order; h and w are those of the image."""
    return lanes.select(by, source_index(F.col("tok"), F.col("lane"), h, w, p).alias("i"), "v")


def pack(cells: DataFrame, by: str, i: str = "i", v: str = "v") -> DataFrame:
    """Arrays from long form (as many entries as the tensor has)."""
    return cells.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(i, v))), lambda x: x[v]).alias("data"))


def channel_patches(patches: DataFrame) -> DataFrame:
    """Channels-first form of the same patches: lane is the channel, tok the place."""
    return patch_lanes(patches).select(*[c for c in patches.columns if c not in ("vec", "tok")], F.col("lane").alias("channel"), F.col("tok").alias("place"), "v")


def embedding_lookup(tokens: DataFrame, table: DataFrame, token: str = "token_id", key: str = "token_id") -> DataFrame:
    """Inner equi-join; Spark broadcasts the table only if it knows it to be small."""
    return tokens.join(table, tokens[token] == table[key]).drop(table[key])


def masked_scatter(tokens: DataFrame, patches: DataFrame, *, placeholder: Column, token_order: list, patch_order: list) -> DataFrame:
    """Give the k-th placeholder position of the whole batch the k-th patch.

    The numbers of placeholders and patches must agree: ``assert_scatter`` tells.
    """
    slots = global_index(tokens.where(placeholder), token_order, "slot")
    values = global_index(patches, patch_order, "slot")
    return slots.join(values, "slot")


def assert_scatter(tokens: DataFrame, patches: DataFrame, placeholder: Column) -> None:
    a, b = tokens.where(placeholder).count(), patches.count()
    if a != b:
        raise ValueError(f"{a} placeholder positions, {b} patches")


def noise_row(i: Column, repeat: int) -> Column:
    """Which of ``repeat`` noise draws row i uses."""
    return F.pmod(i, F.lit(repeat))


def hash_uniform(seed: int, *keys: Column) -> Column:
    """Uniform in (0, 1) from a digest of the keys: the same in every partitioning and engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def hash_normal(seed: int, *keys: Column) -> Column:
    """Standard normal by Box and Muller from two digests."""
    u, v = hash_uniform(seed, F.lit("u"), *keys), hash_uniform(seed, F.lit("v"), *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(6.283185307179586 * v)


def ragged_offsets(rows: DataFrame, length: str, order: list) -> DataFrame:
    """offset: where each row's tokens begin when all are laid end to end."""
    return running_before(rows, F.col(length), order, "offset")


def last_position(tokens: DataFrame, sample: str, pos: str, value: str) -> DataFrame:
    return tokens.groupBy(sample).agg(F.max(pos).alias(pos), F.max_by(value, pos).alias(value))


def generation_inputs(tokens: DataFrame, cache_position: int) -> DataFrame:
    """Positions still to be computed, with position ids counted over the mask."""
    return position_ids(tokens).where(F.col("pos") >= cache_position)


def generation_step(tokens: DataFrame, cache: DataFrame, static_len: int | None = None) -> DataFrame:
    """What a step of cached generation feeds to the model, for each sample.

    tokens: sample_id, pos (from 0, without gaps), token_id, attn.  cache, a row a sample: first and n (the step fills
    places first to first + n - 1 of the cache) and embeds (vectors of the prompt were given).  Out come sample_id,
    step (0 to n - 1), pos, token_id (null where the vectors are the input), source ("ids" or "embeds") and
    position_id.  The ids at the step's places are taken; the last n if vectors were given or the step goes
    past the tokens; all if there are just n.  Vectors are the input only in a step from place 0.  Position ids count the mask
    and are those of the last n positions; masked ones get 1.  With ``static_len``, mask says for each place of a cache of
    fixed size whether the step's query sees it: none later than its own, none masked.
    """
    sample = Window.partitionBy("sample_id")
    placed = position_ids(tokens).withColumn("length", F.count("*").over(sample))
    rows = placed.join(cache.select("sample_id", "first", "n", "embeds"), "sample_id")
    last = F.col("embeds") | (F.col("first") + F.col("n") > F.col("length")) | (F.col("length") == F.col("n"))
    rows = rows.withColumn("tail", F.col("pos") - F.greatest(F.col("length") - F.col("n"), F.lit(0)))
    rows = rows.withColumn("step", F.when(last, F.col("tail")).otherwise(F.col("pos") - F.col("first")))
    by_vector = F.col("embeds") & (F.col("first") == 0)
    taken = rows.where((F.col("step") >= 0) & (F.col("step") < F.col("n"))).select(
        "sample_id", "step", "pos", F.when(~by_vector, F.col("token_id")).alias("token_id"), F.when(by_vector, "embeds").otherwise("ids").alias("source"), (F.col("first") + F.col("step")).alias("_place")
    )
    positions = rows.where("tail >= 0").select("sample_id", F.col("tail").alias("step"), "position_id")
    out = taken.join(positions, ["sample_id", "step"])
    if static_len is not None:
        keys = tokens.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "attn"))), lambda x: x["attn"]).alias("_attn"))
        out = out.join(keys, "sample_id")
        seen = lambda k: (k <= F.col("_place")) & F.coalesce(F.get("_attn", k) == 1, F.lit(True))
        out = out.withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(static_len - 1)), lambda k: seen(k).cast("int"))).drop("_attn")
    return out.drop("_place")


def running_index(rows: DataFrame, by: list[str], order: list, out: str) -> DataFrame:
    """0-based index inside small groups."""
    return rows.withColumn(out, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
