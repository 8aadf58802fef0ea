"""Registered queries of the token-sequence operators, each with SQL for an independent engine.

Every query runs over its whole tables.  Numbers are rounded to six places, integers are 64-bit.
Embeddings stand in for 4 x 4 x 4 latents, logits, gradients and image tokens (64 wide).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import positions, text, vectors
from tokenloom.functions.ordering import global_index
from tokenloom.operators import attention, collectives, images, layout, losses, params, partition, prompts, sampler
from tokenloom.plans import generation
from tokenloom.sources import files
from tokenloom.streaming.once import once, retry_wait

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def r6(x: Column) -> Column:
    return F.round(x, 6)


def q6(x: str) -> str:
    """The same in SQL, without a negative zero."""
    return f"coalesce(nullif(round({x}, 6), 0), CASE WHEN ({x}) IS NOT NULL THEN 0.0 END)"


def query(sql: str | None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            wide = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
            return df.select(*[F.col(c).cast(wide[k]).alias(c) if k in wide else F.col(c) for c, k in df.dtypes])

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.doubles(F.col("embedding")).alias("v"))


CELLS = "cells AS (SELECT vec_id, label, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i))"

# ---------------------------------------------------------------- re-layout


@query(f"""
WITH {CELLS}
SELECT vec_id, (i % 16) // 4 // 2 * 2 + i % 4 // 2 AS tok, i // 16 * 4 + (i % 16) // 4 % 2 * 2 + i % 4 % 2 AS lane, {q6('v')} AS v FROM cells""")
def patchify_embeddings(spark, sf):
    return layout.patch_lanes(layout.patchify(latents(spark, sf).select("vec_id", "v"), "v", 4, 4, 4, 2)).select("vec_id", "tok", "lane", r6(F.col("v")).alias("v"))


@query(f"WITH {CELLS} SELECT vec_id, i, {q6('v')} AS v FROM cells")
def unpatchify_roundtrip(spark, sf):
    lanes = layout.patch_lanes(layout.patchify(latents(spark, sf).select("vec_id", "v"), "v", 4, 4, 4, 2))
    packed = layout.pack(layout.unpatchify(lanes, "vec_id", 4, 4, 2), "vec_id")
    return packed.select("vec_id", F.posexplode("data").alias("i", "v")).select("vec_id", "i", r6(F.col("v")).alias("v"))


@query(f"""
WITH {CELLS}
SELECT vec_id, i // 16 * 4 + (i % 16) // 4 % 2 * 2 + i % 4 % 2 AS channel, (i % 16) // 4 // 2 * 2 + i % 4 // 2 AS place, {q6('v')} AS v FROM cells""")
def vae_patch_transpose(spark, sf):
    patches = layout.patchify(latents(spark, sf).select("vec_id", "v"), "v", 4, 4, 4, 2)
    return layout.channel_patches(patches).select("vec_id", "channel", "place", r6(F.col("v")).alias("v"))


# ---------------------------------------------------------------- element-wise and norms


def _entries(df: DataFrame, v: Column) -> DataFrame:
    return df.select("vec_id", F.posexplode(v).alias("i", "y")).select("vec_id", "i", r6(F.col("y")).alias("y"))


@query(f"""
WITH {CELLS}, m AS (SELECT vec_id, avg(v) AS mean, var_pop(v) AS var FROM cells GROUP BY vec_id)
SELECT vec_id, i, {q6('(v - mean) / sqrt(var + 1e-6)')} AS y FROM cells JOIN m USING (vec_id)""")
def token_layer_norm(spark, sf):
    return _entries(latents(spark, sf), vectors.layer_norm(F.col("v")))


@query(f"""
WITH {CELLS}, m AS (SELECT vec_id, i % 16 AS p, avg(v) AS mean, var_pop(v) AS var FROM cells GROUP BY ALL)
SELECT c.vec_id, i, {q6('(v - mean) / sqrt(var + 1e-6)')} AS y FROM cells c JOIN m ON m.vec_id = c.vec_id AND p = i % 16""")
def channel_layer_norm_2d(spark, sf):
    pixels = latents(spark, sf).select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.get("v", c * 16 + p)))).alias("p", "column"))
    normed = pixels.select("vec_id", "p", F.posexplode(vectors.layer_norm(F.col("column"))).alias("c", "y"))
    return normed.select("vec_id", (F.col("c") * 16 + F.col("p")).alias("i"), r6(F.col("y")).alias("y"))


@query(f"""
WITH {CELLS}, m AS (SELECT vec_id, avg(v * v) AS ms FROM cells GROUP BY vec_id)
SELECT vec_id, i, {q6('v / sqrt(ms + 1e-6) * (1 + i / 64.0)')} AS y FROM cells JOIN m USING (vec_id)""")
def rms_norm(spark, sf):
    weight = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 1 + i / 64.0)
    return _entries(latents(spark, sf), vectors.rms_norm(F.col("v"), weight))


@query(f"""
WITH {CELLS}
SELECT vec_id, i, {q6('v / (1 + exp(-v)) * (1 + (i % 7) / 7.0) + CASE WHEN label % 2 = 0 THEN 0 ELSE (i % 5) / 5.0 END')} AS y FROM cells""")
def silu_modulate(spark, sf):
    idx = F.sequence(F.lit(0), F.lit(63))
    shift = F.when(F.col("label") % 2 != 0, F.transform(idx, lambda i: (i % 5) / 5.0))
    return _entries(latents(spark, sf), vectors.modulate(F.transform("v", vectors.silu), shift, F.transform(idx, lambda i: (i % 7) / 7.0)))


@query(f"""
WITH c AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v, CAST(embedding[(i + 32) % 64 + 1] AS DOUBLE) AS o, vec_id % 32 * power(10000.0, -2.0 * (i % 32) / 64) AS angle FROM embeddings, range(64) t(i))
SELECT vec_id, i, {q6('v * cos(angle) + (CASE WHEN i < 32 THEN -o ELSE o END) * sin(angle)')} AS y FROM c""")
def rotary_apply(spark, sf):
    return _entries(latents(spark, sf), positions.apply_rotary(F.col("v"), F.col("vec_id") % 32))


@query(f"WITH {CELLS} SELECT vec_id, (i + 32) % 64 AS i, {q6('CASE WHEN i < 32 THEN v ELSE -v END')} AS y FROM cells")
def rotate_half(spark, sf):
    return _entries(latents(spark, sf), vectors.rotate_half(F.col("v")))


@query(f"""
SELECT event_id, k, {q6('CASE WHEN k = 6 THEN 0.0 WHEN k < 3 THEN cos(value * exp(-ln(10000.0) * k / 3)) ELSE sin(value * exp(-ln(10000.0) * (k - 3) / 3)) END')} AS y
FROM events, range(7) t(k)""")
def timestep_embedding(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.posexplode(positions.timestep_embedding(F.col("value"), 7)).alias("k", "y"))
    return rows.select("event_id", "k", r6(F.col("y")).alias("y"))


_SINCOS = "CASE WHEN {k} < {half} THEN sin({pos} * power(10000.0, -({k} % {half}) / {half}.0)) ELSE cos({pos} * power(10000.0, -({k} % {half}) / {half}.0)) END"


@query(f"SELECT pos, k, {q6(_SINCOS.format(k='k', half=8, pos='pos'))} AS value FROM range(256) p(pos), range(16) t(k)")
def sincos_pos_1d(spark, sf):
    return positions.sincos_1d(spark.range(256).withColumnRenamed("id", "pos"), "pos", 16).select("pos", "k", r6(F.col("value")).alias("value"))


@query(f"""
SELECT CAST(pos + 1 AS BIGINT) AS pos, k, {q6('CASE WHEN k < 8 THEN ' + _SINCOS.format(k='k', half=4, pos='(pos % 32)') + ' ELSE ' + _SINCOS.format(k='(k - 8)', half=4, pos='(pos // 32)') + ' END')} AS value
FROM range(1024) p(pos), range(16) t(k) UNION ALL SELECT 0, k, 0.0 FROM range(16) t(k)""")
def sincos_pos_2d(spark, sf):
    return positions.sincos_2d(spark, 16, 32, extra_tokens=1).select("pos", "k", r6(F.col("value")).alias("value"))


@query(f"""
WITH {CELLS}, pos AS (SELECT p, k, {_SINCOS.format(k='k', half=32, pos='p')} AS e FROM range(64) a(p), range(64) b(k))
SELECT vec_id, i, {q6('v + e')} AS y FROM cells JOIN pos ON p = vec_id % 64 AND k = i""")
def generation_position(spark, sf):
    """Each step's token plus its row of the position table (64 rows, joined)."""
    cells = latents(spark, sf).select("vec_id", F.posexplode("v").alias("i", "v")).withColumn("p", F.col("vec_id") % 64)
    rows = positions.sincos_1d(spark.range(64).withColumnRenamed("id", "p"), "p", 64).withColumnRenamed("k", "i")
    return cells.join(rows, ["p", "i"]).select("vec_id", "i", r6(F.col("v") + F.col("value")).alias("y"))


# ---------------------------------------------------------------- partitioners and collectives

_ORDERED = "i AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)"


@query("""
WITH s AS (SELECT o_orderkey AS id, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders)
SELECT id, rank, row_number() OVER (PARTITION BY rank ORDER BY id) - 1 AS slot FROM s""")
def shard_no_pad(spark, sf):
    return partition.no_pad(table(spark, sf, "orders"), "o_orderkey", 7)


@query("""
WITH s AS (SELECT o_orderkey AS id, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS shard FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY id) - 1 AS slot FROM s)
SELECT id, (shard - turn + 7) % 7 AS rank, turn, slot FROM p, range(3) t(turn)""")
def shard_repeat(spark, sf):
    return partition.repeat_no_pad(table(spark, sf, "orders"), "o_orderkey", 7, 3)


@query("""
WITH s AS (SELECT s_suppkey AS id, ntile(3) OVER (ORDER BY s_suppkey) - 1 AS shard FROM supplier)
SELECT (shard - turn + 3) % 3 AS rank, count(*) AS n FROM s, range(2) t(turn) GROUP BY 1""")
def shard_repeat_lengths(spark, sf):
    return partition.repeat_lengths(table(spark, sf, "supplier"), "s_suppkey", 3, 2)


_SHUFFLED = "SELECT {id} AS id, row_number() OVER (ORDER BY md5('{seed}:' || {id}), {id}) - 1 AS i, count(*) OVER () AS n FROM {t}"


@query(f"""
WITH i AS ({_SHUFFLED.format(id='o_orderkey', seed=3, t='orders')}), r AS (SELECT CAST(ceil(n / 8.0) AS BIGINT) * 8 AS total, * FROM i)
SELECT id, p % 8 AS rank, p // 8 AS slot FROM (SELECT id, i + k * n AS p, total FROM r, range(2) t(k)) WHERE p < total""")
def shard_round_robin(spark, sf):
    return partition.round_robin(table(spark, sf, "orders"), "o_orderkey", 8, seed=1, epoch=2)


@query("""
WITH i AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier)
SELECT id, p % 7 AS rank, p // 7 AS slot FROM (SELECT id, i + k * n AS p, CAST(ceil(n / 7.0) AS BIGINT) * 7 AS total FROM i, range(4) t(k)) WHERE p < total""")
def shard_padded(spark, sf):
    return partition.round_robin(table(spark, sf, "supplier"), "s_suppkey", 7, shuffle=False)


@query(f"""
WITH i AS ({_SHUFFLED.format(id='o_orderkey', seed=0, t='orders')})
SELECT id, i % 7 AS rank, i // 7 AS slot FROM i WHERE i < n // 7 * 7""")
def shard_drop_last(spark, sf):
    return partition.round_robin(table(spark, sf, "orders"), "o_orderkey", 7, drop_last=True)


@query(f"""
WITH i AS ({_SHUFFLED.format(id='o_orderkey', seed=0, t='orders')})
SELECT i % 7 AS rank, count(*) AS n FROM i WHERE i < n // 7 * 7 AND i // 7 >= 100 GROUP BY 1""")
def shard_resume(spark, sf):
    return partition.round_robin_lengths(table(spark, sf, "orders"), "o_orderkey", 7, drop_last=True, skip=100)


@query(f"""
SELECT l_returnflag AS metric, {q6('sum(l_quantity)')} AS total, {q6('sum(l_quantity) / 7')} AS mean FROM lineitem GROUP BY 1""")
def all_reduce_sum_mean(spark, sf):
    """Values of 7 ranks (rows by supplier), reduced."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("metric"), "l_quantity")
    return collectives.all_reduce_both(rows, F.col("l_quantity"), 7, ["metric"]).select("metric", r6(F.col("total")).alias("total"), r6(F.col("mean")).alias("mean"))


_RANKED = "SELECT event_type, user_id % 8 AS rank, round(sum(value), 6) AS value FROM events GROUP BY ALL"


@query(f"""
WITH r AS ({_RANKED}) SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY rank) - 1 AS place, {q6('value')} AS value FROM r""")
def all_gather(spark, sf):
    rows = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 8).alias("rank")).agg(r6(F.sum("value")).alias("value"))
    return collectives.all_gather(rows, "rank", "value", ["event_type"]).select("event_type", F.posexplode("values").alias("place", "value"))


@query(f"SELECT event_type AS key, {q6('sum(value) / 8')} AS mean FROM (SELECT event_type, user_id % 8 AS rank, sum(value) AS value FROM events GROUP BY ALL) GROUP BY 1")
def mean_dict(spark, sf):
    rows = table(spark, sf, "events").groupBy((F.col("user_id") % 8).alias("rank"), "event_type").agg(F.sum("value").alias("value"))
    dicts = rows.groupBy("rank").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "value"))).alias("metrics"))
    return collectives.mean_dict(dicts, "metrics", 8).select("key", r6(F.col("mean")).alias("mean"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, (SELECT n_name FROM nation WHERE n_nationkey = 0) AS received FROM nation")
def broadcast_object(spark, sf):
    return collectives.broadcast_object(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name").select("n_nationkey", "received")


# ---------------------------------------------------------------- text and prompts

_RATIOS = "(VALUES " + ", ".join(f"({h}, {w})" for h, w in prompts.ASPECT_RATIOS) + ") a(h, w)"


@query(f"SELECT h || '*' || w AS s, CAST(h AS BIGINT) AS h, CAST(w AS BIGINT) AS w FROM {_RATIOS}")
def hw_codec(spark, sf):
    rows = prompts.aspect_ratios(spark).select(text.hw_to_string(F.col("h"), F.col("w")).alias("s"))
    hw = text.string_to_hw(F.col("s"))
    return rows.select("s", F.get(hw, F.lit(0)).alias("h"), F.get(hw, F.lit(1)).alias("w"))


@query(f"SELECT CAST(round_even(avg(round_even(sqrt(h * w), 0)), 0) AS BIGINT) AS hw_base FROM {_RATIOS}")
def aspect_base(spark, sf):
    return prompts.hw_base(prompts.aspect_ratios(spark))


@query("SELECT CAST(o AS BIGINT) AS ord, role, token FROM (VALUES " + ", ".join(f"({i}, '{r}', '{t}')" for i, (r, t) in enumerate(prompts.SPECIAL_TOKENS)) + ") v(o, role, token)")
def special_tokens(spark, sf):
    return prompts.special_tokens(spark)


_CAPTIONS = "c AS (SELECT doc_id AS sample_id, CASE WHEN doc_id % 5 = 0 THEN text WHEN doc_id % 7 = 0 THEN '<image> and <image> ' || text ELSE source || ' <image> ' || text END AS caption FROM documents)"


def _captions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    caption = F.when(F.col("doc_id") % 5 == 0, F.col("text")).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("<image> and <image> "), "text")).otherwise(F.concat("source", F.lit(" <image> "), "text"))
    return docs.select(F.col("doc_id").alias("sample_id"), caption.alias("caption"))


@query(f"WITH {_CAPTIONS} SELECT * FROM (SELECT sample_id, (length(caption) - length(replace(caption, '<image>', ''))) // 7 AS markers FROM c) WHERE markers <> 1")
def image_token_validate(spark, sf):
    return prompts.marker_violations(_captions(spark, sf)).select("sample_id", "markers")


_IMAGE = "'<|image_area|>' || ({h} // 16) || '*' || ({w} // 16) || '<|begin_of_image|>' || repeat('<|image_placeholder|>', CAST(({h} // 16) * ({w} // 16) AS BIGINT)) || '<|end_of_image|>'"


@query(f"""
WITH {_CAPTIONS}, n AS (SELECT *, (length(caption) - length(replace(caption, '<image>', ''))) // 7 AS m FROM c),
f AS (SELECT *, sum(m) OVER (ORDER BY sample_id) - m AS first FROM n),
p AS (SELECT sample_id, first, unnest(string_split(caption, '<image>')) AS part, generate_subscripts(string_split(caption, '<image>'), 1) - 1 AS k FROM f),
g AS (SELECT sample_id, k, part, CASE WHEN k = 0 THEN '' ELSE {_IMAGE.format(h='(16 * (1 + (first + k - 1) % 3))', w='(16 * (1 + (first + k - 1) % 2))')} END AS image FROM p)
SELECT sample_id, md5(string_agg(image || part, '' ORDER BY k)) AS caption_md5 FROM g GROUP BY 1""")
def image_token_substitute(spark, sf):
    captions = _captions(spark, sf)
    total = captions.agg(F.sum(prompts.marker_count(F.col("caption"))))
    idx = total.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(total.columns[0]))).alias("image_idx"))
    sizes = idx.select("image_idx", (16 * (1 + F.col("image_idx") % 3)).alias("h"), (16 * (1 + F.col("image_idx") % 2)).alias("w"))
    got = prompts.substitute_images(captions, sizes)
    return got.select("sample_id", F.md5(F.col("caption").cast("binary")).alias("caption_md5"))


@query(f"""
WITH c AS (SELECT conv_id * 100 + turn AS sample_id, text || ' in detail' AS caption FROM conversations)
SELECT sample_id, rep, CAST(b AS BIGINT) AS branch, md5(CASE b WHEN 0 THEN caption WHEN 1 THEN {_IMAGE.format(h=32, w=48)} || 'blurry' ELSE 'blurry' END) AS caption_md5
FROM c, range(2) r(rep), range(3) t(b)""")
def caption_repeat_branches(spark, sf):
    conv = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"), prompts.with_positive(F.col("text"), "in detail").alias("caption"), F.lit(32).alias("h"), F.lit(48).alias("w"))
    got = prompts.guidance_captions(prompts.repeat_captions(conv, 2), cfg=7.5, cfg_img=2.0, negative="blurry")
    return got.select("sample_id", "rep", "branch", F.md5(F.col("caption").cast("binary")).alias("caption_md5"))


_WORDS = "w AS (SELECT conv_id * 100 + turn AS sample_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ids FROM conversations)"


@query(f"""
WITH {_WORDS}, m AS (SELECT max(len(ids)) AS longest FROM w)
SELECT sample_id, pos, CASE WHEN pos < longest - len(ids) THEN 0 WHEN pos < longest THEN length(ids[pos - longest + len(ids) + 1]) ELSE pos - longest + 1000 END AS id,
  CASE WHEN pos < longest - len(ids) THEN 0 ELSE 1 END::BIGINT AS mask
FROM w, m, range(longest + 2) t(pos)""")
def left_pad_tokens(spark, sf):
    """Word lengths as stand-in ids, with two prefix ids on the right."""
    conv = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"), F.transform(prompts.words(F.col("text")), lambda w: F.length(w).cast("bigint")).alias("ids"))
    got = prompts.left_pad(conv, "ids", 0, [1000, 1001])
    return got.select("sample_id", F.posexplode(F.arrays_zip("padded", "mask")).alias("pos", "x")).select("sample_id", "pos", F.col("x.padded").alias("id"), F.col("x.mask").alias("mask"))


_PARENS = "p AS (SELECT doc_id, '(' || source || repeat('(', doc_id % 3) || lang || repeat(')', doc_id % 4) || 'x)' AS s FROM documents)"


@query(f"""
WITH {_PARENS}, c AS (SELECT doc_id, i, substr(s, i + 1, 1) AS ch FROM p, range(40) t(i) WHERE i < length(s)),
d AS (SELECT *, sum(CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM c)
SELECT doc_id, s, min(i) FILTER (depth = 0 AND ch = ')') AS closing FROM p LEFT JOIN d USING (doc_id) GROUP BY ALL""")
def matching_parenthesis(spark, sf):
    n = F.col("doc_id").cast("int")
    s = F.concat(F.lit("("), "source", F.repeat(F.lit("("), n % 3), "lang", F.repeat(F.lit(")"), n % 4), F.lit("x)"))
    return table(spark, sf, "documents").select("doc_id", s.alias("s")).withColumn("closing", text.matching_parenthesis(F.col("s"), F.lit(0)))


@query("SELECT event_id, 'event_type: ' || event_type || chr(10) || 'user_id: ' || user_id AS shown FROM events")
def pretty_format(spark, sf):
    m = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", text.pretty_map(m).alias("shown"))


_FORMAT = "CASE WHEN abs({v}) < 1000 THEN CAST({v} AS VARCHAR) WHEN abs({v}) < 1000000 THEN printf('%.1fK', {v} / 1e3) WHEN abs({v}) < 1000000000 THEN printf('%.1fM', {v} / 1e6) WHEN abs({v}) < 1000000000000 THEN printf('%.1fB', {v} / 1e9) WHEN abs({v}) < 1000000000000000 THEN printf('%.1fT', {v} / 1e12) ELSE printf('%.1fP', {v} / 1e15) END"


@query(f"WITH c AS (SELECT c_custkey, CAST(CAST(trunc(c_acctbal) AS BIGINT) * power(10, c_custkey % 13) AS BIGINT) + 7 AS v FROM customer) SELECT c_custkey, v, {_FORMAT.format(v='v')} AS shown FROM c")
def large_int_format(spark, sf):
    v = (F.col("c_acctbal").cast("bigint") * F.pow(F.lit(10.0), F.col("c_custkey") % 13)).cast("bigint") + 7
    return table(spark, sf, "customer").select("c_custkey", v.alias("v")).withColumn("shown", text.format_large_int(F.col("v")))


@query("""
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN '' || o_orderkey ELSE (o_orderkey % 1000) || '.' || (o_orderkey % 10) || substr('kMbT', CAST(o_orderkey % 5 AS INT) + 1, 1) END AS s FROM orders)
SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 4 THEN CAST(s AS DOUBLE) ELSE trunc(CAST(substr(s, 1, length(s) - 1) AS DOUBLE) * CASE o_orderkey % 5 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 WHEN 2 THEN 1e9 ELSE 1e12 END) END AS BIGINT) AS v FROM c""")
def large_int_parse(spark, sf):
    k = F.col("o_orderkey")
    s = F.when(k % 5 == 4, k.cast("string")).otherwise(F.concat((k % 1000).cast("string"), F.lit("."), (k % 10).cast("string"), F.substring(F.lit("kMbT"), (k % 5).cast("int") + 1, F.lit(1))))
    return table(spark, sf, "orders").select(k, text.parse_large_int(s).alias("v"))


_SEED = "((((({a} % 2147483648) * 31 + {b}) % 2147483648) * 31 + {c}) % 2147483648)"


@query(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {_SEED.format(a='l_orderkey', b='l_partkey', c='l_linenumber')} AS seed FROM lineitem")
def make_seed(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.make_seed(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber").cast("bigint")).alias("seed"))


@query("""
WITH p AS (SELECT p_partkey, (p_size % 3) || '.' || (p_partkey % 13) || CASE WHEN p_partkey % 2 = 0 THEN '.0' ELSE '.' || (p_size % 4) END AS v FROM part),
x AS (SELECT *, CAST(split_part(v, '.', 1) AS INT) AS a, CAST(split_part(v, '.', 2) AS INT) AS b, CAST(split_part(v, '.', 3) AS INT) AS c FROM p)
SELECT p_partkey, v, (a, b, c) < (1, 10, 0) AS lt, (a, b, c) <= (1, 10, 0) AS le, (a, b, c) = (1, 10, 0) AS eq, (a, b, c) <> (1, 10, 0) AS ne, (a, b, c) >= (1, 10, 0) AS ge, (a, b, c) > (1, 10, 0) AS gt FROM x""")
def version_compare(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    v = F.concat((s % 3).cast("string"), F.lit("."), (k % 13).cast("string"), F.when(k % 2 == 0, ".0").otherwise(F.concat(F.lit("."), (s % 4).cast("string"))))
    rows = table(spark, sf, "part").select(k, v.alias("v"))
    return rows.select("*", *[text.compare_versions(F.col("v"), o, F.lit("1.10")).alias(n) for n, o in (("lt", "<"), ("le", "<="), ("eq", "=="), ("ne", "!="), ("ge", ">="), ("gt", ">"))])


# ---------------------------------------------------------------- tokens, joins, masks


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as tokens of a conversation; some are masked."""
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("pos"), F.length("text").alias("token_id"), (F.length("text") % 4 != 0).cast("int").alias("attn"))


_TOKENS = "t AS (SELECT conv_id AS sample_id, turn AS pos, length(text) AS token_id, CASE WHEN length(text) % 4 <> 0 THEN 1 ELSE 0 END AS attn FROM conversations)"


@query(f"WITH {_TOKENS} SELECT sample_id, pos, CAST(CASE WHEN attn = 0 THEN 1 ELSE sum(attn) OVER (PARTITION BY sample_id ORDER BY pos) - 1 END AS BIGINT) AS position_id FROM t")
def position_ids(spark, sf):
    return prompts.position_ids(_tokens(spark, sf)).select("sample_id", "pos", "position_id")


@query(f"WITH {_TOKENS}, p AS (SELECT sample_id, pos, CAST(CASE WHEN attn = 0 THEN 1 ELSE sum(attn) OVER (PARTITION BY sample_id ORDER BY pos) - 1 END AS BIGINT) AS position_id FROM t) SELECT * FROM p WHERE pos >= 2")
def generation_inputs(spark, sf):
    return layout.generation_inputs(_tokens(spark, sf), 2).select("sample_id", "pos", "position_id")


@query(f"WITH {_TOKENS} SELECT a.sample_id, a.pos, CAST(coalesce(sum(b.attn), 0) AS BIGINT) AS n_visible FROM t a JOIN t b ON a.sample_id = b.sample_id AND b.pos <= a.pos GROUP BY ALL")
def causal_visibility(spark, sf):
    return attention.visible_counts(_tokens(spark, sf), "sample_id", "pos", "attn").select("sample_id", "pos", "n_visible")


@query(f"WITH {_TOKENS} SELECT a.sample_id, a.pos FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.sample_id = a.sample_id AND b.pos <= a.pos AND b.attn = 1)")
def fully_masked_rows(spark, sf):
    return attention.fully_masked(_tokens(spark, sf), "sample_id", "pos", "attn").select("sample_id", "pos")


@query(f"WITH {_TOKENS} SELECT sample_id, CASE WHEN min(attn) = 0 THEN 'padding' ELSE 'none' END AS flash, CASE WHEN min(attn) = 0 THEN 'full' ELSE 'none' END AS sdpa, 'full' AS eager FROM t GROUP BY 1")
def mask_form(spark, sf):
    return _tokens(spark, sf).groupBy("sample_id").agg(*[attention.mask_form_of("attn", k).alias(k) for k in ("flash", "sdpa", "eager")])


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def embedding_lookup(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("token_id"))
    vectors_ = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_name")
    return layout.embedding_lookup(rows, vectors_, "token_id", "key").select("l_orderkey", "l_linenumber", "p_name")


@query("""
WITH s AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS slot FROM conversations WHERE role = 'user'),
v AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS slot FROM documents)
SELECT conv_id, turn, slot, doc_id FROM s JOIN v USING (slot)""")
def masked_scatter(spark, sf):
    """The k-th user turn gets the k-th document."""
    conv, docs = table(spark, sf, "conversations").select("conv_id", "turn", "role"), table(spark, sf, "documents").select("doc_id")
    got = layout.masked_scatter(conv, docs, placeholder=F.col("role") == "user", token_order=["conv_id", "turn"], patch_order=["doc_id"])
    return got.select("conv_id", "turn", "slot", "doc_id")


@query("""
WITH h AS (SELECT vec_id // 4 AS pos, vec_id % 4 AS head, label FROM embeddings)
SELECT q.pos, q.head, k.head AS kv_head, CAST(q.label AS BIGINT) AS q, CAST(k.label AS BIGINT) AS k FROM h q JOIN h k ON q.pos = k.pos AND k.head = q.head // 2 AND k.head < 2""")
def gqa_repeat_kv(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("pos"), (F.col("vec_id") % 4).alias("head"), "label")
    kv = rows.where("head < 2").withColumnRenamed("label", "k")
    return attention.grouped_heads(rows.withColumnRenamed("label", "q"), kv, ["pos"], 2).select("pos", "head", "kv_head", "q", "k")


def _short(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of 16 vectors."""
    return latents(spark, sf).select(F.floor(F.col("vec_id") / 16).alias("sample_id"), (F.col("vec_id") % 16).alias("pos"), "v")


def _attention_sql(causal: str) -> str:
    return f"""
WITH e AS (SELECT vec_id // 16 AS s, vec_id % 16 AS p, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT a.s, a.p, b.v, list_inner_product(a.v, b.v) / 8 AS z FROM e a JOIN e b ON a.s = b.s {causal}),
w AS (SELECT *, exp(z - max(z) OVER (PARTITION BY s, p)) AS u FROM x),
n AS (SELECT s, p, v, u / sum(u) OVER (PARTITION BY s, p) AS u FROM w)
SELECT s AS sample_id, p AS pos, d, {q6('sum(u * v[d + 1])')} AS out FROM n, range(64) t(d) GROUP BY ALL"""


@query(_attention_sql("AND b.p <= a.p"))
def causal_attention(spark, sf):
    return attention.attention(_short(spark, sf), "sample_id", "pos", "v").select("sample_id", "pos", "d", r6(F.col("out")).alias("out"))


@query(_attention_sql(""))
def full_attention(spark, sf):
    got = attention.blocked_attention(_short(spark, sf), "sample_id", "pos", "v", causal=False, block=5)
    return got.select("sample_id", "pos", F.posexplode("out").alias("d", "out")).select("sample_id", "pos", "d", r6(F.col("out")).alias("out"))


_LONG = """
WITH e AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT a.vec_id, b.v, list_inner_product(a.v, b.v) / 8 AS z FROM e a JOIN e b ON a.label = b.label AND b.p <= a.p),
w AS (SELECT vec_id, v, exp(z) AS u FROM x)
SELECT vec_id, {} AS first, {} AS last FROM w GROUP BY 1""".format(q6("sum(u * v[1]) / sum(u)"), q6("sum(u * v[64]) / sum(u)"))


@query(_LONG)
def blocked_causal_attention(spark, sf):
    """Long sequences (all vectors of a label), in Arrow blocks."""
    got = attention.blocked_attention(latents(spark, sf), "label", "vec_id", "v")
    return got.select("vec_id", r6(F.get("out", F.lit(0))).alias("first"), r6(F.get("out", F.lit(63))).alias("last"))


@query(f"WITH {_TOKENS} SELECT sample_id, pos, token_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos DESC) AS r FROM t) WHERE r = 1")
def last_position(spark, sf):
    return layout.last_position(_tokens(spark, sf), "sample_id", "pos", "token_id")


@query("SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT - n_chars AS \"offset\" FROM documents")
def ragged_offsets(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return layout.ragged_offsets(docs, "n_chars", ["doc_id"])


_UNIFORM = "((CAST('0x' || substr(md5('{seed}:{tag}:' || {key}), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


def _normal_sql(seed: int, key: str) -> str:
    return f"sqrt(-2 * ln({_UNIFORM.format(seed=seed, tag='u', key=key)})) * cos(6.283185307179586 * {_UNIFORM.format(seed=seed, tag='v', key=key)})"


@query(f"SELECT o_orderkey, o_orderkey % 16 AS draw, {q6(_normal_sql(42, '(o_orderkey % 16)'))} AS noise FROM orders")
def noise_repeat(spark, sf):
    draw = layout.noise_row(F.col("o_orderkey"), 16)
    return table(spark, sf, "orders").select("o_orderkey", draw.alias("draw"), r6(layout.hash_normal(42, draw)).alias("noise"))


@query("SELECT s_suppkey, rep, row_number() OVER (ORDER BY rep, s_suppkey) - 1 AS block_place, row_number() OVER (ORDER BY s_suppkey, rep) - 1 AS adjacent_place FROM supplier, range(4) t(rep)")
def repeat_orders(spark, sf):
    """Block and adjacent repetition differ only in the sort key; places follow from it in closed form."""
    rows = table(spark, sf, "supplier").select("s_suppkey")
    n = rows.count()
    placed = prompts.block_repeat(global_index(rows, ["s_suppkey"]), 4)
    return placed.select("s_suppkey", "rep", (F.col("rep") * n + F.col("idx")).alias("block_place"), (F.col("idx") * 4 + F.col("rep")).alias("adjacent_place"))


# ---------------------------------------------------------------- losses and parameters


@query(f"WITH {_TOKENS} SELECT * FROM (SELECT sample_id, pos, lead(token_id) OVER (PARTITION BY sample_id ORDER BY pos) AS target FROM t) WHERE target IS NOT NULL")
def next_token_shift(spark, sf):
    return losses.shift_targets(_tokens(spark, sf), "sample_id", "pos", "token_id").select("sample_id", "pos", "target")


@query(f"""
WITH {CELLS}, z AS (SELECT vec_id, label, ln(sum(exp(v))) AS lse, max(v) FILTER (i = label) AS own FROM cells WHERE vec_id % 9 <> 0 GROUP BY ALL)
SELECT CAST(label AS BIGINT) AS label, {q6('avg(lse - own)')} AS loss, count(*) AS n FROM z GROUP BY 1""")
def cross_entropy(spark, sf):
    rows = latents(spark, sf).withColumn("target", F.when(F.col("vec_id") % 9 == 0, prompts.IGNORE_INDEX).otherwise(F.col("label")))
    return losses.cross_entropy(rows, "v", "target", ["label"]).select("label", r6(F.col("loss")).alias("loss"), "n")


@query(f"""
WITH {CELLS}, l AS (SELECT vec_id, avg(power(v - (v * 0.9 + 0.01), 2)) AS loss FROM cells GROUP BY 1),
j AS (SELECT loss, coalesce(quality, 0) AS m FROM l LEFT JOIN labels ON doc_id = vec_id)
SELECT {q6('1e3 * sum(loss * m) / (sum(m) + 1e-8)')} AS masked, {q6('1e3 * avg(loss)')} AS plain FROM j""")
def masked_flow_loss(spark, sf):
    rows = latents(spark, sf).join(table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), "quality"), "vec_id", "left")
    rows = losses.repeat_batch(rows.select(losses.row_mse(F.col("v"), F.transform("v", lambda x: x * 0.9 + 0.01)).alias("l"), F.coalesce("quality", F.lit(0)).alias("m")))
    a = losses.masked_mean(rows, 1e3 * F.col("l"), F.col("m")).withColumnRenamed("loss", "masked")
    b = losses.masked_mean(rows, 1e3 * F.col("l"), None).withColumnRenamed("loss", "plain")
    return a.crossJoin(b).select(r6(F.col("masked")).alias("masked"), r6(F.col("plain")).alias("plain"))  # one row each


@query(f"""
WITH {CELLS}, a AS (SELECT vec_id, i, v, {_UNIFORM.format(seed=1, tag='t', key='vec_id')} AS t, (i - 31.5) / 64 AS n FROM cells)
SELECT vec_id, i, {q6('t * v + (1 - t) * n')} AS x, {q6('v - n')} AS u FROM a""")
def flow_target(spark, sf):
    noise = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i - 31.5) / 64)
    x, u = losses.flow_target(F.col("v"), noise, F.col("t"))
    rows = latents(spark, sf).withColumn("t", layout.hash_uniform(1, F.lit("t"), F.col("vec_id"))).select("vec_id", F.posexplode(F.arrays_zip(x.alias("x"), u.alias("u"))).alias("i", "z"))
    return rows.select("vec_id", "i", r6(F.col("z.x")).alias("x"), r6(F.col("z.u")).alias("u"))


@query(f"SELECT o_orderkey, {q6('o_totalprice * 0.01 + o_orderkey / 7.0')} AS loss FROM orders")
def loss_total_guard(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", r6(losses.total_loss(F.col("o_totalprice"), F.col("o_orderkey") / 7.0)).alias("loss"))


def _params(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as parameters: names with layers, biases and a vision encoder, shapes of rank 1 and 2."""
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.when(k % 4 == 0, "vision_encoder.").otherwise("model."), F.lit("layers."), (k % 32).cast("string"), F.lit("."), F.when(k % 3 == 0, "bias").otherwise("weight"), F.lit("."), k.cast("string"))
    shape = F.when(k % 5 == 0, F.array(s)).otherwise(F.array(s, (k % 7 + 1).cast("int")))
    return table(spark, sf, "part").select(k.alias("ord"), name.alias("name"), shape.alias("shape"), (k % 11 != 0).alias("requires_grad"), F.substring("p_brand", 1, 7).alias("module"), F.array(F.when(k % 6 == 0, "RMSNorm").otherwise("Linear")).alias("module_types"))


_PARAMS = """p AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 4 = 0 THEN 'vision_encoder.' ELSE 'model.' END || 'layers.' || (p_partkey % 32) || '.' || CASE WHEN p_partkey % 3 = 0 THEN 'bias' ELSE 'weight' END || '.' || p_partkey AS name,
 CASE WHEN p_partkey % 5 = 0 THEN p_size ELSE p_size * (p_partkey % 7 + 1) END AS numel, p_partkey % 5 = 0 AS flat, p_partkey % 11 <> 0 AS grad, substr(p_brand, 1, 7) AS module, p_partkey % 6 = 0 AS norm FROM part)"""


@query(f"WITH {_PARAMS} SELECT module, CAST(sum(numel) AS BIGINT) AS trainable FROM p WHERE grad GROUP BY 1")
def params_info(spark, sf):
    return params.params_info(_params(spark, sf), ["module"])


@query(f"""
WITH {_PARAMS}, g AS (SELECT *, NOT (contains(name, 'bias') OR flat) AS is_decayed, CASE WHEN contains(name, 'model.layers') THEN power(0.931, 32 - ord % 32 - 1) ELSE 1.0 END AS s FROM p WHERE grad)
SELECT is_decayed, {q6('s')} AS lr_scale, {q6('s * 0.001')} AS lr, CASE WHEN is_decayed THEN 0.1 ELSE 0.0 END::DOUBLE AS weight_decay, string_agg(name, ',' ORDER BY ord) AS names, CAST(sum(numel) AS BIGINT) AS n FROM g GROUP BY is_decayed, s""")
def param_groups(spark, sf):
    got = params.grouped(_params(spark, sf), 0.001, 0.1, params.layer_scale)
    return got.select("is_decayed", r6(F.col("lr_scale")).alias("lr_scale"), r6(F.col("lr")).alias("lr"), "weight_decay", F.array_join("names", ",").alias("names"), "n")


@query(f"""
WITH {_PARAMS} SELECT CASE WHEN contains(name, 'vision_encoder') THEN 0.1 ELSE 1.0 END::DOUBLE AS lr_scale, CAST(sum(numel) AS BIGINT) AS n FROM p WHERE grad GROUP BY 1""")
def vision_groups(spark, sf):
    got = params.grouped(_params(spark, sf), 1.0, 0.0, params.vision_scale)
    return got.groupBy("lr_scale").agg(F.sum("n").alias("n"))


@query(f"WITH {_PARAMS} SELECT CAST(sum(numel) AS BIGINT) AS n FROM p WHERE grad")
def grouped_parameters_total(spark, sf):
    return params.grouped_numel(params.grouped(_params(spark, sf), 1.0, 0.0))


@query(f"WITH {_PARAMS} SELECT name FROM p WHERE NOT norm AND NOT contains(name, 'bias')")
def decay_names(spark, sf):
    return params.decay_names(_params(spark, sf), ["RMSNorm", "LayerNorm"])


@query(f"""
WITH {CELLS} SELECT CAST(label AS BIGINT) AS label, {q6('power(sum(power(abs(v), 2)), 0.5)')} AS l2, {q6('power(sum(power(abs(v), 3)), 1.0 / 3)')} AS l3 FROM cells GROUP BY 1""")
def grad_norm(spark, sf):
    rows = latents(spark, sf)
    a = params.grad_norm(rows, "v", 2.0, ["label"]).withColumnRenamed("norm", "l2")
    b = params.grad_norm(rows, "v", 3.0, ["label"]).withColumnRenamed("norm", "l3")
    return a.join(b, "label").select("label", r6(F.col("l2")).alias("l2"), r6(F.col("l3")).alias("l3"))


def _states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    k, label = F.col("vec_id"), F.col("label")
    rows = latents(spark, sf)
    first = rows.where(k % 10 != 0).select(k.alias("name"), F.array(F.size("v")).alias("shape"), F.lit("f32").alias("dtype"), F.lit("cpu").alias("device"), F.col("v").alias("data"))
    second = rows.where(k % 11 != 0).select(
        k.alias("name"),
        F.when(k % 13 == 0, F.array(F.lit(32))).otherwise(F.array(F.lit(64))).alias("shape"),
        F.when(label == 3, "bf16").otherwise("f32").alias("dtype"),
        F.when(label == 4, "gpu").otherwise("cpu").alias("device"),
        F.when(k % 13 == 0, F.slice("v", 1, 32)).when(k % 7 == 0, F.transform("v", lambda x: x * 1.001)).otherwise(F.transform("v", lambda x: x + 1e-9)).alias("data"),
    )
    return first, second


@query(f"""
WITH {CELLS}, g AS (SELECT vec_id, label, max(abs(v - w)) AS max_abs, max(abs(v - w) / (abs(w) + 1e-7)) AS max_rel, bool_and(abs(v - w) <= 1e-8 + 1e-5 * abs(w)) AS near
  FROM (SELECT *, CASE WHEN vec_id % 7 = 0 THEN v * 1.001 ELSE v + 1e-9 END AS w FROM cells) GROUP BY ALL)
SELECT vec_id AS name, CASE WHEN vec_id % 11 = 0 THEN 'only_first' WHEN vec_id % 10 = 0 THEN 'only_second' WHEN label = 3 THEN 'type' WHEN vec_id % 13 = 0 THEN 'shape' WHEN label = 4 THEN 'device' WHEN NOT near THEN 'value' ELSE 'same' END AS verdict,
 CASE WHEN vec_id % 11 <> 0 AND vec_id % 10 <> 0 AND vec_id % 13 <> 0 THEN {q6('max_abs')} END AS max_abs, CASE WHEN vec_id % 11 <> 0 AND vec_id % 10 <> 0 AND vec_id % 13 <> 0 THEN {q6('max_rel')} END AS max_rel
FROM g WHERE vec_id % 11 <> 0 OR vec_id % 10 <> 0""")
def state_dict_diff(spark, sf):
    a, b = _states(spark, sf)
    return params.state_diff(a, b).select("name", "verdict", r6(F.col("max_abs")).alias("max_abs"), r6(F.col("max_rel")).alias("max_rel"))


@query("SELECT vec_id AS name, CASE WHEN vec_id % 11 = 0 THEN 'first' ELSE 'second' END AS side FROM embeddings WHERE (vec_id % 10 = 0) <> (vec_id % 11 = 0)")
def state_key_differences(spark, sf):
    return params.key_differences(*_states(spark, sf))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_regionkey > 1 AS attention_bias, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey > 1 ELSE n_nationkey % 3 = 1 END AS o_attention_bias FROM nation")
def config_defaults(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", (F.col("n_regionkey") > 1).alias("attention_bias"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") % 3 == 1).alias("o_attention_bias"))
    return params.attention_bias(rows)


# ---------------------------------------------------------------- sampler

_TIME = "({i} * (0.96 / {n}) / (3.2 - 2.2 * ({i} * (0.96 / {n}))))"


@query(f"SELECT i, {q6(_TIME.format(i='i', n=49))} AS t, CASE WHEN i < 49 THEN {q6(_TIME.format(i='(i + 1)', n=49) + ' - ' + _TIME.format(i='i', n=49))} END AS dt FROM range(50) s(i)")
def timestep_schedule(spark, sf):
    return sampler.timesteps(spark, 50, shift=3.2).select("i", r6(F.col("t")).alias("t"), r6(F.col("dt")).alias("dt"))


@query(f"WITH s AS (SELECT i, CASE WHEN i = 20 THEN 1.0 ELSE (i / 20.0) / (3.2 - 2.2 * (i / 20.0)) END AS t FROM range(21) r(i)) SELECT i, {q6('t')} AS t, {q6('lead(t) OVER (ORDER BY i) - t')} AS dt FROM s")
def timestep_schedule_to_one(spark, sf):
    return sampler.timesteps_to_one(spark, 20, shift=3.2).select("i", r6(F.col("t")).alias("t"), r6(F.col("dt")).alias("dt"))


@query(f"SELECT step, 7.5::DOUBLE AS constant, {q6('1 + 6.5 * (1024 - step) / 1024')} AS linear FROM range(1024) s(step)")
def cfg_schedule(spark, sf):
    s = F.col("id")
    return spark.range(1024).select(s.alias("step"), sampler.guidance_scale(s, 1024, 7.5, "constant").alias("constant"), r6(sampler.guidance_scale(s, 1024, 7.5, "linear")).alias("linear"))


@query(f"""
WITH {CELLS} SELECT vec_id, i, {q6('v * 0.1 + 2.0 * (v * 0.5 - v * 0.1) + 7.5 * (v - v * 0.5)')} AS velocity FROM cells""")
def cfg_combine(spark, sf):
    cells = latents(spark, sf).select("vec_id", F.posexplode("v").alias("i", "v"))
    rows = cells.select("vec_id", "i", F.explode(F.array(*[F.struct(F.lit(b).alias("branch"), (F.col("v") * k).alias("v")) for b, k in enumerate((1.0, 0.5, 0.1))])).alias("x")).select("vec_id", "i", "x.branch", "x.v")
    return sampler.combine_branches(rows, ["vec_id", "i"], "branch", "v", 3, 7.5, 2.0).select("vec_id", "i", r6(F.col("velocity")).alias("velocity"))


_E = "(k * (0.96 / 9))"
_E1 = "((k + 1) * (0.96 / 9))"


@query(f"""
WITH RECURSIVE {CELLS}, e(vec_id, i, k, x) AS (
  SELECT vec_id, i, 0, v FROM cells
  UNION ALL
  SELECT vec_id, i, k + 1, x + ((1 + {_E}) * (0.3 - x) - x) * ({_E1} - {_E}) + sqrt(2 * (1 - {_E})) * {_normal_sql(5, "vec_id || ':' || i || ':' || k")} * sqrt({_E1} - {_E}) FROM e WHERE k < 9
)
SELECT vec_id, CAST(i AS BIGINT) AS i, {q6('x + (0.3 - x) * 0.04')} AS x FROM e WHERE k = 9""")
def euler_sampler(spark, sf):
    """Ten steps towards 0.3 (velocity 0.3 - x), noise from digests."""
    cells = latents(spark, sf).select("vec_id", F.posexplode("v").alias("i", "v"))
    x = sampler.euler(F.col("v"), lambda x, t: 0.3 - x, lambda k: layout.hash_normal(5, F.col("vec_id"), F.col("i"), k), steps=10)
    return cells.select("vec_id", "i", r6(x).alias("x"))


# ---------------------------------------------------------------- images

_UNIT = "CASE label % 3 WHEN 0 THEN v * 300 WHEN 1 THEN v * 1.5 ELSE v * 1.5 END"


@query(f"""
WITH {CELLS}, g AS (SELECT vec_id, min(v) < 0 AS neg FROM cells GROUP BY 1), c AS (SELECT vec_id, i, v * 1.5 AS x, CASE WHEN neg THEN '11' ELSE '01' END AS src FROM cells JOIN g USING (vec_id)),
u AS (SELECT *, CASE WHEN src = '11' THEN x / 2 + 0.5 ELSE x END AS unit FROM c)
SELECT vec_id, i, src, {q6('greatest(least(unit, 1), 0)')} AS as01, {q6('greatest(least(unit * 2 - 1, 1), -1)')} AS as11, CAST(round_even(greatest(least(unit, 1), 0) * 255, 0) AS DOUBLE) AS as255 FROM u""")
def pixel_range_convert(spark, sf):
    rows = latents(spark, sf).select("vec_id", F.transform("v", lambda x: x * 1.5).alias("d")).withColumn("src", images.guess_range(F.col("d"), "float32"))
    cells = rows.select("vec_id", "src", F.posexplode("d").alias("i", "x"))
    out = [images.convert_value(F.col("x"), F.col("src"), t) for t in images.RANGES]
    return cells.select("vec_id", "i", "src", r6(out[1]).alias("as01"), r6(out[2]).alias("as11"), out[0].alias("as255"))


@query(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {q6('(l_partkey % 256) / 255.0 * 2 - 1')} AS y FROM lineitem")
def normalize_pixels(spark, sf):
    y = images.convert_value((F.col("l_partkey") % 256).cast("double"), F.lit("255"), "11")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(y).alias("y"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 4 + 1 AS ch, CAST(p_partkey * 37 % 256 AS DOUBLE) AS r, CAST(p_partkey * 101 % 256 AS DOUBLE) AS g, CAST(p_partkey * 59 % 256 AS DOUBLE) AS b, CAST(p_size * 5 % 256 AS DOUBLE) AS a FROM part),
q AS (SELECT p_partkey, ch, CASE ch WHEN 4 THEN a WHEN 2 THEN g ELSE 255.0 END AS alpha, r, CASE WHEN ch >= 3 THEN g ELSE r END AS g, CASE WHEN ch >= 3 THEN b ELSE r END AS b FROM p)
SELECT p_partkey, CAST(round_even(alpha / 255.0 * r + (1 - alpha / 255.0) * 255.0, 0) AS DOUBLE) AS red, CAST(round_even(alpha / 255.0 * g + (1 - alpha / 255.0) * 255.0, 0) AS DOUBLE) AS green, CAST(round_even(alpha / 255.0 * b + (1 - alpha / 255.0) * 255.0, 0) AS DOUBLE) AS blue FROM q""")
def alpha_over_white(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    r, g, b, a = (k * 37 % 256).cast("double"), (k * 101 % 256).cast("double"), (k * 59 % 256).cast("double"), (s * 5 % 256).cast("double")
    ch = (k % 4 + 1).cast("int")
    data = F.when(ch == 1, F.array(r)).when(ch == 2, F.array(r, g)).when(ch == 3, F.array(r, g, b)).otherwise(F.array(r, g, b, a))
    got = images.to_rgb(table(spark, sf, "part").select(k, ch.alias("ch"), data.alias("data")))
    return got.select("p_partkey", *[F.get("rgb", F.lit(i)).alias(c) for i, c in enumerate(("red", "green", "blue"))])


@query(f"WITH {CELLS} SELECT vec_id, (i % 4) * 16 + i // 4 AS i, {q6('v')} AS y FROM cells")
def image_layout(spark, sf):
    """16 pixels of 4 channels, channels last to channels first; the way back must give the input."""
    first = images.channels_first(F.col("v"), 4, 4, 4)
    rows = latents(spark, sf).select("vec_id", first.alias("first"), "v")
    back = F.when(images.channels_last(F.col("first"), 4, 4, 4) == F.col("v"), F.col("first"))
    return _entries(rows, back)


@query("""
SELECT s_suppkey, y, x, (s_suppkey % 12 // 4) * (3 + 1) + y AS gy, (s_suppkey % 12 % 4) * (2 + 1) + x AS gx FROM supplier, range(3) a(y), range(2) b(x)""")
def grid_layout(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 12).alias("image"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return images.grid(rows, "image", 3, 2, 3, 4, gap=1).select("s_suppkey", "y", "x", "gy", "gx")


@query("SELECT n, r, CAST(ceil(n / r) AS BIGINT) AS cols, CAST(floor(n / r) AS BIGINT) AS compat_cols FROM (SELECT s_suppkey AS n, s_suppkey % 5 + 1 AS r FROM supplier)")
def grid_columns(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("n"), (F.col("s_suppkey") % 5 + 1).alias("r"))
    return rows.select("n", "r", images.grid_columns(F.col("n"), F.col("r")).alias("cols"), images.grid_columns(F.col("n"), F.col("r"), True).alias("compat_cols"))


@query("""
WITH i AS (SELECT s_suppkey AS img_id, s_suppkey % 5 + 1 AS h, s_suppkey % 3 + 2 AS w FROM supplier), s AS (SELECT *, greatest(h, w) AS side FROM i)
SELECT img_id, y, x, CAST(CASE WHEN y - (side - h) // 2 BETWEEN 0 AND h - 1 AND x - (side - w) // 2 BETWEEN 0 AND w - 1 THEN (y - (side - h) // 2) * 10 + x - (side - w) // 2 ELSE 255 END AS DOUBLE) AS v
FROM s, range(5) a(y), range(5) b(x) WHERE y < side AND x < side""")
def pad2square(spark, sf):
    canvas = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("img_id"), (F.col("s_suppkey") % 5 + 1).alias("h"), (F.col("s_suppkey") % 3 + 2).alias("w"))
    cells = canvas.withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("w") - 1)))
    cells = cells.select("img_id", "y", "x", (F.col("y") * 10 + F.col("x")).cast("double").alias("v"))
    return images.pad_to_square(cells, canvas)


@query("""
WITH RECURSIVE r(k, n, h, w) AS (
  SELECT p_partkey, 0, p_partkey * 7 % 900 + 20, p_size * 13 + 30 FROM part
  UNION ALL SELECT k, n + 1, h // 2, w // 2 FROM r WHERE least(h, w) >= 64
), l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS last FROM r)
SELECT k AS p_partkey, CAST(n AS BIGINT) AS halvings, CAST(round_even(h * (32 / least(h, w)), 0) AS BIGINT) AS h, CAST(round_even(w * (32 / least(h, w)), 0) AS BIGINT) AS w FROM l WHERE last = 1""")
def resize_dims(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", images.resize_dims(F.col("p_partkey") * 7 % 900 + 20, F.col("p_size") * 13 + 30, F.lit(32)).alias("d"))
    return rows.select("p_partkey", "d.halvings", "d.h", "d.w")


@query(f"""
WITH {CELLS}
SELECT vec_id, CAST(8 AS BIGINT) AS h, i // 16 AS y, i % 8 // 2 AS x, {q6('avg(v)')} AS v FROM cells GROUP BY ALL
UNION ALL SELECT vec_id, 7, ([0, 0, 1, 1, 1, 2, 2])[i // 5 + 1], ([0, 0, 0, 1, 1])[i % 5 + 1], {q6('avg(v)')} FROM cells WHERE i < 35 GROUP BY ALL""")
def box_halve(spark, sf):
    """Even sides (8 x 8) and odd ones (7 x 5)."""
    both = F.array(F.struct(F.lit(8).alias("h"), F.lit(8).alias("w")), F.struct(F.lit(7).alias("h"), F.lit(5).alias("w")))
    cells = latents(spark, sf).select("vec_id", F.posexplode("v").alias("i", "v")).select("vec_id", "i", "v", F.explode(both).alias("s")).where("i < s.h * s.w")
    cells = cells.select("vec_id", F.floor(F.col("i") / F.col("s.w")).alias("y"), (F.col("i") % F.col("s.w")).alias("x"), "v", "s.h", "s.w")
    return images.box_halve(cells, ["vec_id", "h"], F.col("h"), F.col("w")).select("vec_id", "h", "y", "x", r6(F.col("v")).alias("v"))


@query(f"WITH {CELLS} SELECT vec_id, i // 8 - 2 AS y, i % 8 - 2 AS x, {q6('v')} AS v FROM cells WHERE i // 8 BETWEEN 2 AND 4 AND i % 8 BETWEEN 2 AND 4")
def center_crop(spark, sf):
    cells = latents(spark, sf).select("vec_id", F.posexplode("v").alias("i", "v")).select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), r6(F.col("v")).alias("v"))
    return images.center_crop(cells, F.lit(8), F.lit(8), 3)


@query(f"WITH {CELLS} SELECT vec_id, (i // 8) * 2 + d // 2 AS y, (i % 8) * 2 + d % 2 AS x, {q6('v')} AS v FROM cells, range(4) t(d)")
def upsample_nearest(spark, sf):
    cells = latents(spark, sf).select("vec_id", F.posexplode("v").alias("i", "v")).select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), r6(F.col("v")).alias("v"))
    return images.upsample_nearest(cells)


@query(f"WITH {CELLS} SELECT vec_id, i, {q6('(v - 0.1159) * 0.3611')} AS z, {q6('v')} AS back FROM cells")
def posterior_affine(spark, sf):
    cells = latents(spark, sf).select("vec_id", F.posexplode("v").alias("i", "v"))
    z = images.posterior_affine(F.col("v"))
    return cells.select("vec_id", "i", r6(z).alias("z"), r6(images.posterior_affine_inverse(z)).alias("back"))


# ---------------------------------------------------------------- sources, sinks, harness


@query("""
WITH w AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 1000 = 7 THEN 'out/img1_0' ELSE 'out/img' || (o_orderkey % 50) END AS root, CASE WHEN o_orderkey % 1000 = 7 THEN 51 ELSE o_orderkey % 50 END AS g FROM orders),
r AS (SELECT *, root || '.png' AS path, row_number() OVER (PARTITION BY root ORDER BY id) AS k FROM w)
SELECT id, path, CASE WHEN g % 2 = 1 AND k = 1 THEN path WHEN g = 1 AND EXISTS (SELECT 1 FROM w WHERE w.g = 51) THEN root || '_' || (k - 1) || '.png'
 WHEN g % 2 = 1 THEN root || '_' || (k - 2) || '.png' ELSE root || '_' || CASE WHEN k = 1 THEN 0 ELSE k END || '.png' END AS name FROM r""")
def save_names(spark, sf):
    """Even images find their plain name and _1 taken; some rows want img1_0.png as it is, so img1.png cannot become that."""
    group = F.when(F.col("o_orderkey") % 1000 == 7, "1_0").otherwise((F.col("o_orderkey") % 50).cast("string"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("out/img"), group, F.lit(".png")).alias("path"))
    taken = spark.range(0, 50, 2).select(F.explode(F.array(F.concat(F.lit("out/img"), F.col("id").cast("string"), F.lit(".png")), F.concat(F.lit("out/img"), F.col("id").cast("string"), F.lit("_1.png")))).alias("path"))
    return files.final_names(rows, taken)


@query("""
SELECT p_partkey, 'img.' || CASE p_partkey % 3 WHEN 0 THEN 'jpg' WHEN 1 THEN 'JPEG' ELSE 'png' END AS path, p_partkey % 3 < 2 AS is_jpeg,
 CASE p_partkey % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'object' ELSE 'file' END AS kind FROM part""")
def source_dispatch(spark, sf):
    k = F.col("p_partkey") % 3
    path = F.concat(F.lit("img."), F.when(k == 0, "jpg").when(k == 1, "JPEG").otherwise("png"))
    place = F.concat(F.when(k == 0, "https://h/").when(k == 1, "s3://b/").otherwise("/d/"), path)
    return table(spark, sf, "part").select("p_partkey", path.alias("path"), files.format_matches(path, F.lit("jpeg")).alias("is_jpeg"), files.source_kind(place).alias("kind"))


@query("""
SELECT n_name AS key, CASE WHEN n_name = 'NATION_3' THEN 'x' ELSE 'v' || n_nationkey END AS value FROM nation WHERE n_nationkey % 2 = 1""")
def config_filter(spark, sf):
    nations = table(spark, sf, "nation")
    odd = [r["n_name"] for r in nations.where("n_nationkey % 2 = 1").select("n_name").collect()]  # the allowed keys, a fixed list
    entries = nations.select(F.col("n_name").alias("key"), F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("value"))
    return files.filter_config(entries, odd, {"NATION_3": "x"})


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'model.embed_tokens.weight' ELSE 'lm_head.weight' END AS weight,
 CASE WHEN s_suppkey % 2 = 0 THEN 'model.safetensors' WHEN s_suppkey % 3 = 0 THEN 'part-1' ELSE 'part-2' END AS file FROM supplier""")
def weight_shard(spark, sf):
    k = F.col("s_suppkey")
    index = F.from_json(F.when(k % 2 == 1, '{"model.embed_tokens.weight": "part-1", "lm_head.weight": "part-2"}'), "map<string,string>")
    rows = table(spark, sf, "supplier").select(k, files.head_name(k % 3 == 0).alias("weight"), index.alias("m"))
    return files.shard_of(rows, "m", F.col("weight")).select("s_suppkey", "weight", "file")


@query("SELECT role, length(text) AS message, count(*) AS n FROM conversations GROUP BY ALL")
def log_once(spark, sf):
    rows = table(spark, sf, "conversations").select("role", F.length("text").alias("message"))
    return once(rows, ["role", "message"])


@query(f"SELECT attempt, {q6('least(0.5 * power(2, attempt - 1), 30)')} AS wait FROM range(1, 33) t(attempt)")
def retry_schedule(spark, sf):
    return spark.range(1, 33).select(F.col("id").alias("attempt"), r6(retry_wait(F.col("id"), 0.5, 2.0, 30.0)).alias("wait"))


# ---------------------------------------------------------------- end to end (no SQL: checked against numpy in tests)


@query(None)
def tiny_pipeline(spark, sf):
    """Captions (first turns) to latents with the tiny model, three guidance branches."""
    captions = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("caption")).select(F.col("conv_id").alias("sample_id"), "caption")
    got = generation.generate(captions, generation.TinyModel(), cfg=7.5, cfg_img=2.0, negative="blurry")
    return got.select("sample_id", "rep", F.posexplode("latent").alias("i", "v")).select("sample_id", "rep", "i", r6(F.col("v")).alias("v"))


@query(None)
def tiny_forward(spark, sf):
    """Logits of the last position of each turn."""
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"), F.transform(prompts.words(F.col("text")), lambda w: F.pmod(prompts.word_id(w), F.lit(generation.TinyModel.vocabulary))).alias("ids"))
    got = generation.last_logits(rows, generation.TinyModel())
    return got.select("sample_id", "n", F.posexplode("logits").alias("k", "logit")).select("sample_id", "n", "k", r6(F.col("logit")).alias("logit"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as latents: patches, layer norm of each patch, mean norm by label and patch."""
    patches = layout.patchify(latents(spark, sf_dir), "v", 4, 4, 4, 2)
    normed = patches.withColumn("y", vectors.layer_norm(F.col("vec")))
    return normed.groupBy("label", "tok").agg(F.count("*").alias("n"), r6(F.avg(vectors.p_norm(F.col("vec"), 2))).alias("mean_norm"), r6(F.avg(F.array_max("y"))).alias("mean_peak"))


@query(f"""
WITH {CELLS}, p AS (SELECT vec_id, label, (i % 16) // 4 // 2 * 2 + i % 4 // 2 AS tok, v FROM cells),
t AS (SELECT vec_id, label, tok, sqrt(sum(v * v)) AS norm, (max(v) - avg(v)) / sqrt(var_pop(v) + 1e-6) AS peak FROM p GROUP BY ALL)
SELECT CAST(label AS BIGINT) AS label, tok, count(*) AS n, {q6('avg(norm)')} AS mean_norm, {q6('avg(peak)')} AS mean_peak FROM t GROUP BY label, tok""")
def patch_statistics(spark, sf):
    return flagship(spark, sf)
