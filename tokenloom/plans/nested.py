"""Queries of nested formatting, batches of padded rows, steps of cached generation and the whole autoencoder, each with SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tokenloom.functions import pretty
from tokenloom.operators import kernels as K
from tokenloom.operators import layout, prompts
from tokenloom.plans.networks import _END, _MIDDLE, _attention_weights, _conv, _resnet, _resnet_weights, _rows, _x, bias, weight
from tokenloom.plans.queries import _TOKENS, _UNIFORM, _WORDS, CELLS, _normal_sql, _tokens, latents, q6, query, table

# ---------------------------------------------------------------- nested values

_K = "json_extract_string(props, '$.k')"


@query(f"""
SELECT event_id, array_to_string([
  'empty: ' || CASE WHEN event_id % 4 = 0 THEN '[]' ELSE '{{}}' END,
  'name: ' || CASE WHEN event_id % 3 = 0 THEN '''no''' ELSE event_type END,
  'props:', '    k: ' || {_K},
  'user:', '    flags:', '    - ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, '    - null', '    -   n: ' || event_id % 5, '        type: ' || event_type, '    id: ' || user_id
], chr(10)) AS shown FROM events""")
def pretty_nested(spark, sf):
    """Events as nested maps and lists, their own JSON inside."""
    k = F.col("event_id")
    json = F.format_string(
        '{"user": {"id": %d, "flags": [%s, null, {"type": "%s", "n": %d}]}, "props": %s, "name": "%s", "empty": %s}',
        "user_id", (k % 2 == 0).cast("string"), "event_type", k % 5, "props", F.when(k % 3 == 0, "no").otherwise(F.col("event_type")), F.when(k % 4 == 0, "[]").otherwise("{}"),
    )
    return pretty.pretty_nested(table(spark, sf, "events").select("event_id", json.alias("json")), ["event_id"], "json")


@query(f"""
SELECT event_id, array_to_string(['Event(', '    kind=' || event_type || ',', '    user=' || user_id || ',', '    props={{', '        "k": ' || {_K} || ',', '        "t": "' || event_type || '"', '    }},', '    n=' || event_id || ',', '),', repeat('    ', CAST(event_id % 3 AS BIGINT)) || 'end'], chr(10)) AS shown FROM events""")
def pretty_call(spark, sf):
    """Events as calls with a map among the arguments."""
    props = F.concat(F.lit("{'k': "), F.get_json_object("props", "$.k"), F.lit(", 't': '"), F.col("event_type"), F.lit("'}"))
    call = F.concat(F.lit("Event(kind="), "event_type", F.lit(", user="), F.col("user_id").cast("string"), F.lit(", props="), props, F.lit(", n="), F.col("event_id").cast("string"), F.lit("),"), F.repeat(F.lit("\t"), (F.col("event_id") % 3).cast("int")), F.lit("end"))
    return table(spark, sf, "events").select("event_id", pretty.pretty_call(call).alias("shown"))


# ---------------------------------------------------------------- batches and steps


@query(f"""
WITH {_WORDS}, m AS (SELECT sample_id // 400 AS batch, max(len(ids)) AS longest FROM w GROUP BY 1)
SELECT sample_id, pos, CASE WHEN pos < longest - len(ids) THEN 0 WHEN pos < longest THEN length(ids[pos - longest + len(ids) + 1]) ELSE 1000 END AS id,
  CASE WHEN pos < longest - len(ids) THEN 0 ELSE 1 END::BIGINT AS mask
FROM w JOIN m ON sample_id // 400 = batch, range(longest + 1) t(pos)""")
def left_pad_batches(spark, sf):
    """Turns of four conversations are a batch, as long as its longest turn."""
    key = F.col("conv_id") * 100 + F.col("turn")
    rows = table(spark, sf, "conversations").select(key.alias("sample_id"), F.floor(key / 400).alias("batch"), F.transform(prompts.words(F.col("text")), lambda w: F.length(w).cast("bigint")).alias("ids"))
    got = prompts.left_pad(rows, "ids", 0, [1000], batch=["batch"])
    return got.select("sample_id", F.posexplode(F.arrays_zip("padded", "mask")).alias("pos", "x")).select("sample_id", "pos", F.col("x.padded").alias("id"), F.col("x.mask").alias("mask"))


@query(f"""
WITH {_TOKENS}, c AS (SELECT sample_id, count(*) AS len, sample_id % 4 AS kind FROM t GROUP BY 1),
p AS (SELECT *, CAST(CASE WHEN attn = 0 THEN 1 ELSE sum(attn) OVER (PARTITION BY sample_id ORDER BY pos) - 1 END AS BIGINT) AS position_id FROM t),
r AS (SELECT p.*, kind, CASE WHEN kind = 0 THEN pos ELSE pos - (len - 1) END AS step, CASE WHEN kind = 0 THEN pos WHEN kind = 2 THEN len ELSE len - 1 END AS place FROM p JOIN c USING (sample_id) WHERE kind = 0 OR pos = len - 1)
SELECT r.sample_id, r.step, r.pos, CASE WHEN kind > 0 THEN token_id END AS token_id, CASE WHEN kind = 0 THEN 'embeds' ELSE 'ids' END AS source, r.position_id, k AS key,
  CASE WHEN k <= place AND coalesce((SELECT min(attn) FROM t WHERE t.sample_id = r.sample_id AND t.pos = k), 1) = 1 THEN 1 ELSE 0 END::BIGINT AS visible
FROM r, range(12) a(k)""")
def generation_step(spark, sf):
    """Prompts given as vectors, single next tokens (vectors given or not), and steps past the end, over a cache of twelve places."""
    tokens = _tokens(spark, sf).withColumn("token_id", F.col("token_id").cast("bigint"))
    n, kind = F.col("len"), F.col("sample_id") % 4
    cache = tokens.groupBy("sample_id").agg(F.count("*").alias("len")).select("sample_id", F.when(kind == 0, 0).when(kind == 2, n).otherwise(n - 1).alias("first"), F.when(kind == 0, n).otherwise(1).alias("n"), kind.isin(0, 3).alias("embeds"))
    got = layout.generation_step(tokens, cache, 12)
    return got.select("sample_id", "step", "pos", "token_id", "source", "position_id", F.posexplode("mask").alias("key", "visible"))


# ---------------------------------------------------------------- the autoencoder as a whole

_STRENGTH = 0.7
_BY_ROW = "id || ':' || i"
_LATENT = f"m.v + exp(0.5 * greatest(-30, least(20, s.v))) * {_normal_sql(3, _BY_ROW)} + {_STRENGTH} * {_UNIFORM.format(seed=3, tag='p', key='id')} * {_normal_sql(4, _BY_ROW)}"


def _inner(name: str, *ctes: str, last: str) -> str:
    return f"{name} AS (WITH {', '.join(ctes)} SELECT id, i, v FROM {last})"


@query(f"""
WITH {CELLS}, {_x("x", 0, 64)}, {_inner("moments", _conv("c", "x", 4, 61), *_resnet("c", "d", 62), *_MIDDLE("d", "m"), *_END("m", "y", 4), last="y")},
z AS (SELECT id, i, {_LATENT} AS v FROM moments m JOIN (SELECT id, i - 32 AS i, v FROM moments) s USING (id, i)),
{_inner("image", _conv("c", "z", 4, 104), *_MIDDLE("c", "m"), *_resnet("m", "u", 62), *_END("u", "y", 3), last="y")}
SELECT id AS vec_id, i, {q6('v')} AS y FROM (SELECT id, i, v FROM image UNION ALL SELECT id, i + 48, v FROM moments)""")
def vae_forward(spark, sf):
    """Encode, sample the posterior, disturb it by up to 0.7, decode: the image (48 numbers), then the moments (64)."""
    k = F.col("vec_id")
    places = F.sequence(F.lit(0), F.lit(31))
    noise = F.transform(places, lambda i: layout.hash_normal(3, k, i))
    amount = _STRENGTH * layout.hash_uniform(3, F.lit("p"), k)
    shift = F.transform(places, lambda i: amount * layout.hash_normal(4, k, i))
    shared = _resnet_weights("mid1", 70) | _attention_weights("mid.attn", 80) | _resnet_weights("mid2", 90) | {"out.norm.w": 1 + bias(4, 100), "out.norm.b": bias(4, 101)}
    end = lambda n: shared | {"out.w": weight(n, 4, 3, 3, salt=102), "out.b": bias(n, 102)}
    encode = end(4) | _resnet_weights("down0", 62) | {"in.w": weight(4, 4, 3, 3, salt=61), "in.b": bias(4, 61)}
    decode = end(3) | _resnet_weights("up0", 62) | {"in.w": weight(4, 2, 3, 3, salt=104), "in.b": bias(4, 104)}

    def one(row: np.ndarray) -> np.ndarray:
        image, moments = K.autoencode(row[:64].reshape(4, 4, 4), encode, decode, 1, 2, row[64:96].reshape(2, 4, 4), row[96:].reshape(2, 4, 4))
        return np.concatenate([image.ravel(), moments.ravel()])

    return _rows(latents(spark, sf).select("vec_id", F.concat("v", noise, shift).alias("v")), lambda v: np.stack([one(x) for x in v]))
