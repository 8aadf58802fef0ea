"""Queries of the operators for sequences and weights beyond one task, and of the decode loop, each with SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.ordering import shared_path
from tokenloom.operators import kernels as K
from tokenloom.operators import params, tiled
from tokenloom.plans.networks import CELLS, _decoder, _decoder_weights, _linear, _rms, bias, weight
from tokenloom.plans.queries import latents, q6, query, r6, table
from tokenloom.sources import tensors
from tokenloom.streaming import decode

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Keyed map state needs the RocksDB store; a store that the session names is left alone."""
    spark.streams.active  # starts the stores' coordinator, which a batch query does not do by itself
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(name, "HDFSBacked"):
        spark.conf.set(name, _ROCKS)
    return spark


# ---------------------------------------------------------------- attention in tiles


@query(f"""
WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (
  SELECT a.vec_id, h, b.v[33 + h // 2 * 16 : 48 + h // 2 * 16] AS y, exp(list_inner_product(a.v[1 + h * 16 : 16 + h * 16], b.v[1 + h // 2 * 16 : 16 + h // 2 * 16]) / 4) AS u
  FROM e a JOIN e b ON a.label = b.label AND b.vec_id <= a.vec_id, range(4) t(h)
),
s AS (SELECT vec_id, h, d, sum(u * y[d + 1]) / sum(u) AS o FROM x, range(16) t(d) GROUP BY ALL)
SELECT vec_id, h AS head, d, {q6('o')} AS out FROM s""")
def tiled_attention(spark, sf):
    """The vectors of a label are a sequence: four query heads over two key-value heads, causal, all 64 entries."""
    rows = latents(spark, sf)
    heads = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("head")
    part = lambda first: F.slice("v", F.col("head") * 16 + 1 + first, 16)
    q = rows.select("label", "vec_id", "v", heads(4)).select("label", "vec_id", "head", part(0).alias("q"))
    kv = rows.select("label", "vec_id", "v", heads(2)).select("label", "vec_id", "head", part(0).alias("k"), part(32).alias("v"))
    got = tiled.tiled_attention(q, kv, sample="label", pos="vec_id", head="head", kv_repeat=2, block=64, run=2)
    return got.select("vec_id", "head", F.posexplode("out").alias("d", "out")).select("vec_id", "head", "d", r6(F.col("out")).alias("out"))


# ---------------------------------------------------------------- products with weights from tables

_INNER = 96
_GATE = "SELECT o_orderkey % 96 AS o, o_custkey % 64 AS i, (sum(o_custkey) % 23 - 11) / 40.0 AS w FROM orders GROUP BY ALL"
_UP = "SELECT l_partkey % 96 AS o, l_suppkey % 64 AS i, (sum(l_orderkey) % 23 - 11) / 40.0 AS w FROM lineitem GROUP BY ALL"
_DOWN = "SELECT p_partkey % 64 AS o, p_partkey * 7 % 96 AS i, (sum(p_size) % 19 - 9) / 40.0 AS w FROM part GROUP BY ALL"


def _entries(rows: DataFrame, o, i, amount, n: int) -> DataFrame:
    return rows.groupBy(o.alias("o"), i.alias("i")).agg(((F.sum(amount) % n - n // 2) / 40.0).alias("w"))


@query(f"""
WITH {CELLS}, x AS (SELECT vec_id AS id, i, v FROM cells), wg AS ({_GATE}), wu AS ({_UP}), wd AS ({_DOWN}),
g AS (SELECT id, o, sum(v * w) AS v FROM x JOIN wg USING (i) GROUP BY id, o),
u AS (SELECT id, o, sum(v * w) AS v FROM x JOIN wu USING (i) GROUP BY id, o),
h AS (SELECT id, o AS i, g.v / (1 + exp(-g.v)) * u.v AS v FROM g JOIN u USING (id, o)),
y AS (SELECT id, o, sum(v * w) AS v FROM h JOIN wd USING (i) GROUP BY id, o)
SELECT vec_id, i, {q6('coalesce(y.v, 0.0)')} AS y FROM cells LEFT JOIN y ON id = vec_id AND o = i""")
def tiled_gated_mlp(spark, sf):
    """All 64 entries through a gated network whose weights are made of three tables and stay tables."""
    orders, lines, parts = (table(spark, sf, n) for n in ("orders", "lineitem", "part"))
    weights = [
        _entries(orders, F.col("o_orderkey") % _INNER, F.col("o_custkey") % 64, F.col("o_custkey"), 23),
        _entries(lines, F.col("l_partkey") % _INNER, F.col("l_suppkey") % 64, F.col("l_orderkey"), 23),
        _entries(parts, F.col("p_partkey") % 64, F.col("p_partkey") * 7 % _INNER, F.col("p_size"), 19),
    ]
    rows = latents(spark, sf)
    tile = 24  # several tiles on each side
    pieces = tiled.row_pieces(rows, id_col="vec_id", vec="v", tile=tile)
    out = tiled.tiled_mlp(pieces, *[tiled.weight_tiles(w, tile=tile) for w in weights], inner=_INNER, outputs=64, groups=tiled.groups_of(rows.count()), tile=tile)
    cells = out.select(F.col("id").alias("vec_id"), "ib", F.posexplode("x").alias("j", "y"))
    return cells.select("vec_id", (F.col("ib") * tile + F.col("j")).alias("i"), r6(F.col("y")).alias("y"))


# ---------------------------------------------------------------- decoding with a cache

_WIDTH, _HEADS, _LAYERS = 8, 2, 2


def _weights() -> K.Weights:
    return _decoder_weights("layer0", 21) | _decoder_weights("layer1", 30) | {"norm.w": 1 + bias(8, 39)}


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector is a sequence of eight positions of eight entries."""
    pos = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.slice("v", p * _WIDTH + 1, _WIDTH))).alias("pos", "vec")
    return latents(spark, sf).select(F.col("vec_id").alias("sample_id"), pos).withColumn("pos", F.col("pos").cast("long"))


def _layers(src: str, dst: str, tag: str) -> list[str]:
    return [*_decoder(21, src, f"{tag}a", 16, tag), *_decoder(30, f"{tag}a", f"{tag}b", 16, tag), _rms(dst, f"{tag}b", 39)]


@query(f"WITH {CELLS}, {', '.join(['x AS (SELECT vec_id * 16 + i // 8 AS id, i % 8 AS i, v FROM cells)', *_layers('x', 'y', 'A')])} SELECT id // 16 AS sample_id, id % 16 AS pos, i, {q6('v')} AS out FROM y")
def cached_backbone(spark, sf):
    """Two layers with their cache as keyed state, in blocks of three positions and two rows at a time."""
    rows = _steps(with_state_store(spark), sf).withColumn("branch", F.lit(0).cast("long"))
    got = decode.decode_stream(rows.select("sample_id", "branch", "pos", "vec"), _weights(), layers=_LAYERS, heads=_HEADS, kv_heads=1, block=3, most=2)
    return got.select("sample_id", "pos", F.posexplode("out").alias("i", "out")).select("sample_id", "pos", "i", r6(F.col("out")).alias("out"))


_CFG, _TOKENS, _TOKEN = 3.0, 3, 6


def _loop_sql() -> str:
    """Each step: both branches, the guided output of the last position, its token, and the next position of both."""
    ctes = ["x0 AS (SELECT (vec_id * 2 + b) * 16 + i // 8 AS id, i % 8 AS i, v * (1 - b / 2.0) AS v FROM cells, range(2) t(b))"]
    for k in range(_TOKENS):
        ctes += _layers(f"x{k}", f"y{k}", f"S{k}")
        ctes.append(f"c{k} AS (SELECT p.id // 32 AS id, p.i, q.v + {_CFG} * (p.v - q.v) AS v FROM y{k} p JOIN y{k} q ON q.id = p.id + 16 AND q.i = p.i WHERE p.id % 32 = {7 + k})")
        ctes += [_linear(f"t{k}", f"c{k}", _TOKEN, 50), _linear(f"e{k}", f"t{k}", _WIDTH, 51)]
        ctes.append(f"x{k + 1} AS (SELECT * FROM x{k} UNION ALL SELECT (id * 2 + b) * 16 + {8 + k}, i, v FROM e{k}, range(2) t(b))")
    last = " UNION ALL ".join(f"SELECT id, {k} AS step, i, v FROM t{k}" for k in range(_TOKENS))
    return f"WITH {CELLS}, {', '.join(ctes)} SELECT id AS sample_id, CAST(step AS BIGINT) AS step, i, {q6('v')} AS token FROM ({last})"


@query(_loop_sql())
def decode_loop(spark, sf):
    """Three tokens of each sample from two guidance branches: the second branch has halved inputs."""
    rows, w = _steps(with_state_store(spark), sf), {"token.w": weight(_TOKEN, 8, salt=50), "token.b": bias(_TOKEN, 50), "embed.w": weight(8, _TOKEN, salt=51), "embed.b": bias(8, 51)}
    both = rows.withColumn("branch", F.explode(F.array(F.lit(0), F.lit(1)))).select("sample_id", F.col("branch").cast("long").alias("branch"), F.col("pos").cast("long").alias("pos"), F.transform("vec", lambda x: x * (1 - F.col("branch") / 2)).alias("vec"), F.when((F.col("branch") == 0) & (F.col("pos") == 0), _TOKENS).cast("long").alias("make"))

    def token(outputs: np.ndarray, sample: int, step: int) -> np.ndarray:
        return K.linear(decode.guided(outputs, _CFG), w, "token")

    got = decode.generate_stream(both, _weights(), layers=_LAYERS, heads=_HEADS, kv_heads=1, token=token, embed=lambda t: K.linear(t, w, "embed"), block=3)
    return got.select("sample_id", "step", F.posexplode("token").alias("i", "token")).select("sample_id", "step", "i", r6(F.col("token")).alias("token"))


# ---------------------------------------------------------------- weight files


def _as_tensors(spark: SparkSession, sf: str) -> DataFrame:
    return latents(spark, sf).select(F.concat(F.lit("vec."), "vec_id").alias("name"), F.lit("F32").alias("dtype"), F.array(F.lit(4), F.lit(4), F.lit(4)).cast("array<long>").alias("shape"), F.col("v").alias("data"))


@query(f"WITH {CELLS} SELECT 'vec.' || vec_id AS name, 'same' AS verdict, {q6('sum(v)')} AS total, {q6('0 * sum(v)')} AS max_abs FROM cells GROUP BY vec_id")
def tensor_files(spark, sf):
    """Vectors written as tensors of weight files, read back by ranges, and compared with the table."""
    own, path = _as_tensors(spark, sf), shared_path(spark, "tensors")
    tensors.write_tensors(own, path)
    back = tensors.read_tensors(spark, path)
    same = params.state_diff(own.withColumn("device", F.lit("cpu")), back.withColumn("device", F.lit("cpu")))
    totals = back.select("name", F.aggregate("data", F.lit(0.0), lambda s, x: s + x).alias("total"))
    return same.join(totals, "name").select("name", "verdict", r6(F.col("total")).alias("total"), r6(F.col("max_abs")).alias("max_abs"))


@query(f"WITH {CELLS} SELECT 'vec.' || vec_id AS name, i, {q6('v')} AS v FROM cells WHERE vec_id = 7 OR starts_with(CAST(vec_id AS VARCHAR), '3')")
def tensor_lookup(spark, sf):
    """Tensors by name and by prefix: only their bytes of the files are read."""
    path = shared_path(spark, "tensors")
    tensors.write_tensors(_as_tensors(spark, sf), path)
    both = tensors.read_tensors(spark, path, ["vec.7"]).unionByName(tensors.read_tensors(spark, path).where(F.col("name").startswith("vec.3")))
    return both.select("name", F.posexplode("data").alias("i", "v")).select("name", "i", r6(F.col("v")).alias("v"))
