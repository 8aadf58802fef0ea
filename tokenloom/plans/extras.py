"""Queries of keyed permutations, module trees, the image sink and the training loss, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.functions.ordering import shared_path
from tokenloom.operators import images, modules, permutation, training
from tokenloom.operators.prompts import IGNORE_INDEX
from tokenloom.plans.queries import _UNIFORM, CELLS, _normal_sql, latents, q6, query, r6, table
from tokenloom.sources import exif, files, image_sink

# ---------------------------------------------------------------- shuffled orders without a sort

_N = "(SELECT count(*) FROM orders)"


def _permuted(key: str) -> str:
    return f"WITH RECURSIVE numbers AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS num FROM orders), {permutation.permutation_sql('num', _N, key)}, rows AS (SELECT id, p FROM numbers JOIN placed ON i = num)"


@query(f"{_permuted('1:2')} SELECT id, (p + k * {_N}) % 7 AS rank, (p + k * {_N}) // 7 AS slot FROM rows, range(2) t(k) WHERE p + k * {_N} < ({_N} + 6) // 7 * 7")
def shard_permuted(spark, sf):
    """Seven padded shares of an epoch, each row's place computed from its number."""
    rows = permutation.numbered(table(spark, sf, "orders"), "o_orderkey")
    return permutation.permuted_ranks(rows, rows.count(), 7, seed=1, epoch=2)


@query(f"{_permuted('0:5')} SELECT id, p % 8 AS rank, p // 8 AS slot FROM rows WHERE p < {_N} // 8 * 8 AND p // 8 >= 100")
def shard_permuted_resume(spark, sf):
    """Eight cut shares, resumed after a hundred slots: a filter on computed places."""
    rows = permutation.numbered(table(spark, sf, "orders"), "o_orderkey")
    return permutation.permuted_ranks(rows, rows.count(), 8, epoch=5, drop_last=True, skip=100)


# ---------------------------------------------------------------- module trees


@query("""
WITH RECURSIVE w AS (
  SELECT p_partkey AS id, '' AS path, false AS hidden FROM part WHERE p_partkey = 0
  UNION ALL
  SELECT p_partkey, CASE WHEN path = '' THEN '' ELSE path || '.' END || 'm' || p_partkey, hidden OR p_partkey % 17 = 5 FROM part JOIN w ON (p_partkey - 1) // 3 = id WHERE p_partkey > 0
)
SELECT CASE WHEN path = '' THEN '' ELSE path || '.' END || 'weight' AS name FROM w WHERE NOT hidden""")
def module_decay_names(spark, sf):
    """Parts as a tree of modules of three each, some of them norms: weights that decay."""
    k = F.col("p_partkey")
    parts = table(spark, sf, "part")
    tree = parts.select(k.alias("id"), F.when(k > 0, F.floor((k - 1) / 3)).cast("long").alias("parent"), F.concat(F.lit("m"), k.cast("string")).alias("name"), F.when(k % 17 == 5, "LayerNorm").otherwise("Linear").alias("type"))
    own = parts.select(k.alias("module"), F.explode(F.array(F.lit("weight"), F.lit("bias"))).alias("name"))
    return modules.decay_names(tree, own, ["LayerNorm", "RMSNorm"])


# ---------------------------------------------------------------- image files


@query(f"WITH {CELLS} SELECT vec_id, 'img-' || (vec_id // 2 * 2) || CASE WHEN vec_id % 2 = 0 THEN '' ELSE '_0' END || '.png' AS name, i, CAST(floor((v + 1) * 127.5) AS BIGINT) AS pixel FROM cells")
def image_files(spark, sf):
    """Vectors as grey images of 8 x 8 pixels, two of which want each name: written, and read back decoded."""
    folder = shared_path(spark, "images")
    name = F.concat(F.lit("img-"), (F.floor(F.col("vec_id") / 2) * 2).cast("string"), F.lit(".png"))
    images = latents(spark, sf).select(F.col("vec_id").alias("id"), name.alias("path"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("ch"), F.transform("v", lambda x: F.floor((x + 1) * 127.5).cast("int")).alias("data"))
    names = image_sink.save_images(images, folder)
    back = files.decoded_images(spark, folder).select(F.regexp_extract("img_id", "[^/]+$", 0).alias("name"), "data")
    return names.join(back, "name").select(F.col("id").alias("vec_id"), "name", F.posexplode("data").alias("i", "pixel"))  # a row an image is sorted, not one a pixel


_TURNED = {2: ("y", "15 - x"), 3: ("3 - y", "15 - x"), 4: ("3 - y", "x"), 5: ("x", "y"), 6: ("x", "3 - y"), 7: ("15 - x", "3 - y"), 8: ("15 - x", "y")}
_TO = [f"CASE o {' '.join(f'WHEN {k} THEN {v[axis]}' for k, v in _TURNED.items())} ELSE {'yx'[axis]} END" for axis in (0, 1)]


@query(f"""
WITH {CELLS}, c AS (SELECT vec_id, vec_id % 10 AS o, i // 16 AS y, i % 16 AS x, v FROM cells),
t AS (SELECT vec_id, o, {_TO[0]} AS y, {_TO[1]} AS x, CASE WHEN o BETWEEN 5 AND 8 THEN 4 ELSE 16 END AS w, v FROM c)
SELECT vec_id, CASE WHEN o BETWEEN 1 AND 8 THEN o END AS orientation, CAST(w AS BIGINT) AS w, CAST(y * w + x AS BIGINT) AS i, {q6('v')} AS v FROM t""")
def exif_upright(spark, sf):
    """Vectors as pictures of 4 x 16 pixels behind headers of either byte order that turn them; 0 and 9 are no orientations."""
    k = F.col("vec_id")
    o = (k % 10).cast("int")
    small = F.concat(F.lit("49492A0008000000" "0200" "0001030001000000" "10000000" "1201030001000000"), F.lpad(F.hex(o), 2, "0"), F.lit("000000" "00000000"))
    big = F.concat(F.lit("4D4D002A00000008" "0001" "0112000300000001"), F.lpad(F.hex(o), 4, "0"), F.lit("0000" "00000000"))
    body = F.concat(F.lit("457869660000"), F.when(k % 3 == 0, big).otherwise(small))
    header = F.concat(F.lit("FFD8" "FFE00004ABCD" "FFE1"), F.lpad(F.hex((F.length(body) / 2 + 2).cast("int")), 4, "0"), body, F.lit("FFDA0002" "FFD9"))
    rows = latents(spark, sf).select(k, "v", exif.orientation(F.unhex(header)).alias("o"))
    _, w, data = images.upright(F.lit(4), F.lit(16), F.lit(1), F.col("v"), F.col("o"))
    cells = rows.select(k, F.col("o").cast("long").alias("orientation"), w.cast("long").alias("w"), F.posexplode(data).alias("i", "v"))
    return cells.select("vec_id", "orientation", "w", F.col("i").cast("long").alias("i"), r6(F.col("v")).alias("v"))


_MODES = ["1", "L", "LA", "RGB", "RGBA", "CMYK", "P"]
_OVER = "CAST(round_even({alpha} / 255.0 * {c} + (1 - {alpha} / 255.0) * 255.0, 0) AS BIGINT)"
_INKED = "({c} * (255 - a) + 128)"


def _channel(i: int) -> str:
    c = "rgb"[i]
    inked = _INKED.format(c=c)
    cases = ["CASE WHEN r <> 0 THEN 255 ELSE 0 END", "r", _OVER.format(alpha="g", c="r"), c, _OVER.format(alpha="a", c=c), f"greatest(255 - a - ((({inked} >> 8) + {inked}) >> 8), 0)", f"CASE WHEN r % 5 = 4 THEN 0 ELSE n * (r % 5 * 4 + {i + 1}) % 256 END"]
    return f"CAST(CASE m {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(cases))} END AS BIGINT)"


@query(f"""
WITH p AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST((l_orderkey + l_linenumber) % 7 AS BIGINT) AS m, l_partkey AS n, CAST(l_partkey * 37 % 256 AS BIGINT) AS r, CAST(l_suppkey * 101 % 256 AS BIGINT) AS g, CAST(l_orderkey * 59 % 256 AS BIGINT) AS b, CAST(l_linenumber * 41 % 256 AS BIGINT) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, {_channel(0)} AS red, {_channel(1)} AS green, {_channel(2)} AS blue FROM p""")
def pixel_modes(spark, sf):
    """A pixel of each order line, in each of seven modes, as three channels; palettes have four colours, indices go one further."""
    o, n, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    m = ((o + n) % 7).cast("int")
    r, g, b, a = [(c * f % 256).cast("int") for c, f in ((part, 37), (F.col("l_suppkey"), 101), (o, 59), (n, 41))]
    mode = F.get(F.array(*[F.lit(x) for x in _MODES]), m)
    data = F.when(m == 2, F.array(r, g)).when(m < 2, F.array(r)).when(m == 3, F.array(r, g, b)).when(m < 6, F.array(r, g, b, a)).otherwise(F.array(r % 5))
    palette = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda j: (part * j % 256).cast("int"))
    rgb = table(spark, sf, "lineitem").select("l_orderkey", n.cast("long").alias("l_linenumber"), images.pixel_rgb(mode, data, palette).alias("rgb"))
    return rgb.select("l_orderkey", "l_linenumber", *[F.get("rgb", F.lit(i)).cast("long").alias(c) for i, c in enumerate(("red", "green", "blue"))])


# ---------------------------------------------------------------- training loss

_PLACEHOLDER = -1
_KEY = "s || ':' || place || ':' || rep"


@query(f"""
WITH c AS (SELECT conv_id AS s, count(*) % 2 AS m FROM conversations GROUP BY 1),
p AS (SELECT vec_id // 8 AS s, vec_id % 8 AS pos, CASE WHEN vec_id % 9 = 0 THEN -100 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS h, vec_id % 8 BETWEEN 3 AND 5 AS image FROM embeddings),
r AS (SELECT s, pos, h, lead(image) OVER w AS image, lead(label) OVER w AS target, lead(h) OVER w AS patch FROM p WINDOW w AS (PARTITION BY s ORDER BY pos)),
l AS (SELECT h, target, ln(sum(exp(h[k + 1] + 0.5 * h[k + 11]))) AS z FROM r, range(10) t(k) WHERE NOT image AND target >= 0 GROUP BY ALL),
d AS (
  SELECT s, pos - 2 AS place, rep, i, patch[i + 1] AS x, h[i + 1] AS h, {_UNIFORM.format(seed=7, tag='t', key=_KEY)} AS t, {_normal_sql(7, f"({_KEY} || ':' || i)")} AS e
  FROM (SELECT *, pos - 2 AS place FROM r WHERE image), range(4) a(rep), range(64) b(i)
),
m AS (SELECT s, place, rep, avg(power(0.5 * (t * x + (1 - t) * e) + h * t - (x - e), 2)) AS mse FROM d GROUP BY ALL),
a AS (SELECT avg(z - (h[target + 1] + 0.5 * h[target + 11])) AS lm, count(*) AS n FROM l),
b AS (SELECT sum(mse * coalesce(m, 0)) / (sum(coalesce(m, 0)) + 1e-8) AS im, count(*) // 4 AS n FROM m LEFT JOIN c USING (s))
SELECT {q6('lm')} AS lm_loss, {q6('im')} AS im_loss, {q6('lm * 0.01 + im')} AS loss, a.n AS n_tokens, b.n AS n_patches FROM a, b""")
def training_loss(spark, sf):
    """Eight vectors are a sequence, three of them patches; every second conversation's image counts."""
    k = F.col("vec_id")
    image = (k % 8).between(3, 5)
    rows = latents(spark, sf).select(F.floor(k / 8).alias("sample_id"), (k % 8).alias("pos"), F.when(image, _PLACEHOLDER).otherwise(F.col("label")).alias("token_id"), F.when(k % 9 == 0, IGNORE_INDEX).otherwise(F.col("label")).alias("label"), F.col("v").alias("hidden"))
    patches = rows.where(F.col("token_id") == _PLACEHOLDER).select("sample_id", (F.col("pos") - 3).alias("place"), F.col("hidden").alias("target"))
    masks = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("sample_id")).agg((F.count("*") % 2).alias("mask"))
    got = training.training_loss(
        rows, patches, masks, placeholder=_PLACEHOLDER, seed=7,
        logits=lambda h: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.get(h, j) + 0.5 * F.get(h, j + 10)),
        velocity=lambda x, t, h: F.zip_with(x, h, lambda a, b: 0.5 * a + b * t),
    )
    return got.select(*[r6(F.col(c)).alias(c) for c in ("lm_loss", "im_loss", "loss")], "n_tokens", "n_patches")
