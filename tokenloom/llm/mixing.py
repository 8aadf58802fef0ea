"""Mixing sources to target weights.

Every document gets a hash-random key; each source is cut into key ranges, the token counts of
the ranges are summed (partial sums before the shuffle), prefix sums over the ranges find the
range in which a source's budget ends, that range is cut again while it holds many rows, and only
the last one is sorted and summed row by row.  The
result of the planning is one row per source: full epochs, the cut position, and the tokens to
take from the document on the cut.  Applying it is a comparison on each row, so texts are never
shuffled, and a source with a third of all rows is as parallel as any other.

Defined results
---------------
* null or empty text: size 0, nothing taken, and its copies in a realised mix are those of its
  place in the key order;
* null source: a source of its own, after all others;
* sources without tokens: target 0;
* equal keys (equal or null ids) are ordered by a digest of the text; rows equal in this too share
  the cut evenly (rounded down), so very many of them cost no more than one;
* empty table: empty result;
* extra columns stay as they are; names that the operator needs are made unique.

The list of sources (one row each: name, tokens) is gathered by the driver, which computes the
targets from it; a mixture is a hand-written list of sources, and the number of documents does
not enter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import WORD, stash, text_of

#: Hex digits of the key that name its range: 16**3 ranges a source.
RANGE_DIGITS = 3
#: Rows of the range of a cut that one task sorts; a larger one is cut by further digits, to the last.
CUT_ROWS = 200_000
PATH_DIGITS = 64  # of key and digest of the text


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; nobody gets over ``most`` times its size, the excess is reshared."""
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    out, left, weight = [0.0] * len(sizes), float(total), float(sum(weights))
    for n, i in enumerate(order):
        level = left / weight if weight > 0 else 0.0
        if most * sizes[i] / weights[i] > level:
            for j in order[n:]:
                out[j] = weights[j] * level
            break
        out[i] = float(most * sizes[i])
        left -= out[i]
        weight -= weights[i]
    return out


def _key_columns(id_col: str, text_col: str, source_col: str, seed: str) -> list[Column]:
    return [
        F.col(source_col).alias("source"),
        F.struct(
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")).alias("key"),
            F.md5(text_of(text_col).cast("binary")).alias("text"),
            F.col(id_col).alias("id"),
        ).alias("place"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
    ]


def plan_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "",
    whole: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """One row per source (source, source_size, target, epochs, cut, cut_rows, cut_part), and the slim keyed table.

    ``whole``: the document on the cut is taken whole if half of it or more fits, else not at all.
    """
    spark = docs.sparkSession
    slim = stash(docs.select(*_key_columns(id_col, text_col, source_col, seed)), "mix")
    path = F.concat("place.key", "place.text")  # in the order of places: the texts' digests part rows of one key

    def spans_of(rows: DataFrame, digits: int) -> DataFrame:
        sums = rows.groupBy("source", F.substring(path, 1, digits).alias("span")).agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
        return stash(sums, "mix-spans")

    spans = spans_of(slim, RANGE_DIGITS)
    rows = sorted(spans.groupBy("source").agg(F.sum("tokens").alias("n")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["n"] for r in rows]
    ws = [float(weights[i % len(weights)]) for i in range(len(rows))]
    goal = targets(sizes, ws, share * sum(sizes), most)
    listed = []
    for r, size, t in zip(rows, sizes, goal, strict=True):
        epochs = min(int(t // size), int(most)) if size else 0
        listed.append((r["source"], size, t, epochs, math.floor(t - epochs * size) if epochs < most else 0))
    kind = docs.schema[source_col].dataType.simpleString()
    budget = spark.createDataFrame(listed, f"source {kind}, source_size long, target double, epochs long, rest long")
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    run = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 16 ** RANGE_DIGITS rows a source at most

    def cut_spans(wanted: list[tuple], spans: DataFrame) -> list[tuple]:
        """(source, span, rest inside it, rows): where the rest of each source (``wanted``: source, rest) ends."""
        ends = spans.select("source", "span", "tokens", "n", F.sum("tokens").over(run).alias("upto"))
        rest = spark.createDataFrame(wanted, f"source {kind}, rest long")
        hit = rest.alias("a").join(ends.alias("b"), same & (F.col("rest") > F.col("upto") - F.col("tokens")) & (F.col("rest") <= F.col("upto")))
        return [tuple(r) for r in hit.select("a.source", "span", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("rest"), "n").collect()]

    def inside_of(hits: list[tuple], digits: int) -> DataFrame:
        """Rows of the one range of each source in which its budget ends."""
        few = spark.createDataFrame([h[:3] for h in hits], f"source {kind}, span string, inside long")  # a row a source: as bounded as the list above
        return slim.withColumn("span", F.substring(path, 1, digits)).alias("a").join(F.broadcast(few).alias("b"), same & (F.col("a.span") == F.col("b.span")))

    hits, ready, digits = cut_spans([(x[0], x[4]) for x in listed], spans) if listed else [], [], RANGE_DIGITS
    while hits:
        ready += [(*h[:3], digits) for h in hits if h[3] <= CUT_ROWS or digits >= PATH_DIGITS]
        hits = [h for h in hits if h[3] > CUT_ROWS and digits < PATH_DIGITS]
        if hits:  # too many rows for one task: the range is cut again
            wide = inside_of(hits, digits).select("a.source", "place", "size")
            digits = min(digits + RANGE_DIGITS, PATH_DIGITS)
            hits = cut_spans([(h[0], h[2]) for h in hits], spans_of(wide, digits))
    found = slim.select("source", "place", "size", F.lit(0).cast("long").alias("inside")).limit(0)
    for d in sorted({r[3] for r in ready}):
        found = found.unionByName(inside_of([r for r in ready if r[3] == d], d).select("a.source", "place", "size", "inside"))
    near = found.groupBy("source", "place").agg(F.first("inside").alias("inside"), F.first("size").alias("size"), F.count("*").alias("rows"))
    run = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("upto", F.sum(F.col("size") * F.col("rows")).over(run)).withColumn("part", F.col("inside") - F.col("upto") + F.col("size") * F.col("rows"))
    near = near.where((F.col("part") > 0) & (F.col("inside") <= F.col("upto")))
    part = F.expr("part div rows")
    if whole:
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(0)
    cuts = near.select("source", F.col("place").alias("cut"), part.cast("long").alias("cut_part"))
    plan = budget.alias("a").join(cuts.alias("b"), same, "left").select("a.source", "source_size", "target", "epochs", "cut", F.coalesce("cut_part", F.lit(0)).alias("cut_part"))
    return stash(plan, "mix-plan"), slim


def _taken(size: Column, part: Column) -> Column:
    at = F.when(F.col("cut").isNull(), 0).when(F.col("place") < F.col("cut"), size).when(F.col("place") == F.col("cut"), part).otherwise(0)
    return F.col("epochs") * size + at


def _with_plan(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    return keyed.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row."""
    plan, slim = plan_mix(docs, **options)
    taken = _taken(F.col("size"), F.col("cut_part")).cast("long")
    return _with_plan(slim, plan).select(F.col("place.id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "", **options) -> DataFrame:
    """The mix itself, of whole documents: each row as often as the mix takes it, with the columns of ``docs``."""
    plan, _ = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, whole=True, **options)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    copies = _taken(F.lit(1), F.signum("cut_part")).cast("int")
    mixed = _with_plan(docs.select(row, *_key_columns(id_col, text_col, source_col, seed)), plan)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")
