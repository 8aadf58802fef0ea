"""Near-duplicate documents by BagMinHash signatures of weighted shingles.

A document is the multiset of its five-word shingles.  Each shingle has a Poisson process for each
dyadic interval (0, 1], (1, 2], (2, 4], ... of weights, seeded by shingle and interval; a point has a
time, a signature place and a height inside the interval, found by halving.  A document sees the
points of its shingles with height up to their weight, and keeps the earliest time per place, so
two documents agree in a place with probability equal to their weighted Jaccard similarity.  Points
are made in order of time and only while they can still matter: first up to a bound that fills
nearly all signatures, then further for those with empty places.

Equal contents (sequence of words) are merged first and never compared with each other.  Signatures
are banded; in every band bucket all contents are verified (exact multiset overlap) against a few
hubs, drawn by different hash orders, which joins almost all true groups with a number of pairs
linear in the bucket.  What is then still outside its hub's component is compared pair by pair with
the bucket inside bounded blocks, skipping what is joined meanwhile, so no link between different
texts that share a band is lost and no bucket is ever expanded into all pairs.  Frequent buckets
and hubs with many members are dealt to many tasks.

Defined results
---------------
* words are runs of anything but ASCII white space, ASCII letters in lower case; a text with one to
  four words has one shingle, all of it;
* null, empty and blank texts have no shingles: each such row is its own class;
* the class id is the least id of the class; rows of equal id are kept apart by content; rows with
  a null id take the class of their content (null if nobody in it has an id);
* one row of each class is kept: known ids first, the least id, then the least digest of the text;
  rows repeated in id and text are marked alike, and ``drop_near_copies`` keeps one of them;
* empty table: empty result; other columns pass through in ``drop_near_copies``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tokenloom.llm.common import stash, text_of
from tokenloom.llm.components import BLOCK_ROWS, components, join_by_key, map_groups

SHINGLE = 5
PLACES, ROWS = 96, 4  # signature places, places of a band
LEAST = 0.8
HUBS = 3
_SLICE = 1_500_000  # characters of text in a batch of the signature kernel
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shifts and odd multipliers)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs."""
    n = len(words)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.fromiter(map(xxh3_64_intdigest, words), _U, n)
    width = min(n, SHINGLE)
    s = np.full(n - width + 1, width, _U)
    for k in range(width):
        s = _mix(s + h[k : n - width + 1 + k])
    return np.unique(s, return_counts=True)


def content_of(words: Sequence[bytes]) -> str:
    return hashlib.blake2b(b" ".join(words), digest_size=16).hexdigest()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - low
    return low / total if total else 0.0


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(float) + 0.5) * 2.0**-53


def signatures(docs: Sequence[tuple[np.ndarray, np.ndarray]], places: int = PLACES) -> np.ndarray:
    """BagMinHash signatures (documents x places) of non-empty multisets, as times of points."""
    hashes, weights = np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs])
    owner = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
    seeds, low, width, height, doc = [], [], [], [], []
    level, lo = 0, 0
    while len(hashes):
        hi = 1 << level
        seeds.append(_mix(hashes + _U(0x9E3779B97F4A7C15 * (level + 1) % 2**64)))
        low.append(np.full(len(hashes), lo))
        width.append(np.full(len(hashes), hi - lo))
        height.append(weights)
        doc.append(owner)
        more = weights > hi
        hashes, weights, owner, lo, level = hashes[more], weights[more], owner[more], hi, level + 1
    seeds, low, width, height, doc = (np.concatenate(x) for x in (seeds, low, width, height, doc))
    out = np.full((len(docs), places), np.inf)
    flat = out.ravel()
    load = np.bincount(doc, width, len(docs))
    bound = (np.log(places) + 2.0) / load
    time, count = np.zeros(len(seeds)), np.zeros(len(seeds), np.int64)
    live = np.arange(len(seeds))  # processes whose next point may matter

    def step(at: np.ndarray) -> np.ndarray:
        """Time of the next point of each process."""
        r = _mix(seeds[at] + count[at].astype(_U) * _U(0xD1342543DE82EF95))
        time[at] -= np.log(_uniform(r)) / (width[at] * float(places))
        return r

    rand = np.zeros(len(seeds), _U)
    rand[live] = step(live)
    waiting = live
    while len(waiting):
        at = waiting[time[waiting] <= bound[doc[waiting]]]
        while len(at):
            r = _mix(rand[at] ^ _U(0x5851F42D4C957F2D))
            place = (r % _U(places)).astype(np.int64)
            tall = low[at] + 1 + ((r >> _U(20)).astype(np.int64) & (width[at] - 1))
            seen = tall <= height[at]
            np.minimum.at(flat, doc[at[seen]] * places + place[seen], time[at[seen]])
            count[at] += 1
            rand[at] = step(at)
            at = at[time[at] <= bound[doc[at]]]
        worst = out.max(axis=1)
        open_docs = worst > bound
        bound = np.where(open_docs, bound * 2, bound)
        waiting = waiting[open_docs[doc[waiting]]]
    return out


def bands_of(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Band keys (documents x bands), the band's number mixed in."""
    bits = np.ascontiguousarray(signature).view(_U).reshape(len(signature), -1, rows)
    key = np.broadcast_to(np.arange(bits.shape[1], dtype=_U), bits.shape[:2]).copy()
    for k in range(rows):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + bits[:, :, k])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content, bands) of each row, nulls without words."""
    for batch in batches:
        at = 0
        texts = batch.column(batch.num_columns - 1)
        while at < batch.num_rows:
            contents, sets, where, chars, end = [], [], [], 0, at
            while end < batch.num_rows and chars < _SLICE:
                text = texts[end].as_py()
                words = words_of(text)
                contents.append(content_of(words) if words else None)
                if words:
                    where.append(end - at)
                    sets.append(shingles(words))
                chars += len(text or "")
                end += 1
            bands: list = [None] * (end - at)
            if sets:
                for i, b in zip(where, bands_of(signatures(sets)), strict=True):
                    bands[i] = b
            part = batch.slice(at, end - at)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(contents, pa.string()), pa.array(bands, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "content", "bands"])
            at = end


_PAIR = pa.schema([("a", pa.string()), ("b", pa.string())])


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last = None, None
        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(*[batch.column(i) for i in range(4)], strict=True):
                t = t.as_py()
                if t != last_text:
                    last_text, last = t, shingles(words_of(t))
                if similarity(shingles(words_of(s.as_py())), last) >= least:
                    a.append(x.as_py())
                    b.append(y.as_py())
            if a:
                yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=_PAIR)

    return run


def _rest(least: float):
    """Pairs of a group of blocks that are still apart, joined as they are found."""

    def run(group: pa.RecordBatch) -> pa.RecordBatch | None:
        node, root, own = (group.column(c).to_pylist() for c in ("node", "root", "own"))
        i, j = group.column("block_i")[0].as_py(), group.column("block_j")[0].as_py()
        if len(set(root)) < 2:
            return None
        bucket = group.column("bucket")[0].as_py()
        bands = [set(x) for x in group.column("bands").to_pylist()]
        bags = [shingles(words_of(t)) for t in group.column("text").to_pylist()]
        size = [int(x[1].sum()) for x in bags]
        up = {r: r for r in root}

        def find(x: str) -> str:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        left = [k for k in range(len(node)) if own[k] == i]
        right = sorted((k for k in range(len(node)) if own[k] == j), key=size.__getitem__)
        sizes = np.array([size[k] for k in right])
        a, b = [], []
        for p in left:
            for q in right[np.searchsorted(sizes, size[p] * least) : np.searchsorted(sizes, size[p] / least, "right")]:
                if find(root[p]) != find(root[q]) and min(bands[p] & bands[q]) == bucket and similarity(bags[p], bags[q]) >= least:
                    a.append(node[p])
                    b.append(node[q])
                    up[find(root[p])] = find(root[q])
        return pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=_PAIR) if a else None

    return run


def _best(id_col: str = "id") -> Column:
    """Orders rows of a content: known ids first, by id, then by a digest of the text."""
    return F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), F.col("digest"))


def _deal(rows: DataFrame, total: int) -> DataFrame:
    """Rows of buckets (bucket, node, root, root0, ...) that hold several roots, dealt to pairs of blocks.

    Rows of the hub's component (root0) are apart from the others at most, so only pairs with one of the others are made:
    blocks of those (0, 1, ...) with each other and with blocks of the component (-1, -2, ...).
    """
    other = F.col("root") != F.col("root0")
    sizes = rows.groupBy("bucket").agg(F.count_if(other).alias("others"), F.count("*").alias("c")).where("others > 0")
    blocks = lambda n: F.ceil(n / (BLOCK_ROWS // 4)).cast("int")
    sizes = stash(sizes.select("bucket", "c", blocks(F.col("others")).alias("m"), blocks(F.col("c") - F.col("others")).alias("k")), "bucket-parts", total // 2)
    dealt = join_by_key(rows, sizes, ["bucket"], "c", total)
    own = F.when(other, F.pmod(F.xxhash64("node"), F.col("m"))).otherwise(-1 - F.pmod(F.xxhash64("node"), F.col("k"))).cast("int")
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda x: x < n)
    partners = F.when(other, F.concat(upto(F.col("m")), F.transform(upto(F.col("k")), lambda x: -1 - x))).otherwise(upto(F.col("m")))
    dealt = dealt.withColumn("own", own).withColumn("partner", F.explode(partners))
    both = (F.col("own") >= 0) & (F.col("partner") >= 0)
    first = F.when(both, F.least("own", "partner")).otherwise(F.greatest("own", "partner"))
    second = F.when(both, F.greatest("own", "partner")).otherwise(F.least("own", "partner"))
    return dealt.select("bucket", "node", "root", "own", first.alias("block_i"), second.alias("block_j"))


def _links(contents: DataFrame, docs: DataFrame, id_col: str, text_col: str, least: float, rows: int) -> DataFrame:
    """Links (a, b) between contents that connect all contents of similarity ``least`` or more; ``rows``: contents at most."""
    bands = PLACES // ROWS
    entries = contents.select("content", F.explode("bands").alias("bucket"))
    hubs = [F.min_by("content", F.xxhash64(F.lit(k), "content")).alias(f"h{k}") for k in range(HUBS)]
    buckets = stash(entries.groupBy("bucket").agg(*hubs, F.count("*").alias("c")).where("c > 1"), "buckets", rows)
    members = stash(join_by_key(entries, buckets, ["bucket"], "c", bands * rows), "bucket-members", rows)
    wanted = contents.select("content", "best").join(members.select("content").distinct(), "content", "left_semi")
    keyed = docs.select(F.col(id_col).alias("id"), F.md5(text_of(text_col).cast("binary")).alias("digest"), F.col(text_col).alias("text"))
    same = F.col("best.digest").eqNullSafe(F.col("digest")) & F.col("best.id").eqNullSafe(F.col("id"))
    texts = stash(keyed.join(wanted, same).groupBy("content").agg(F.first("text").alias("text")), "bucket-texts", rows)

    # A hub of many members goes to several tasks, each with some of them.
    pairs = members.select("content", "c", F.explode(F.array(*[f"h{k}" for k in range(HUBS)])).alias("hub")).where("content <> hub")
    pairs = pairs.groupBy("content", "hub").agg(F.max("c").alias("c")).withColumn("part", F.pmod(F.xxhash64("content"), F.ceil(F.col("c") / BLOCK_ROWS)))
    parts = pairs.groupBy("hub").agg(F.max("c").alias("c")).select("hub", F.explode(F.sequence(F.lit(0), F.ceil(F.col("c") / BLOCK_ROWS) - 1)).alias("part"))
    hub_texts = parts.join(texts.select(F.col("content").alias("hub"), F.col("text").alias("tb")), "hub")
    with_text = pairs.select("content", "hub", "part").join(texts.withColumnRenamed("text", "ta"), "content").join(hub_texts, ["hub", "part"])
    links = stash(with_text.select("content", "hub", "ta", "tb").mapInArrow(_verify(least), "a string, b string"), "links")

    roots = components(links)
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    placed = members.select("bucket", F.col("content").alias("node"), "h0").join(root_of("node"), "node", "left").join(root_of("h0"), "h0", "left")
    placed = placed.select("bucket", "node", F.coalesce("root_node", "node").alias("root"), F.coalesce("root_h0", "h0").alias("root0"))
    known = contents.select(F.col("content").alias("node"), "bands").join(texts.withColumnRenamed("content", "node"), "node")
    dealt = _deal(placed, bands * rows).join(known, "node")
    more = stash(map_groups(dealt, ["bucket", "block_i", "block_j"], _rest(least), "a string, b string"), "more-links")
    return links.unionByName(more)


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """id, digest (of the text), class_id and best (the row of the class that stays, null without words) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), F.md5(text_of(text_col).cast("binary")).alias("digest"), F.col(text_col).alias("text"))
    signed = stash(keyed.mapInArrow(_sign, f"id {kind}, digest string, content string, bands array<bigint>"), "signatures")
    contents = signed.where("content is not null").groupBy("content").agg(F.first("bands").alias("bands"), F.min(_best()).alias("best"))
    rows = signed.count()
    contents = stash(contents, "contents", rows)
    roots = components(_links(contents, docs, id_col, text_col, least, rows)).withColumnRenamed("node", "content")
    groups = contents.select("content", "best").join(roots, "content", "left").withColumn("root", F.coalesce("root", "content"))
    bests = groups.groupBy("root").agg(F.min("best").alias("best"))
    groups = groups.select("content", "root").join(bests, "root").drop("root")
    out = signed.select("id", "digest", "content").join(groups, "content", "left")
    return out.select("id", "digest", F.when(F.col("content").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("class_id"), "best")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """id_col, class_id and kept of every row."""
    got = classes(docs, id_col=id_col, text_col=text_col, least=least)
    return got.select(F.col("id").alias(id_col), "class_id", (F.col("best").isNull() | (_best() == F.col("best"))).alias("kept"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row of each class (and all without words), with the columns of ``docs``."""
    got = classes(docs, id_col=id_col, text_col=text_col, least=least)
    staying = got.where(F.col("best").isNull() | (_best() == F.col("best")))
    staying = staying.groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).agg(F.count("*").alias("twins"), F.first("best").alias("_best"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.md5(text_of(text_col).cast("binary")).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    kept = keyed.join(staying, same)
    one = (F.col("twins") == 1) | F.col("_best").isNull()
    repeated = kept.where(~one).groupBy("id", "digest").agg(F.first("row").alias("row"))
    return kept.where(one).select("row").unionByName(repeated.select("row")).select("row.*")
