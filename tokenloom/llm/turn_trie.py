"""Prefix trie of conversations by MSD radix partitioning and multikey quicksort.

Turns (role, text) are dictionary-encoded: the distinct ones are ordered once, and a turn's id is its place.
Conversations become rows (conversation, place, turn id); texts travel no further.  Equal conversations are
merged first, so what remains of a hot group of copies is one sequence with a weight.

All sequences start in one bucket, the root's.  A round of the radix partitioning takes the buckets of the
round before, finds by one aggregation how far the members of each agree (that chain of nodes is emitted at
once, however long), and deals each bucket by the next turn id.  A new bucket with up to ``local_cells``
turns left is local: a task finishes it with multikey quicksort over the turn ids, whose "equal" branches are
the nodes below.  Larger ones go to the next round.  Sums over subtrees are then carried up round by round;
inside a chain they come from running sums of text bytes, so no chain is ever walked.

The digest of the members that end at a node goes over their ids in order.  They are sorted in ranges, each
task packs its part of a list into pieces of text, and the pieces of a list are hashed one after the other.

Defined results: rows without a conversation id are left out; null role or text is empty; turns are ordered
by turn (null first), then role, then text, so equal rows change nothing but the number of turns; null turns
of one conversation are ties like others; an empty table has no conversation, so no node, not even the root;
texts of any length are read whole; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.ordering import global_index, running_before
from tokenloom.llm.common import stash

#: Turns of a bucket that one task sorts.
LOCAL_CELLS = 4096
#: Turns, of as many buckets as they make, that are sorted in one go.
BATCH_CELLS = 65_536
#: Bytes of a packed piece of a list of members.
PIECE_BYTES = 1 << 20
#: Turns of the shared beginning: fewer than this.
SPLICES = 9
GROUP = 5

NODE = "conv_id long, depth long, up long, n_convs long, n_children long, n_leaves long, saved_tokens long, ended long"


def encoded(conversations: DataFrame) -> DataFrame:
    """conv, k (from 1), turn_id, n_bytes of every turn, in order; texts are dropped."""
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    empty = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", *empty)
    rows = rows.withColumn("key", F.unhex(key))
    words = global_index(rows.groupBy("key").agg(F.first("role").alias("role"), F.first("text").alias("text")), ["role", "text"], "turn_id").select("key", "turn_id")
    turns = rows.select("conv", "turn", "key", F.octet_length("text").cast("long").alias("n_bytes")).join(words, "key").drop("key")
    order = ["conv", F.asc_nulls_first("turn"), "turn_id"]
    placed = stash(global_index(turns, order, "at").drop("turn"), "turns")
    firsts = placed.groupBy("conv").agg(F.min("at").alias("first"))
    return placed.join(firsts, "conv").select("conv", (F.col("at") - F.col("first") + 1).alias("k"), "turn_id", "n_bytes")


def shared_turns(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % SPLICES).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, turn_id, n_bytes) of the rebuilt conversations, and (conv, length) of all of them."""
    sizes = stash(turns.groupBy("conv").agg(F.max("k").alias("own")), "conversations")
    base = F.col("conv") - F.col("conv") % GROUP
    convs = sizes.withColumn("base", base).withColumn("h", shared_turns(F.col("conv")))
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("own").alias("there")), "base", "left")
    convs = stash(convs.select("conv", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"), F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("more")), "splices")
    head = turns.where(F.col("k") < SPLICES).withColumnRenamed("conv", "base").join(convs.select("conv", "base", "h"), "base").where("k <= h")
    tail = turns.join(convs.select("conv", "h", "taken"), "conv").where("k > h")
    rows = head.select("conv", F.col("k").alias("pos"), "turn_id", "n_bytes").unionByName(tail.select("conv", (F.col("taken") + F.col("k") - F.col("h")).alias("pos"), "turn_id", "n_bytes"))
    return stash(rows, "rebuilt"), convs.select("conv", (F.col("taken") + F.col("more")).alias("length"))


def merged(rows: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, weight, length, pos, turn_id, n_bytes, cum) of the different sequences, with a place 0, and (rep, conv) of all conversations.

    rep: the smallest conversation with the sequence; cum: bytes up to this place.
    """
    prints = [F.sum(F.xxhash64(F.lit(salt), "pos", "turn_id").cast("decimal(38,0)")).alias(f"print{salt}") for salt in (1, 2)]
    same = lengths.join(rows.groupBy("conv").agg(*prints), "conv", "left").select("conv", "length", *[F.coalesce(f"print{s}", F.lit(0).cast("decimal(38,0)")).alias(f"print{s}") for s in (1, 2)])
    same = stash(same, "prints")
    kinds = ["length", "print1", "print2"]
    reps = same.groupBy(*kinds).agg(F.min("conv").alias("rep"), F.count("*").alias("weight"))
    members = stash(same.join(reps, kinds).select("rep", "conv", "weight"), "members")
    own = reps.select("rep", "weight", "length")
    cells = rows.withColumnRenamed("conv", "rep").join(own, "rep")
    start = own.select("rep", "weight", "length", F.lit(0).cast("long").alias("pos"), F.lit(-1).cast("long").alias("turn_id"), F.lit(0).cast("long").alias("n_bytes"))
    cells = running_before(cells.unionByName(start), F.col("n_bytes"), ["rep", "pos"], "before")
    return cells.select("rep", "weight", "length", "pos", "turn_id", "n_bytes", (F.col("before") + F.col("n_bytes")).alias("cum")), members


def radix_round(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round over buckets; ``cells``: rows of ``merged`` with bucket (its smallest conversation), depth and up.

    Returns (chains: bucket, depth, up, last, n_convs, n_children, ended), (nodes of the chains), and the cells of the new buckets
    with ``left``, the turns in their bucket.
    """
    size = cells.where("pos = depth").groupBy("bucket", "depth").agg(F.count("*").alias("size"), F.sum("weight").alias("n_convs"), F.first("up").alias("up"))
    agree = cells.groupBy("bucket", "depth", "pos").agg(F.count("*").alias("n"), F.min("turn_id").alias("lo"), F.max("turn_id").alias("hi"))
    parts = agree.join(size, ["bucket", "depth"]).groupBy("bucket", "depth", "up", "size", "n_convs")
    first_apart = F.min(F.when((F.col("lo") != F.col("hi")) | (F.col("n") < F.col("size")), F.col("pos")))
    chains = stash(parts.agg((F.coalesce(first_apart, F.max("pos") + 1) - 1).alias("last")), "chains")
    marked = cells.join(chains.select("bucket", "depth", "last", "n_convs"), ["bucket", "depth"])

    heads = marked.where("pos = last + 1").groupBy("bucket", "depth", "turn_id").agg(F.min("rep").alias("head"), F.sum(F.col("length") - F.col("last")).alias("left"))
    ends = marked.where("pos = last and length = last").groupBy("bucket", "depth").agg(F.min("rep").alias("ended"))
    kids = heads.groupBy("bucket", "depth").agg(F.count("*").alias("n_children"))
    chains = stash(chains.join(kids, ["bucket", "depth"], "left").join(ends, ["bucket", "depth"], "left").fillna(0, ["n_children"]), "chains")

    top = marked.where("rep = bucket and pos = last").select("bucket", "depth", F.col("cum").alias("cum_last"))
    along = marked.where("rep = bucket and pos <= last").join(top, ["bucket", "depth"])
    last = F.col("pos") == F.col("last")
    nodes = along.join(chains.select("bucket", "depth", "n_children", "ended"), ["bucket", "depth"]).select(
        F.col("bucket").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("depth"), F.col("up")).otherwise(F.col("bucket")).alias("up"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), F.when(last, F.col("ended")).alias("ended"),
        ((F.col("n_convs") - 1) * (F.col("cum_last") - F.col("cum") + F.col("n_bytes"))).alias("chain_saved"), F.col("bucket").alias("of"), F.col("depth").alias("of_depth"),
    )
    goes = marked.where("pos = last + 1").select("rep", F.col("bucket").alias("was"), F.col("depth").alias("was_depth"), "turn_id")
    goes = goes.join(heads.select(F.col("bucket").alias("was"), F.col("depth").alias("was_depth"), "turn_id", "head", "left"), ["was", "was_depth", "turn_id"]).drop("turn_id", "was_depth")
    below = marked.where("pos > last").drop("bucket", "up", "n_convs").withColumn("depth", F.col("last") + 1).drop("last")
    return chains, stash(nodes, "nodes"), stash(below.join(goes, "rep").withColumnRenamed("head", "bucket").withColumnRenamed("was", "up"), "buckets")


def multikey(sequences: list[tuple[int, int, int, list[int], list[int]]]) -> list[list]:
    """Nodes [conv, depth, parent's place or -1, n_convs, n_children, n_leaves, saved, ended] of the tries of sequences.

    A sequence is (rep, weight, depth of its first symbol, symbols, bytes); its symbols start with the bucket's.
    Three-way radix quicksort: the part that equals the pivot at a place is the node of that symbol.
    """
    nodes: list[list] = []

    def chain(s: tuple, at: int, parent: int) -> None:
        rep, weight, depth, symbols, sizes = s
        if parent >= 0:
            nodes[parent][4] += 1
        for p in range(at, len(symbols)):
            nodes.append([rep, depth + p, parent if p == at else len(nodes) - 1, weight, int(p + 1 < len(symbols)), 0, (weight - 1) * sizes[p], rep if p + 1 == len(symbols) else None])

    todo: list[tuple[list, int, int]] = [(sequences, 0, -1)]
    while todo:
        part, at, parent = todo.pop()
        while part:
            if len(part) == 1:
                chain(part[0], at, parent)
                break
            pivot = part[len(part) // 2][3][at]
            below, above, equal = [], [], []
            for s in part:
                x = s[3][at]
                (equal if x == pivot else below if x < pivot else above).append(s)
            for other in (below, above):
                if other:
                    todo.append((other, at, parent))
            if len(equal) == 1:
                chain(equal[0], at, parent)
                break
            if parent >= 0:
                nodes[parent][4] += 1
            n = sum(s[1] for s in equal)
            ended = next((s[0] for s in equal if len(s[3]) == at + 1), None)
            nodes.append([min(s[0] for s in equal), equal[0][2] + at, parent, n, 0, 0, (n - 1) * equal[0][4][at], ended])
            part, at, parent = [s for s in equal if len(s[3]) > at + 1], at + 1, len(nodes) - 1
    for x in reversed(nodes):  # children come after their parents
        if not x[4]:
            x[5] = 1
        if x[2] >= 0:
            nodes[x[2]][5] += x[5]
            nodes[x[2]][6] += x[6]
    return nodes


def finish_local(cells: DataFrame, batch_cells: int = BATCH_CELLS) -> DataFrame:
    """NODE rows of small buckets: dealt by bucket, sorted, and finished many at a time."""
    schema = pa.schema([(c.split()[0], pa.int64()) for c in NODE.split(", ")])

    def sort(ups: dict, sequences: list) -> pa.RecordBatch:
        nodes = multikey(sequences)
        conv = [x[0] for x in nodes]
        up = [conv[x[2]] if x[2] >= 0 else ups[x[0], x[1]] for x in nodes]
        columns = [conv, [x[1] for x in nodes], up, *[[x[k] for x in nodes] for k in (3, 4, 5, 6, 7)]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ups: dict[tuple[int, int], int] = {}
        sequences: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(8)]
            for bucket, depth, up, rep, weight, pos, turn, size in zip(*columns, strict=True):
                if (bucket, depth) != last:
                    if held >= batch_cells:
                        yield sort(ups, sequences)
                        ups, sequences, held = {}, [], 0
                    last = bucket, depth
                    ups[last] = up
                if pos == depth:  # the first symbol names the bucket, so that several are sorted together
                    sequences.append((rep, weight, depth, [(bucket, depth)], [size]))
                else:
                    sequences[-1][3].append(turn)
                    sequences[-1][4].append(size)
                held += 1
        if sequences:
            yield sort(ups, sequences)

    dealt = cells.select("bucket", "depth", "up", "rep", "weight", "pos", "turn_id", "n_bytes").repartition("bucket", "depth")
    return dealt.sortWithinPartitions("bucket", "depth", "rep", "pos").mapInArrow(run, NODE)


def carried_up(rounds: list[tuple[DataFrame, DataFrame]], local: DataFrame) -> DataFrame:
    """NODE rows of all rounds; sums of subtrees from the last round to the first."""
    local = stash(local, "local-nodes")
    tops = local.select(F.col("up").alias("of_up"), F.col("depth").alias("of_d"), "conv_id", "n_leaves", "saved_tokens")
    out, below = local, None
    for chains, nodes in reversed(rounds):
        at = chains.select("bucket", "depth", "last")
        kids = tops if below is None else tops.unionByName(below)
        # A child of a bucket starts one turn below the end of the bucket's chain and names it as its parent.
        sums = at.join(kids.where("of_up is not null"), (F.col("bucket") == F.col("of_up")) & (F.col("of_d") == F.col("last") + 1))
        sums = sums.groupBy("bucket", "depth").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        full = nodes.join(sums.withColumnRenamed("bucket", "of").withColumnRenamed("depth", "of_depth"), ["of", "of_depth"], "left")
        full = full.select("conv_id", "depth", "up", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (F.col("chain_saved") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), "ended", (F.col("depth") == F.col("of_depth")).alias("top"))
        full = stash(full, "summed")
        below = full.where("top").select(F.col("up").alias("of_up"), F.col("depth").alias("of_d"), "conv_id", "n_leaves", "saved_tokens")
        out = out.unionByName(full.drop("top"))
    return out


def ends_digests(members: DataFrame) -> DataFrame:
    """(ended, ends_sha256): the digest of the sorted ids of all conversations with the sequence of ``rep``."""
    alone = members.where("weight = 1").select(F.col("rep").alias("ended"), F.sha2(F.col("conv").cast("string").cast("binary"), 256).alias("ends_sha256"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        size, rep, first = 0, None, None
        piece = lambda: pa.RecordBatch.from_pydict({"rep": [rep], "first": [first], "ids": [",".join(held)]})
        for batch in batches:
            for r, c in zip(*[batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(2)], strict=True):
                if held and (r != rep or size >= PIECE_BYTES):
                    yield piece()
                    held, size = [], 0
                if not held:
                    rep, first = r, c
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, running = None, None
        done = lambda: pa.RecordBatch.from_pydict({"ended": [rep], "ends_sha256": [running.hexdigest()]})
        for batch in batches:
            for r, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if r != rep:
                    if running is not None:
                        yield done()
                    rep, running = r, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.encode())
        if running is not None:
            yield done()

    several = members.where("weight > 1").select("rep", "conv").repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv")
    pieces = several.mapInArrow(pack, "rep long, first long, ids string")
    return alone.unionByName(pieces.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(digest, "ended long, ends_sha256 string"))


def trie(conversations: DataFrame, *, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    cells, members = merged(*rebuilt(encoded(conversations)))
    smallest = members.agg(F.min("conv").alias("m")).collect()[0]["m"]
    root = F.lit(smallest).cast("long")
    todo = stash(cells.withColumn("bucket", root).withColumn("depth", F.lit(0).cast("long")).withColumn("up", F.lit(None).cast("long")), "buckets")
    rounds, small = [], []
    while smallest is not None and not todo.isEmpty():
        chains, nodes, split = radix_round(todo)
        rounds.append((chains, nodes))
        small.append(split.where(F.col("left") <= local_cells).drop("left"))
        todo = split.where(F.col("left") > local_cells).drop("left")
    local = todo.select(*todo.columns)
    for s in small:
        local = local.unionByName(s)
    nodes = carried_up(rounds, finish_local(local))
    ended = nodes.where("ended is not null").join(ends_digests(members), "ended")
    passed = nodes.where("ended is null").withColumn("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return ended.unionByName(passed).select("conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
