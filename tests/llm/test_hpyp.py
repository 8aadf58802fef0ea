import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from fixtures import no_documents, odd_documents, rows
from pyspark.sql import functions as F

from tokenloom.llm import common, hpyp, queries

class Seating:
    """Customers of many dishes at tables, one by one."""

    def __init__(self, customers: np.ndarray, rng: np.random.Generator):
        self.n, self.rng = customers.astype(np.int64), rng
        self.first = np.cumsum(self.n) - self.n
        self.table = np.arange(self.n.sum())  # table of each customer: one of the places of its dish
        self.size = np.ones(len(self.table), np.int64)
        self.many = np.flatnonzero(self.n > 1)

    def tables(self) -> np.ndarray:
        if not len(self.n):
            return np.zeros(0, np.int64)
        return np.add.reduceat(np.append(self.size > 0, False), self.first).astype(np.int64) * (self.n > 0)

    def seat(self, new: np.ndarray, d: float) -> None:
        """Seat everybody in order, in growing runs; ``new``: weight of a new table for each dish."""
        dishes, at = self.many, 1
        seated = np.ones(len(self.n), np.int64)
        while len(dishes):
            run = np.minimum(max(1, at // 8), self.n[dishes] - at)
            ends = np.cumsum(run)
            who = np.repeat(self.first[dishes] + at, run) + np.arange(ends[-1]) - np.repeat(ends - run, run)
            fresh = new[dishes] / (new[dishes] + at - d * seated[dishes])
            opens = self.rng.random(len(who)) < np.repeat(fresh, run)
            other = np.repeat(self.first[dishes], run) + (self.rng.random(len(who)) * at).astype(np.int64)
            self.table[who] = np.where(opens, who, self.table[other])
            seated[dishes] += np.add.reduceat(opens, ends - run)
            at += max(1, at // 8)
            dishes = dishes[self.n[dishes] > at]
        self.size = np.bincount(self.table, minlength=len(self.table))

    def sweep(self, new: np.ndarray, d: float, most: int) -> None:
        """Gibbs: customers leave and are seated again, one of each dish at a time, ``most`` of a dish."""
        rng, size, table = self.rng, self.size, self.table
        t = self.tables()
        dishes = self.many
        for k in range(most):
            dishes = dishes[self.n[dishes] > k]
            if not len(dishes):
                break
            n, first = self.n[dishes], self.first[dishes]
            who = first + np.where(n <= most, k, (rng.random(len(dishes)) * n).astype(np.int64))
            left = table[who]
            size[left] -= 1
            t[dishes] -= size[left] == 0
            opens = rng.random(len(dishes)) * (new[dishes] + n - 1 - d * t[dishes]) < new[dishes]
            # A new table: the place just emptied, or else any empty one.
            place = np.where(size[left] == 0, left, who)
            todo = np.flatnonzero(opens & (size[place] > 0))
            while len(todo):
                place[todo] = first[todo] + (rng.random(len(todo)) * n[todo]).astype(np.int64)
                todo = todo[size[place[todo]] > 0]
            # An old table: that of another customer, accepted with (size - d) / size.
            todo = np.flatnonzero(~opens)
            while len(todo):
                other = first[todo] + (rng.random(len(todo)) * n[todo]).astype(np.int64)
                at = table[other]
                good = (other != who[todo]) & (rng.random(len(todo)) * size[at] < size[at] - d)
                place[todo[good]] = at[good]
                todo = todo[~good]
            t[dishes] += size[place] == 0
            table[who] = place
            size[place] += 1


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def base_scores(docs, learned):
    c = Counter(t for (_, text), own in zip(docs, learned, strict=True) if own for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return [(i, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t))) for i, t in docs]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    got = {r["doc_id"]: r for r in queries.op1_hpyp_score(spark, sf).collect()}
    want = base_scores(docs, [not held[i] for i, _ in docs])
    assert len(got) == len(want)
    for i, n, known, total, base in want:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    out = [r for r in got.values() if r["held_out"]]
    mean = lambda c: sum(r[c] for r in out) / sum(r["n_tokens"] for r in out)
    assert mean("score") > -3.475  # what interpolated Kneser-Ney smoothing of word pairs reaches; base: -4.067
    again = {r["doc_id"]: r["score"] for r in queries.op1_hpyp_score(spark, sf).collect()}
    assert all(math.isclose(again[i], r["score"], rel_tol=1e-9) for i, r in got.items())


def test_cells_change_nothing(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(hpyp, "BLOCK_BYTES", 50_000)
    key = lambda r: r["id"]
    one = sorted(hpyp.score(docs, F.col("doc_id") % 7 != 2).collect(), key=key)
    monkeypatch.setattr(hpyp, "CELL_CHARS", 150_000)
    many = sorted(hpyp.score(docs, F.col("doc_id") % 7 != 2).collect(), key=key)
    for a, b in zip(one, many, strict=True):
        assert a[:5] == b[:5] and math.isclose(a["base_score"], b["base_score"]) and math.isclose(a["score"], b["score"], rel_tol=1e-9)


def test_gibbs_against_the_exact_number_of_tables():
    """Tables of one dish: the chain must agree with the law t ~ S(n, t) * prod of weights, counted by brute force."""
    n, d, new = 6, 0.6, 0.9
    # Weight of a seating with tables of sizes s: new^t * prod (1-d)(2-d)...(s-1-d).
    law = Counter()

    def grow(sizes, k, w):
        if k == n:
            law[len(sizes)] += w
            return
        grow((*sizes, 1), k + 1, w * new)
        for j, s in enumerate(sizes):
            grow((*sizes[:j], s + 1, *sizes[j + 1 :]), k + 1, w * (s - d))

    grow((1,), 1, new)
    want = np.array([law[t] for t in range(n + 1)]) / sum(law.values())
    s = Seating(np.full(20_000, n), np.random.default_rng(1))
    s.seat(np.full(20_000, new), d)
    for _ in range(8):
        s.sweep(np.full(20_000, new), d, 16)
    t = s.tables()
    assert np.abs(np.bincount(t, minlength=n + 1) / len(t) - want).max() < 0.015
    size = np.bincount(s.table, minlength=len(s.table))
    assert (size == s.size).all()
    assert (np.add.reduceat(size, s.first) == n).all()


def test_probabilities_of_a_context_add_up(spark):
    """Over all learned words and the place for others, in every context."""
    rng = np.random.default_rng(0)
    word = np.repeat(np.arange(50), 4)
    context = np.tile(np.arange(4), 50).astype(np.uint8)
    count = rng.integers(0, 9, 200)
    count[:8] = [900, 0, 3, 1, 0, 0, 0, 0]
    of_word = np.bincount(word, count).astype(np.int64)
    sums = np.zeros(hpyp._HEAD + 2 * 256)
    sums[:6] = count.sum(), (of_word > 0).sum(), (count == 1).sum(), (count == 2).sum(), 3, 2
    sums[6 : 6 + 256] = np.bincount(context, count, 256)
    sums[6 + 256 :] = np.bincount(context, count > 0, 256)
    data = common.dump(np.arange(50, dtype=np.uint64), word.astype(np.int32), context, count, np.arange(4, dtype=np.uint64))
    ((t, t0),) = hpyp.seatings(data, sums, sums[6 + 256 :], sums[1], 2, 1)
    assert ((t <= count) & ((t > 0) == (count > 0))).all()
    tables, d, d0, v = np.bincount(context, t, 256), hpyp.discount(*sums[2:4]), hpyp.discount(3, 2), sums[1]
    p0 = hpyp.parent_probability(np.bincount(word, t), t0, tables.sum(), t0.sum(), v, d0)
    other = hpyp.parent_probability(np.zeros(1), np.zeros(1), tables.sum(), t0.sum(), v, d0)[0]
    assert math.isclose(p0[of_word > 0].sum() + other, 1)
    for u in range(4):
        own = context == u
        p = (count[own] - d * t[own] + (hpyp.STRENGTH + d * tables[u]) * p0) / (hpyp.STRENGTH + sums[6 + u])
        assert math.isclose(p[of_word > 0].sum() + (hpyp.STRENGTH + d * tables[u]) * other / (hpyp.STRENGTH + sums[6 + u]), 1)


def test_odd_rows(spark, monkeypatch):
    docs = [(r[0], r[1]) for r in rows()]
    learned = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True))
    own = [i is None or i % 3 != 1 for i, _ in docs]
    want = sorted(base_scores(docs, own), key=repr)
    for size in (hpyp.BLOCK_BYTES, 500):
        monkeypatch.setattr(hpyp, "BLOCK_BYTES", size)
        got = hpyp.score(odd_documents(spark), learned).collect()
        key = lambda w: (repr(w[0]), w[1], w[2], round(w[4], 6))
        for g, w in zip(sorted(((r["id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key), sorted(want, key=key), strict=True):
            assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9, abs_tol=1e-9)
    assert hpyp.score(no_documents(spark), learned).count() == 0
    nothing = hpyp.score(odd_documents(spark), F.lit(False)).collect()
    assert all((r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0) and abs(r["score"]) < 1e-12 for r in nothing)


def test_context_is_the_token_before(spark):
    """Two tokens that end alike are contexts of their own: what follows only the one is likely only after it."""
    texts = ["bonation left"] * 30 + ["carnation right"] * 30 + ["bonation left", "bonation right", "carnation left", "carnation right"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["score"] for r in sorted(hpyp.score(docs, F.col("doc_id") < 60).collect(), key=lambda r: r["id"])][60:]
    assert min(got[0], got[3]) > max(got[1], got[2]) + 1


def test_law_of_tables_of_frequent_words():
    """Drawn numbers of tables against the law t ~ S(n, t) * new^t, counted by the full recursion, with n in the thousands."""
    n, dishes = 3000, 4000
    for d, new in ((0.3, 40.0), (0.6, 0.9), (0.6, 300.0), (0.8, 5000.0), (0.95, 2000.0)):
        ways = np.full(n + 2, -np.inf)
        ways[1] = 0
        for k in range(1, n):
            t = np.arange(1, k + 1)
            old, ways = ways, np.full(n + 2, -np.inf)
            ways[1 : k + 1] = old[1 : k + 1] + np.log(k - d * t)
            ways[2 : k + 2] = np.logaddexp(ways[2 : k + 2], old[1 : k + 1])
        t = np.arange(n + 2)
        law = np.exp(ways + t * np.log(new) - (ways + t * np.log(new)).max())
        law /= law.sum()
        got = hpyp.draw_tables(np.full(dishes, n), np.full(dishes, new), d, np.random.default_rng(1).random(dishes))
        steps = np.bincount(got, minlength=n + 2).cumsum() / dishes
        assert np.abs(steps - law.cumsum()).max() < 0.035  # Kolmogorov: 1.63 / sqrt(4000) = 0.026 at 1 %


def ways(n, d):
    """Weights of all seatings of n customers by their number of tables."""
    out = {1: 1.0}
    for k in range(1, n):
        new = Counter()
        for t, w in out.items():
            new[t] += w * (k - d * t)
            new[t + 1] += w
        out = new
    return out


def drawn(counts, tables, words, all_tables, parent_tables, v, burn_in, samples):
    """Seatings of many words of the same counts, and the discounts and the weight of a new table in the parent."""
    sums = np.zeros(hpyp._HEAD + 1)
    sums[hpyp._V], sums[hpyp._PAIR1], sums[hpyp._PAIR2], sums[hpyp._WORD1], sums[hpyp._WORD2] = v, 6, 2, 3, 2
    d, d0, m = hpyp.discount(6, 2), hpyp.discount(3, 2), len(counts)
    contexts = hpyp._hashed([b"%d" % i for i in range(m)])[:-1]
    data = common.dump(hpyp._hashed([b"w%d" % i for i in range(words)])[:-1], np.repeat(np.arange(words, dtype=np.int32), m), np.tile(np.arange(m, dtype=np.int32), words), np.tile(counts, words), contexts)
    got = [t.reshape(words, m) for t, _ in hpyp.seatings(data, sums, np.array(tables), parent_tables, burn_in, samples, all_tables)]
    return got, d, d0, (hpyp.STRENGTH + d0 * parent_tables) / (v + 1)


@pytest.mark.parametrize("counts", [(3, 2, 4), (3,) * 6, (2, 1, 1, 7)])
def test_joint_law_of_tables_in_two_levels(counts):
    """A word with a few contexts: the chain's numbers of tables against their exact joint law, the parent's seatings summed out."""
    all_tables, tables = 12.0, [2.0, 1.0, 4.0, 3.0, 1.0, 2.0][: len(counts)]
    got, d, d0, base = drawn(counts, tables, 20_000, all_tables, 3.0, 9.0, 6, 2)
    law = {}
    for t in np.ndindex(*counts):
        t = tuple(x + 1 for x in t)
        w = math.prod(ways(c, d)[x] * ((hpyp.STRENGTH + d * m) / (hpyp.STRENGTH + all_tables)) ** x for c, x, m in zip(counts, t, tables, strict=True))
        law[t] = w * sum(x * base**t0 for t0, x in ways(sum(t), d0).items())
    total = sum(law.values())
    seen = Counter(tuple(r) for t in got for r in t.tolist())
    n = sum(seen.values())
    # The mean distance of n draws from their own law is about the sum of sqrt(p / n) * 0.4.
    chance = sum(math.sqrt(w / total / n) for w in law.values()) * 0.4
    assert sum(abs(seen[t] / n - w / total) for t, w in law.items()) / 2 < 1.3 * chance + 0.002
    want = sum(sum(t) * w for t, w in law.items()) / total
    assert abs(sum(sum(t) * c for t, c in seen.items()) / n - want) < 0.03


@pytest.mark.parametrize(("contexts", "customers", "parent_tables", "v"), [(60, 5, 3.0, 9.0), (120, 3, 400.0, 90.0), (50, 9, 0.0, 200.0)])
def test_total_of_tables_of_many_contexts(contexts, customers, parent_tables, v):
    """A word with many contexts: the law of its customers in the parent, by products of polynomials."""
    all_tables, one = 400.0, 3.0
    words = 3000
    got, d, d0, base = drawn((customers,) * contexts, [one] * contexts, words, all_tables, parent_tables, v, 12, 1)
    new = (hpyp.STRENGTH + d * one) / (hpyp.STRENGTH + all_tables)
    tilt = 1.5 * contexts  # a factor for each table, so that products do not underflow
    single = np.array([0.0] + [ways(customers, d)[t] * (new * tilt) ** t for t in range(1, customers + 1)])
    law = np.ones(1)
    for _ in range(contexts):
        law = np.convolve(law, single / single.sum())
    parent, t0 = {1: 0.0}, np.full(len(law), -np.inf)  # logarithms of ways(s, d0)
    for s in range(1, len(law)):
        x = np.array([w + t * math.log(base) for t, w in parent.items()])
        t0[s] = x.max() + math.log(np.exp(x - x.max()).sum())
        parent = {t: np.logaddexp(parent.get(t, -np.inf) + math.log(max(s - d0 * t, 1e-300)), parent.get(t - 1, -np.inf)) for t in range(1, s + 2)}
    with np.errstate(divide="ignore"):
        law = np.log(law) + t0 - np.arange(len(law)) * math.log(tilt)
    law = np.exp(law - law.max())
    law /= law.sum()
    steps = np.bincount(got[0].sum(axis=1), minlength=len(law)).cumsum() / words
    assert np.abs(steps - law.cumsum()).max() < 0.04  # Kolmogorov: 1.63 / sqrt(3000) = 0.03 at 1 %


def test_scores_against_seating_one_by_one(spark):
    """Two levels of restaurants, every customer seated by itself with all totals at hand: the documents' scores come near."""
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    learned = [i % 7 != 2 for i, _ in docs]
    pairs = [[*zip([b"<"] + x[:-1], x, strict=True)] for x in ([b"." if t is None else b"_" + t for t in tokens(text)] for _, text in docs)]
    own = [p for x, use in zip(pairs, learned, strict=True) if use for p in x]
    seen, of_word = Counter(own), Counter(w for _, w in own)
    once = lambda c: hpyp.discount(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    d, d0, v, s = once(seen), once(of_word), len(of_word), hpyp.STRENGTH
    held, rng = Counter(u for u, _ in own), random.Random(1)
    rest, parent, tables, total, n0, t0 = {}, {}, Counter(), 0, 0, 0

    def p0(w):
        sizes = parent.get(w, [])
        return (sum(sizes) - d0 * len(sizes) + (s + d0 * t0) / (v + 1)) / (s + n0)

    def add(sizes, discount, new):
        x = rng.random() * (sum(sizes) - discount * len(sizes) + new)
        for j, size in enumerate(sizes):
            x -= size - discount
            if x < 0:
                sizes[j] += 1
                return False
        sizes.append(1)
        return True

    def remove(sizes):
        j = rng.choices(range(len(sizes)), sizes)[0]
        sizes[j] -= 1
        if sizes[j]:
            return False
        sizes.pop(j)
        return True

    p = Counter()
    for sweep in range(13):
        for u, w in own:
            sizes = rest.setdefault((u, w), [])
            if sweep and remove(sizes):
                tables[u] -= 1
                n0 -= 1
                t0 -= remove(parent[w])
            if add(sizes, d, (s + d * tables[u]) * p0(w)):
                tables[u] += 1
                t0 += add(parent.setdefault(w, []), d0, (s + d0 * t0) / (v + 1))
                n0 += 1
        if sweep >= 5:
            for u, w in {q for x in pairs for q in x}:
                p[u, w] += (seen[u, w] - d * len(rest.get((u, w), [])) + (s + d * tables[u]) * p0(w)) / (s + held[u]) / 8
    got = {r["id"]: r["score"] for r in hpyp.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") % 7 != 2).collect()}
    off = [(got[i] - sum(math.log10(p[q]) for q in x)) / len(x) for (i, _), x in zip(docs, pairs, strict=True)]
    assert max(map(abs, off)) < 0.05
    assert abs(sum(off)) / len(off) < 0.005


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append({r["id"]: r["score"] for r in hpyp.score(docs.repartition(n), F.col("doc_id") % 7 != 2).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert all(math.isclose(x, got[1][i], rel_tol=1e-9) for i, x in got[0].items())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tokenloom")]


def test_shards_send_scores_in_double_precision():
    import pyarrow as pa

    one = lambda *x: common.dump(*[np.array([i], kind) for i, kind in x])
    table = one((1, np.uint64), (0, np.int32), (0, np.int32), (3, np.int64), (0, np.uint64))
    row = [table, table, one((7, np.int64), (1, np.int64), (0, np.uint32), (0, np.int32)), one((2, np.int32), (1, np.int32)), one((3, np.int64), (1, np.int64)), one((2, np.int64))]
    sums = np.array([3, 1, 0, 0, 0, 0, 1], float)
    batch = pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=list("abcdef"))
    (out,) = hpyp._score(sums, np.array([[2.0, 1.0]]))(iter([batch]))
    d = hpyp.discount(0, 0)
    p0 = hpyp.parent_probability(np.array([2]), np.array([1]), 2.0, 1.0, 1.0, d)[0]
    want = math.log10((3 - d * 2 + (hpyp.STRENGTH + d * 2) * p0) / (hpyp.STRENGTH + 3))
    assert math.isclose(common.load(out.column("data")[0].as_py())[3][0], want, rel_tol=1e-14)


def test_a_task_adds_up_its_shards(monkeypatch):
    """Twenty of two blocks come back as one row a block, in memory or in files."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    want = {b: np.zeros((3, 400)) for b in (7, 9)}
    parts = []
    for i in range(20):
        block, at = (7, 9)[i % 2], np.sort(rng.choice(40 * (i + 1), 30, replace=False) % 400)
        at = np.unique(at)
        cols = [rng.integers(0, 9, len(at)), -rng.random(len(at)), -rng.random(len(at))]
        for k in range(3):
            want[block][k, at] += cols[k]
        parts.append((block, common.dump(np.diff(at, prepend=0).astype(np.uint32), cols[0].astype(np.uint32), *cols[1:])))
    batch = pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts]), pa.array([d for _, d in parts], pa.binary())], names=["block", "data"])
    for room in (1 << 23, 100):
        monkeypatch.setattr(hpyp, "ROOM", room)
        out = list(hpyp._added_up(lambda batches: batches)(iter([batch])))
        assert sorted(b.column("block")[0].as_py() for b in out) == [7, 9]
        for b in out:
            gaps, *cols = common.load(b.column("data")[0].as_py())
            got = np.zeros((3, 400))
            got[:, np.cumsum(gaps)] = cols
            assert np.allclose(got, want[b.column("block")[0].as_py()], rtol=1e-12)
