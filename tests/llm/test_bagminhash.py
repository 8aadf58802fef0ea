import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
from fixtures import no_documents, odd_documents, rows

from tokenloom.llm import bagminhash, queries


def bag(text):
    w = bagminhash.words_of(text)
    k = min(len(w), 5)
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute(docs, least=0.8):
    """Class id of every (id, text): all pairs that share a shingle."""
    bags, contents = {}, []
    for _, t in docs:
        c = tuple(bagminhash.words_of(t))
        contents.append(c)
        if c:
            bags[c] = bag(t)
    up = {c: c for c in bags}

    def find(c):
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    by = defaultdict(list)
    for c, b in bags.items():
        for s in b:
            by[s].append(c)
    seen = set()
    for cs in by.values():
        for i, x in enumerate(cs):
            for y in cs[i + 1 :]:
                if (x, y) not in seen:
                    seen.add((x, y))
                    a, b = bags[x], bags[y]
                    if sum((a & b).values()) >= least * sum((a | b).values()):
                        up[find(x)] = find(y)
    low = {}
    for (i, _), c in zip(docs, contents, strict=True):
        if c and i is not None:
            r = find(c)
            low[r] = min(low.get(r, i), i)
    return [(i, low.get(find(c)) if c else i) for (i, _), c in zip(docs, contents, strict=True)]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    got = queries.op8_bag_minhash(spark, sf).collect()
    want = brute(docs)
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == sorted(want)
    assert len({c for _, c in want}) < len(want)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    for _ in range(6):
        keys = rng.integers(0, 2**63, 60).astype(np.uint64)
        keys.sort()
        wa, wb = rng.integers(0, 9, 60), rng.integers(0, 40, 60)
        wb = np.where(rng.random(60) < 0.5, wa, wb)
        a, b = (keys[wa > 0], wa[wa > 0]), (keys[wb > 0], wb[wb > 0])
        j = bagminhash.similarity(a, b)
        assert abs(j - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 1e-12
        s = bagminhash.signatures([a, b], 4096)
        assert abs((s[0] == s[1]).mean() - j) < 4 * np.sqrt(j * (1 - j) / 4096) + 1e-3
        assert np.isfinite(s).all()


def test_signature_does_not_depend_on_the_batch():
    docs = [bagminhash.shingles(bagminhash.words_of(t)) for t in ("a b c d e f g a b c d e f g", "x", "one two three four five six " * 50)]
    together = bagminhash.signatures(docs)
    for i, d in enumerate(docs):
        assert (bagminhash.signatures([d])[0] == together[i]).all()


def planted():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    out, n = [], 0
    for group in range(30):
        base = [word() for _ in range(rng.choice((6, 40, 120, 400)))]
        for _ in range(rng.choice((1, 2, 5, 40))):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = word()
            out.append((n, " ".join(w) if group % 2 else " \n".join(w)))
            n += 1
    rng.shuffle(out)
    return out


def test_planted_groups(spark, monkeypatch):
    docs = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute(docs))
    assert sorted((r["doc_id"], r["class_id"]) for r in bagminhash.near_copies(df).collect()) == want
    # With a single hub most of the work falls to the blocks.
    monkeypatch.setattr(bagminhash, "HUBS", 1)
    monkeypatch.setattr(bagminhash, "BLOCK_ROWS", 40)
    assert sorted((r["doc_id"], r["class_id"]) for r in bagminhash.near_copies(df).collect()) == want


def test_odd_rows(spark):
    docs = odd_documents(spark)
    plain = [(r[0], r[1]) for r in rows()]
    got = bagminhash.near_copies(docs).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=repr) == sorted(brute(plain), key=repr)
    kept = bagminhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    texts = Counter(tuple(bagminhash.words_of(r["text"])) for r in kept.collect())
    assert all(n == 1 for c, n in texts.items() if c)
    assert texts[()] == sum(not bagminhash.words_of(t) for _, t in plain)
    assert bagminhash.near_copies(no_documents(spark)).count() == 0
    assert bagminhash.drop_near_copies(no_documents(spark)).count() == 0
