import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
from fixtures import no_documents, odd_documents, rows

from tokenloom.llm import queries, suffix_dedup


def brute(docs, length=50):
    """(id, n_bytes, spans, kept) of every (id, text)."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, d in data:
        if i is not None:
            for k in range(len(d) - length + 1):
                s = d[k : k + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        if i is not None:
            for k in range(len(d) - length + 1):
                if first[d[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        spans, at = [], 0
        while (s := gone.find(1, at)) >= 0:
            e = gone.find(0, s)
            e = e if e >= 0 else len(d)
            spans.append((s, e))
            at = e
        out.append((i, len(d), spans, bytes(x for x, g in zip(d, gone, strict=True) if not g)))
    return out


def found(df):
    return [(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    want = sorted((i, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in brute(docs))
    assert sum(w[2] for w in want) > 0
    assert sorted(map(tuple, queries.op6_suffix_dedup(spark, sf).collect())) == want


def passages():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg é") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (9, 12, 30, 60)] + ["ab" * 60, "x" * 200, "y" * 49, "z" * 50]
    docs = []
    for i in range(250):
        parts = [text(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 10)
            parts += [p[a : len(p) - rng.randint(0, 10)], text(rng.randint(0, 8))]
        docs.append((i, "".join(parts)))
    docs += [(1000 + i, docs[i][1]) for i in range(20)]
    rng.shuffle(docs)
    return docs


def test_passages(spark, monkeypatch):
    docs = passages()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute(docs))
    assert sorted(found(suffix_dedup.remove_repeats(df))) == want
    # Frequent anchors one by one, small blocks and chunks, another length.
    monkeypatch.setattr(suffix_dedup, "OFTEN", 3)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    assert sorted(found(suffix_dedup.remove_repeats(df))) == want
    assert sorted(found(suffix_dedup.remove_repeats(df, length=30))) == sorted(brute(docs, 30))


def test_repeats_of_pieces():
    rng = np.random.default_rng(0)
    for _ in range(30):
        pieces = [bytes(rng.integers(97, 99, rng.integers(20, 40)).astype(np.uint8)) for _ in range(30)]
        docs = rng.integers(0, 10, 30)
        least = {}
        for p, d in zip(pieces, docs, strict=True):
            for k in range(len(p) - 11):
                least[p[k : k + 12]] = min(least.get(p[k : k + 12], 99), d)
        want = [sum(1 << k for k in range(len(p) - 11) if least[p[k : k + 12]] < d) for p, d in zip(pieces, docs, strict=True)]
        assert suffix_dedup.repeats(pieces, docs, 12).tolist() == want


def test_odd_rows(spark):
    plain = [(r[0], r[1]) for r in rows()]
    assert sorted(found(suffix_dedup.remove_repeats(odd_documents(spark))), key=repr) == sorted(brute(plain), key=repr)
    assert suffix_dedup.remove_repeats(no_documents(spark)).count() == 0
