import math
import re
from collections import defaultdict

import pyarrow.parquet as pq
from fixtures import no_documents, odd_documents, rows

from tokenloom.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights, total, most):
    out, active = [0.0] * len(sizes), set(range(len(sizes)))
    while active:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in active)
        w = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / w >= most * sizes[i]]
        if not over:
            for i in active:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
            active.discard(i)
    return out


def check(got, docs):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, brute_targets([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2), strict=True))
    source_of = {(i, len(WORD.findall(t or ""))): s for i, t, s in docs}
    taken = defaultdict(int)
    for r in got:
        s = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s]
        assert math.isclose(r["target"], want[s], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    return taken, want


def test_query(spark, sf):
    docs = [(d["doc_id"], d["text"], d["source"]) for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    got = queries.op7_source_mix(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d[0] for d in docs)
    taken, want = check(got, docs)
    for s in want:
        assert taken[s] == math.floor(want[s] + 1e-9)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op7_source_mix(spark, sf).collect()))


def test_odd_rows(spark):
    docs = [(r[0], r[1], r[3]) for r in rows()]
    taken, want = check(mixing.mix_sizes(odd_documents(spark)).collect(), docs)
    for s in want:
        assert abs(taken[s] - want[s]) <= 3
    assert mixing.mix_sizes(no_documents(spark)).count() == 0
    assert mixing.mix_documents(no_documents(spark)).count() == 0


def test_whole_documents(spark):
    docs = odd_documents(spark)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    n = defaultdict(int)
    for r in mixed.collect():
        n[r["doc_id"], r["text"]] += 1
    assert n and max(n.values()) <= 6  # two copies at most of each of three equal rows
