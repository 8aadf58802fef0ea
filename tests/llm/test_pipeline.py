import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq
from fixtures import no_documents, odd_documents
from test_bagminhash import brute as near_classes
from test_mixing import brute_targets
from test_quality import brute as quality_verdicts
from test_secrets import brute as secret_spans
from tokenizers import Tokenizer

from tokenloom.llm import mixing, queries, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def redacted(text):
    at, out = 0, ""
    for start, _, end, _ in secret_spans(text):
        if start >= at:
            out += text[at:start] + secrets.MARK
        at = max(at, end)
    return out + text[at:]


def test_rows_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {d["doc_id"]: d for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    labels = [(d["doc_id"], d["quality"]) for d in pq.read_table(f"{sf}/labels.parquet").to_pylist()]
    verdicts, _ = quality_verdicts([(d["doc_id"], d["text"], d["lang"]) for d in docs.values()], labels)
    good = [(v[0], docs[v[0]]["text"]) for v in verdicts if v[-1]]
    texts = {i: redacted(docs[i]["text"]) for i, c in near_classes(good) if i == c}
    size = {i: len(WORD.findall(t)) for i, t in texts.items()}

    got = corpus_pipeline.run(spark, sf).collect()
    n = Counter(r["doc_id"] for r in got)
    assert set(n) <= set(texts) and max(n.values()) <= 2
    library = Tokenizer.from_file(queries.VOCAB)
    for r in got:
        assert (r["lang"], r["source"]) == (docs[r["doc_id"]]["lang"], docs[r["doc_id"]]["source"])
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
    by_source = defaultdict(list)
    for i in texts:
        by_source[docs[i]["source"]].append(i)
    names = sorted(by_source)
    sizes = [sum(size[i] for i in by_source[s]) for s in names]
    want = brute_targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(sizes), 2)
    for s, t in zip(names, want, strict=True):
        taken = sum(n[i] * size[i] for i in by_source[s])
        assert abs(taken - t) <= max(size[i] for i in by_source[s]) / 2 + 1
    # The order within a source is that of the keys.
    import hashlib

    for s, t in zip(names, want, strict=True):
        ranked = sorted(by_source[s], key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        counts = [n[i] for i in ranked]
        assert counts == sorted(counts, reverse=True)
        assert math.isfinite(t)
    assert mixing.RANGE_DIGITS > 0


def test_stages_take_odd_rows(spark, sf):
    for docs in (odd_documents(spark), no_documents(spark)):
        docs = docs.drop("size", "key", "_text")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                docs = out if docs.count() == 0 else docs


def test_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.simpleString() == docs.schema.simpleString()
