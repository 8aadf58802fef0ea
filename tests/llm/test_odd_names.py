"""Columns that have the names the operators use themselves, and ids that are all null or all equal."""

from collections import Counter

import pytest
from fixtures import TEXTS, odd_documents
from pyspark.sql import functions as F
from test_secrets import brute as secret_spans

from tokenloom.llm import bagminhash, langid, mixing, quality, secrets

NAMES = ["spans", "rules", "row", "kept", "class_id", "taken", "content", "bands", "twins", "best", "_best", "_doc", "doc", "body", "place", "source_size", "_s", "_key", "id", "digest", "secret_spans", "cut"]


@pytest.fixture(scope="module")
def docs(spark):
    named = [F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for n in NAMES]
    return odd_documents(spark, 1).select("doc_id", "text", "lang", "source", *named)


def intact(df, docs):
    assert df.columns[: len(docs.columns)] == docs.columns
    out = df.select(*[F.col(f"`{c}`") for c in docs.columns]).collect()
    for r in out:
        assert [r[n] for n in NAMES] == [n + str("" if r["doc_id"] is None else r["doc_id"]) for n in NAMES]
    return out


def test_operators_keep_clashing_columns(spark, docs):
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    n = docs.count()
    got = secrets.scan(docs)
    assert got.columns == [*docs.columns, "_spans"]
    assert len(intact(got, docs)) == n
    assert len(intact(secrets.redact(docs), docs)) == n
    intact(bagminhash.drop_near_copies(docs), docs)
    intact(mixing.mix_documents(docs), docs)
    intact(quality.keep_good(docs, labels), docs)


@pytest.mark.parametrize("key", [None, 5])
def test_ids_that_tell_nothing_apart(spark, key):
    texts = [*TEXTS[:5], *[f"the dog {k} runs over the bridge and finds number {k * k}" for k in range(300)], *[f"der hund {k} geht über die brücke und findet {k * k}" for k in range(300)]]
    rows = [(key, t, "de" if t and t.startswith("der") else "en", "ab"[i % 2]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    spans = Counter((r["text"], tuple(tuple(x) for x in r["spans"])) for r in secrets.scan(docs).collect())
    assert spans == Counter((t, tuple(secret_spans(t))) for t in texts)

    model = langid.fit(docs, sample_docs=100)
    got = langid.predict(docs, model, keep=["lang"]).where("lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.98 * len(got)

    taken = mixing.mix_sizes(docs).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in taken)
    for s in {r["source_size"] for r in taken}:
        of = [r for r in taken if r["source_size"] == s]
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 1 + 2 * len({r["source_size"] for r in taken})


def test_the_sample_is_bounded(spark, monkeypatch):
    """Rows that are all equal, or have no id, never make the driver gather more than the bound."""
    sizes = []
    train = langid.train
    monkeypatch.setattr(langid, "train", lambda model, rows, **k: (sizes.append(len(rows)), train(model, rows, **k)))
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text for all of them").alias("text"), F.lit("en").alias("lang"))
    langid.fit(same, sample_docs=100)
    langid.fit(same.withColumn("text", F.concat("text", F.rand(1).cast("string"))), sample_docs=100)
    monkeypatch.setattr(langid, "SAMPLE_NUMBERS", 2000)
    langid.fit(same.withColumn("text", F.concat("text", F.rand(1).cast("string"))), sample_docs=100)
    assert sizes[0] <= 1 and 60 <= sizes[1] <= 100 and sizes[2] < sizes[1]


def test_large_cut_ranges_are_cut_again(spark, monkeypatch):
    rows = [(None if i % 3 else i, f"w{i} " * (1 + i % 7), "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    want = sorted(mixing.mix_sizes(docs).collect(), key=key)
    monkeypatch.setattr(mixing, "CUT_ROWS", 1)
    assert sorted(mixing.mix_sizes(docs).collect(), key=key) == want
