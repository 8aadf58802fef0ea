import zlib

import numpy as np
import pyarrow.parquet as pq
from fixtures import no_documents, odd_documents, rows

from tokenloom.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {d["doc_id"]: d for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = queries.op5_language_id(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    held = [r for r in got if r["held_out"]]
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    right = np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held])
    assert right > 0.97
    assert abs(np.mean([r["score"] for r in held]) - right) < 0.05  # calibrated
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op5_language_id(spark, sf).collect()))


def test_ngrams_by_brute_force():
    at, n = langid.ngram_counts("Ab, a1b é", 15)
    text = " ab a b é "
    assert n.sum() == sum(len(text) - k for k in range(3))
    assert langid.ngram_counts("123 !?", 15) is None and langid.ngram_counts(None, 15) is None


def test_letters_alone_count():
    """Numbers that are no digits, and marks, are no letters; letters of any script are."""
    for text in ("½", "²", "①② Ⅷ", "٣ 12", "\u0301", "_-_", "½²\u0301"):
        assert langid.ngram_counts(text, 15) is None
        assert langid.Model(["en"], None, None, None, 1.0, 15).predict(text) == ("und", 0.0)
    for text, letters in (("a½b", "a b"), ("ⅷx", "x"), ("日本", "日本"), ("ª", "ª")):
        a, b = langid.ngram_counts(text, 15), langid.ngram_counts(letters, 15)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_training_by_brute_force():
    """Follow-the-regularised-leader written out number by number gives the same weights and predictions."""
    rng = np.random.default_rng(2)
    rows_ = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6), int(rng.integers(3))) for _ in range(60)]
    m = langid.Model(["a", "b", "c"], np.zeros((1 << 6, 3)), np.zeros(3), np.ones(1 << 6), 1.0, 6)
    options = {"alpha": 0.5, "beta": 1.0, "l1": 0.05, "l2": 0.1}
    langid.train(m, rows_, epochs=2, **options)
    z, n, zb, nb = ([[0.0] * 3 for _ in range(64)] for _ in range(4))

    def weight(z, n, l1, l2):
        return 0.0 if abs(z) <= l1 else -(z - (l1 if z > 0 else -l1)) / ((options["beta"] + n**0.5) / options["alpha"] + l2)

    for _ in range(2):
        for at, x, k in rows_:
            w = {i: [weight(z[i][c], n[i][c], options["l1"], options["l2"]) for c in range(3)] for i in at.tolist()}
            b = [weight(zb[0][c], nb[0][c], 0.0, 0.0) for c in range(3)]
            s = [b[c] + sum(v * w[i][c] for i, v in zip(at.tolist(), x.tolist(), strict=True)) for c in range(3)]
            p = [np.exp(v) / sum(np.exp(u) for u in s) for v in s]
            for c in range(3):
                g = p[c] - (c == k)
                for i, v in zip(at.tolist(), x.tolist(), strict=True):
                    grown = n[i][c] + (g * v) ** 2
                    z[i][c] += g * v - (grown**0.5 - n[i][c] ** 0.5) / options["alpha"] * w[i][c]
                    n[i][c] = grown
                grown = nb[0][c] + g * g
                zb[0][c] += g - (grown**0.5 - nb[0][c] ** 0.5) / options["alpha"] * b[c]
                nb[0][c] = grown
    want = np.array([[weight(z[i][c], n[i][c], options["l1"], options["l2"]) for c in range(3)] for i in range(64)])
    assert np.allclose(m.weights, want) and np.allclose(m.bias, [weight(zb[0][c], nb[0][c], 0.0, 0.0) for c in range(3)])
    assert (want == 0).any() and (want != 0).any()


def test_weights_are_sparse_and_separate():
    rng = np.random.default_rng(0)
    rows_ = []
    for _ in range(400):
        k = int(rng.integers(2))
        at = np.unique(rng.choice(500, 20) + 500 * k)
        noise = np.unique(rng.choice(np.arange(1000, 3000), 5))
        at = np.concatenate([at, noise])
        rows_.append((at, np.ones(len(at)) / np.sqrt(len(at)), k))
    m = langid.Model(["a", "b"], np.zeros((1 << 12, 2)), np.zeros(2), np.ones(1 << 12), 1.0, 12)
    langid.train(m, rows_, l1=0.5)
    assert np.mean([int(np.argmax(m.scores(at, x))) == k for at, x, k in rows_]) == 1
    assert (m.weights[1000:] == 0).mean() > 0.9
    langid.calibrate(m, rows_)
    assert m.temperature < 1


def test_odd_rows(spark):
    docs = odd_documents(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang", "key"))
    got = langid.predict(docs, model, keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows())
    for r in got:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "de")
    nothing = langid.fit(no_documents(spark))
    assert langid.predict(no_documents(spark), nothing, keep=["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, nothing, keep=["doc_id"]).collect()} == {"und"}
