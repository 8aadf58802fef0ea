import random
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from fixtures import no_documents, odd_documents, rows

from tokenloom.llm import queries, toxicity

STEMS = {"en": "snarl", "de": "grimmel", "fr": "vequer"}


def corpus(seed, n, share=0.3):
    """Invented texts; toxic ones hold forms of a stem of their language."""
    rng = random.Random(seed)
    syllables = {"en": ["the", "on", "ti", "er", "an"], "de": ["sch", "ung", "ein", "kei", "ver"], "fr": ["eau", "que", "ou", "ment", "oi"]}
    out = []
    for i in range(n):
        lang, y = rng.choice(list(STEMS)), int(rng.random() < share)
        words = ["".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 3) * y):
            words[rng.randrange(len(words))] = STEMS[lang] + rng.choice(syllables[lang]) * rng.randint(0, 2)
        out.append((i, " ".join(words) + ".", lang, y))
    return out


def test_features_by_brute_force():
    words = ["ab", "naïve", "a", "abcdefgh", "ab"]
    whole, offset, got = toxicity.features(words, 40)
    assert whole[0] == whole[4] and len(set(whole.tolist())) == 4
    by_gram = {}
    for i, w in enumerate(words):
        marked = f"<{w}>"
        grams = [marked[a : a + n] for n in toxicity.GRAMS for a in range(len(marked) - n + 1)]
        mine = got[offset[i] : offset[i + 1]]
        assert len(mine) == 1 + len(grams)
        for g, r in zip(grams, mine[1:], strict=True):
            assert by_gram.setdefault(g, r) == r
    assert len(set(by_gram.values())) == len(by_gram)
    assert toxicity.features([], 18)[2].shape == (0,)


def test_pooling_by_brute_force():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 40):
        e, f = rng.normal(size=(n, toxicity.DIM)), rng.normal(size=(toxicity.DIM, toxicity._COLS))
        want, first = [], 0
        for w in toxicity.WIDTHS:
            for k in range(toxicity.FILTERS):
                r = [sum(e[i + j] @ f[:, first + j * toxicity.FILTERS + k] for j in range(w)) for i in range(n - w + 1)]
                want.append(max([0, *r]))
            first += w * toxicity.FILTERS
        assert np.allclose(toxicity.pooled(e @ f), want)


def test_pieces_and_forgetting_change_nothing(monkeypatch):
    model = toxicity.learn([t[1:2] + (t[3], t[2]) for t in corpus(0, 60)], bits=14)
    text = " ".join(t[1] for t in corpus(1, 40))
    best, lang = toxicity.Reader(model).read(text)
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 7)
    monkeypatch.setattr(toxicity, "REMEMBERED", 50)
    again, same = toxicity.Reader(model).read(text)
    assert np.allclose(best, again, atol=1e-5) and lang == same


def test_learns_stems_and_new_forms():
    train, test = corpus(2, 900), corpus(3, 300)
    model = toxicity.learn([(t, y, lang) for _, t, lang, y in train])
    reader = toxicity.Reader(model)
    got = [(model.score(*reader.read(t)) >= 0.5, y, model.languages[reader.read(t)[1]] == lang) for _, t, lang, y in test]
    assert np.mean([a == y for a, y, _ in got]) > 0.97
    assert np.mean([known for *_, known in got]) > 0.95
    assert model.score(*reader.read("")) < 0.5
    assert model.score(*reader.read("xyzzy плохо 123 " * 500)) < 0.5
    new = "onti eran " * 30 + "snarltierti " + "tion eron " * 30  # a form that the sample does not have
    assert "snarltierti" not in " ".join(t for _, t, *_ in train) and model.score(*reader.read(new)) >= 0.5


def test_threshold():
    z, y = np.array([0.0, 1, 2, 3, 10, 11]), np.array([0, 0, 1, 0, 1, 1])
    assert toxicity.threshold(z, y) == 6.5
    assert toxicity.threshold(np.array([1.0, 1]), np.array([0, 1])) == 2


def test_copies_count_once():
    toxic = "one only text that is copied again and again with grimm words inside of it " * 3
    sample = [(toxic + str(i), 1, "en") for i in range(200)] + [(t, 0, lang) for _, t, lang, y in corpus(4, 200, 0)]
    kept = []
    learned = toxicity.train
    try:
        toxicity.train = lambda model, vocabulary, docs, labels, **k: kept.append(labels)
        toxicity.learn(sample)
    finally:
        toxicity.train = learned
    assert kept[0].sum() < 10 and (1 - kept[0]).sum() > 100


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (2, None), (4, 0), (5, 7), (6, 0), (7, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs.withColumnRenamed("key", "score2"), model, keep=["doc_id", "size"]).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    alike = {(r["score"], r["predicted"]) for r in got if r["doc_id"] in (1, 2, 13, 14)}
    assert len(alike) == 1  # null and empty texts
    for none in (labels.where("toxic = 1"), labels.where("toxic = 9")):
        plain = toxicity.fit(docs, none)
        assert {r["predicted"] for r in toxicity.score(docs, plain, keep=["doc_id"]).collect()} == {0}
    assert toxicity.score(no_documents(spark), toxicity.fit(no_documents(spark), labels), keep=["doc_id"]).count() == 0


def test_all_rows_are_learned_from(spark, monkeypatch):
    """A sample of four texts; words, languages and counts of the others must be in the model all the same."""
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 300)
    seen = []
    refine = toxicity.refine
    monkeypatch.setattr(toxicity, "refine", lambda model, texts: seen.append((model.languages, texts.count())) or refine(model, texts))
    docs = corpus(6, 900)
    table = spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d[0], d[3]) for d in docs], "doc_id long, toxic int")
    model = toxicity.fit(table, labels, sample_docs=2)
    assert seen[0][1] == 900 and sorted(model.languages) == sorted(STEMS)
    words = {w for d in docs for w in d[1].rstrip(".").split() if sum(w in e[1].rstrip(".").split() for e in docs[:60]) > 1}
    _, offset, rows = toxicity.features(sorted(words), model.bits)
    assert model.table[rows[offset[:-1]]].any(axis=1).mean() > 0.95
    assert abs(model.share - np.mean([d[3] for d in docs])) < 1e-9


def test_only_labelled_texts_are_sent(spark):
    """Without a broadcast of all labels, 20 of 400 long texts are labelled; the others must stay where they are."""
    rng = random.Random(8)
    docs = [(i, " ".join("%x" % rng.getrandbits(48) for _ in range(1500)), "en") for i in range(400)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(20 * i, i % 2) for i in range(20)], "doc_id long, toxic int")

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        toxicity.fit(table, labels, bits=8)
        sent = written() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sent < sum(len(d[1]) for d in docs) / 4


def test_labelled_texts_are_exact(spark, monkeypatch):
    """Copies with and without labels, an id with two texts, and marks so few that most rows pass them."""
    rows = [(i, f"text {i % 70}") for i in range(300)] + [(5, "other text"), (None, "text 3"), (None, "none")]
    texts = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "xxhash64(text) AS h")
    keys = texts.where("id % 7 = 0 OR id = 5").groupBy("h").agg(F.lit(1).alias("y"), F.lit("en").alias("lang"), F.min("id").alias("id"))
    want = sorted({(t, 1, "en") for i, t in rows if i is not None and (i % 7 == 0 or i == 5)})
    for bits in (1 << 26, 64):
        monkeypatch.setattr(toxicity, "MARK_BITS", bits)
        got = toxicity.labelled_texts(texts, keys, keys.count())
        assert sorted((r["text"], r["y"], r["lang"]) for r in got.collect()) == want


def test_texts_read_together_are_read_alike(monkeypatch):
    model = toxicity.learn([t[1:2] + (t[3], t[2]) for t in corpus(0, 60)], bits=14)
    texts = [t[1] for t in corpus(1, 40)] + [None, "", "x"]
    want = [toxicity.Reader(model).read(t) for t in texts]
    monkeypatch.setattr(toxicity, "PIECE_WORDS", 150)
    monkeypatch.setattr(toxicity, "REMEMBERED", 300)
    got = list(toxicity.Reader(model).read_all(texts))
    assert len(got) == len(texts)
    assert all(np.allclose(a, c, atol=1e-5) and b == d for (a, b), (c, d) in zip(want, got, strict=True))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {d["doc_id"]: d["toxic"] for d in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    got = queries.op11_toxicity(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(pq.read_table(f"{sf}/documents.parquet")["doc_id"].to_pylist())
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([p == y for p, y in held]) > 0.93
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op11_toxicity(spark, sf).collect()))
