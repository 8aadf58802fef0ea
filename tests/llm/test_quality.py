import math
import re
from collections import Counter
from fractions import Fraction

import pyarrow.parquet as pq
from fixtures import no_documents, odd_documents, rows

import llm_oracle as oracle

from tokenloom.llm import oracles, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = list(zip(w, w[1:], w[2:], strict=False))
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines)


def exact_tail(k, n, p):
    p = Fraction(p)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def brute(docs, labels, alpha=quality.ALPHA):
    good = {}
    for d, q in labels:
        good[d] = good.get(d, True) and q == 1
    held, measured = {}, []
    for i, text, lang in docs:
        n, chars, sym, dup, rep, lines = counts(text)
        f = {"symbol_ratio": sym / chars if chars else 0.0, "dup_line_ratio": dup / lines if lines else 0.0, "repeat_ratio": rep / n if n else 0.0, "word_length": chars / n if n else 0.0}
        measured.append((i, lang, (n, chars, sym, dup, rep), f, n < 50 or 100 * rep > 50 * n))
        if good.get(i):
            held.setdefault(lang, []).append(f)
    hit = lambda rule, c, f: f[quality.RULES[rule][0]] <= c if rule.endswith("_low") else f[quality.RULES[rule][0]] >= c
    cut = {}
    for lang, fs in held.items():
        for rule, (_, grid) in quality.RULES.items():
            for c in grid:
                if exact_tail(sum(hit(rule, c, f) for f in fs), len(fs), alpha) > quality.DELTA / (len(held) * len(quality.RULES)):
                    break
                cut[lang, rule] = c
    out = [(i, *base, failed, not failed and not any(hit(r, c, f) for (s, r), c in cut.items() if s == lang)) for i, lang, base, f, failed in measured]
    return out, cut


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(d["doc_id"], d["text"], d["lang"]) for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    labels = [(d["doc_id"], d["quality"]) for d in pq.read_table(f"{sf}/labels.parquet").to_pylist()]
    want, _ = brute(docs, labels)
    assert sorted(map(tuple, queries.op10_quality_rules(spark, sf).collect())) == sorted(want)


def test_cutoffs_are_learned_and_bounded(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    measured = quality.features(docs, ["doc_id", "lang"])
    cut = quality.fit(measured, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ("en", "symbols_high") in cut
    for k, n in ((0, 2000), (3, 2000), (17, 300)):
        assert math.isclose(quality.binomial_tail(k, n, 0.005), exact_tail(k, n, 0.005), rel_tol=1e-9)


def test_learned_cutoffs_row_by_row(spark, tmp_path):
    """With a laxer promise every language has enough labels: verdicts against brute force and SQL, and the promise itself."""
    sf, alpha = "/root/testdata/sf0.1", 0.05
    docs = [(d["doc_id"], d["text"], d["lang"]) for d in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text", "lang"]).slice(0, 3500).to_pylist()]
    labels = [(d["doc_id"], d["quality"]) for d in pq.read_table(f"{sf}/labels.parquet").to_pylist()]
    want, cut = brute(docs, labels, alpha)
    assert len({lang for lang, _ in cut}) >= 2 and len({rule for _, rule in cut}) >= 3
    assert sum(not v[-1] and not v[-2] for v in want) > 0  # rejected by learned rules alone
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = quality.judge(table, known, alpha=alpha).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    names, rows_ = oracle.run(oracles.quality_rules(alpha), str(tmp_path), tables=("documents", "labels"))
    order = [names.index(c) for c in columns]
    assert sorted(tuple(r[k] for k in order) for r in rows_) == sorted(want)
    assert {r["doc_id"] for r in quality.keep_good(table, known, alpha=alpha).collect()} == {v[0] for v in want if v[-1]}


def test_a_rule_keeps_good_documents():
    """Monte Carlo: the cutoff that a rule learns from 400 good documents rejects more than alpha of them hardly ever."""
    import random

    rng, alpha, level, lost = random.Random(1), 0.02, 0.05 / 10, []
    for _ in range(200):
        sample = sorted(rng.random() for _ in range(400))
        cuts = [c / 100 for c in range(100, 79, -1)]  # reject values of c or more
        best = None
        for c in cuts:
            if quality.binomial_tail(sum(x >= c for x in sample), len(sample), alpha) > level:
                break
            best = c
        lost.append(1 - best if best is not None else 0.0)
    assert sum(x > alpha for x in lost) <= 200 * 0.05
    assert quality.least_labels(0.05 / 20, 0.005) == 1195


def test_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, None, 0), (None, 1, 1), (5, 1, None), (99, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(odd_documents(spark), labels)
    want = sorted(((r[0], *counts(r[1])[:5]) for r in rows()), key=repr)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=repr) == want
    docs = odd_documents(spark)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality.judge(no_documents(spark), labels.limit(0)).count() == 0
    assert quality.keep_good(no_documents(spark), labels).count() == 0
