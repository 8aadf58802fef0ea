import hashlib
import os
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from fixtures import no_documents, odd_documents, rows
from tokenizers import Tokenizer

from tokenloom.llm import bpe, dac, queries
from tokenloom.llm.common import fresh_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.VOCAB)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_library_on_documents(spark, sf, library):
    got = {r["doc_id"]: r for r in queries.op9_bpe(spark, sf).collect()}
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    assert len(got) == len(docs)
    for d in docs:
        ids = ids_of(library, d["text"])
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark, library):
    got = bpe.encode_documents(odd_documents(spark), queries.VOCAB, keep=("doc_id", "text")).collect()
    assert len(got) == len(rows())
    for r in got:
        ids = ids_of(library, r["text"])
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(no_documents(spark), queries.VOCAB).count() == 0


def test_merge_order_and_stale_entries(library):
    b = bpe.loaded(queries.VOCAB)
    rng = np.random.default_rng(1)
    letters = list("thersinaouézß")
    for _ in range(300):
        w = "".join(rng.choice(letters, rng.integers(1, 40)))
        assert np.frombuffer(b.encode(w), "<u4").tolist() == ids_of(library, w)


def test_dac_random_access():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 2**32, 200), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype(np.uint32)
    rng.shuffle(ids)
    starts = np.array([0, 0, 10, 3000, len(ids)])
    f = dac.DacFile(dac.pack(ids, [5, None, 7, 9], starts))
    assert [f.token(i) for i in range(len(ids))] == ids.tolist()
    for k in range(4):
        assert f.document(k).tolist() == ids[starts[k] : starts[k + 1]].tolist()
    for a, b in rng.integers(0, len(ids), (100, 2)):
        assert f.tokens(min(a, b), max(a, b)).tolist() == ids[min(a, b) : max(a, b)].tolist()
    empty = dac.DacFile(dac.pack(ids[:0], [1], np.array([0, 0])))
    assert empty.document(0).tolist() == []
    with pytest.raises(IndexError):
        empty.token(0)


def test_dac_query(spark, sf, library):
    got = {r["doc_id"]: r for r in queries.op3_dac_tokens(spark, sf).collect()}
    start = 0
    for d in sorted(pq.read_table(f"{sf}/documents.parquet").to_pylist(), key=lambda d: d["doc_id"]):
        ids = np.array([*ids_of(library, d["text"]), 2], "<u4")
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_dac_odd_rows_and_many_files(spark, library):
    got = dac.write_and_read(odd_documents(spark), queries.VOCAB, end_id=2, file_ids=500).orderBy("start").collect()
    want = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, w in zip(got, want, strict=True):
        ids = [*ids_of(library, w[1]), 2]
        assert (r["doc_id"], r["start"]) == (w[0], start)
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids
        start += len(ids)
    assert dac.write_and_read(no_documents(spark), queries.VOCAB, end_id=2).count() == 0


def test_dac_ranges_split_rows_of_one_id(spark, library):
    """Nine of ten rows without an id, half of those of one text: several tasks share them, and starts still follow the order."""
    rows = [(None if i % 10 else i, "same words" if i % 2 else f"text {i} of its own") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = fresh_path(spark, "dac-test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        listed = dac.write_documents(docs, queries.VOCAB, folder, end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert listed.where("n_docs > 150").count() == 0 and listed.count() >= 3
    left_over = listed.select("name").first()["name"]
    fs, path = dac._file_system(folder)
    fs.copy_file(f"{path}/{left_over}", f"{path}/000000-000000-999999999.dac")  # of an attempt that does not count
    got = dac.read_documents(spark, listed, folder).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1][:64], hashlib.md5(r[1].encode()).hexdigest()))
    at = 0
    assert len(got) == len(want)
    for g, (doc_id, text) in zip(got, want, strict=True):
        ids = [*ids_of(library, text), 2]
        assert (g["doc_id"], g["start"], bytes(g["ids"])) == (doc_id, at, np.array(ids, "<u4").tobytes())
        at += len(ids)
