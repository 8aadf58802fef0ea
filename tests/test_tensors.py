import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.operators.kernels import bicubic_grid
from tokenloom.operators.params import state_diff
from tokenloom.sources import tensors

SCHEMA = "name string, dtype string, shape array<long>, data array<double>"


def fixture(path, entries, meta=None):
    """A file written by hand: name -> (dtype, shape, bytes)."""
    header, at = ({"__metadata__": meta} if meta else {}), 0
    for name, (dtype, shape, raw) in entries.items():
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(raw)]}
        at += len(raw)
    head = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + b"".join(x[2] for x in entries.values()))


def test_every_type_by_hand(spark, tmp_path):
    x = np.array([[0.5, -2.0, 3.25], [1.0, 0.0, -7.5]])
    entries = {k: (k, [2, 3], x.astype(d).tobytes()) for k, d in tensors.DTYPES.items() if k not in ("BF16",)}
    entries["BF16"] = ("BF16", [2, 3], (x.astype("<f4").view("<u4") >> 16).astype("<u2").tobytes())
    entries["scalar"] = ("F32", [], np.float32(9).tobytes())
    entries["empty"] = ("F32", [0, 4], b"")
    fixture(tmp_path / "a.safetensors", entries, {"format": "pt"})
    got = {r["name"]: r for r in tensors.read_tensors(spark, f"file://{tmp_path}").collect()}
    assert got.keys() == entries.keys()
    for k, d in tensors.DTYPES.items():
        assert got[k]["data"] == (x if k == "BF16" else x.astype(d).astype(float)).ravel().tolist() and got[k]["shape"] == [2, 3]
    assert got["scalar"]["data"] == [9] and got["scalar"]["shape"] == [] and got["empty"]["data"] == []


def test_ranges_and_names_read_only_their_bytes(spark, tmp_path):
    big = np.arange(1000, dtype="<f8")
    fixture(tmp_path / "m.safetensors", {"big": ("F64", [1000], big.tobytes()), "layer.0.w": ("F32", [2], np.float32([1, 2]).tobytes()), "layer.1.w": ("F32", [1], np.float32([3]).tobytes())})
    path = f"{tmp_path}/m.safetensors"
    rows = tensors.read_tensors(spark, path, ["big"], part_bytes=1024)
    assert rows.rdd.getNumPartitions() == 8
    parts = sorted((r["start"], r["data"]) for r in rows.collect())
    assert [s for s, _ in parts] == list(range(0, 1000, 128)) and np.array_equal(np.concatenate([d for _, d in parts]), big)
    raw = (tmp_path / "m.safetensors").read_bytes()
    (tmp_path / "m.safetensors").write_bytes(raw[:-4])  # the end of the last tensor is missing
    with pytest.raises(Exception, match="does not fit"):
        tensors.read_tensors(spark, path).collect()
    (tmp_path / "m.safetensors").write_bytes(raw)
    reader = tensors._Reader(path, 1 << 20)
    left = list(reader.pushFilters([tensors.EqualTo(("name",), "big"), tensors.EqualTo(("dtype",), "F64")]))
    assert [f.attribute for f in left] == [("dtype",)]
    assert [r.name for p in reader.partitions() for r in p.ranges] == ["big"]
    found = tensors.read_tensors(spark, path).where(F.col("name").startswith("layer.") & (F.col("dtype") == "F32"))
    assert sorted(r["name"] for r in found.collect()) == ["layer.0.w", "layer.1.w"]


def test_bad_files_are_refused(spark, tmp_path):
    for raw in (b"", b"1234", struct.pack("<Q", 1 << 40) + b"{}", struct.pack("<Q", 2) + b"[1"):
        (tmp_path / "bad.safetensors").write_bytes(raw)
        with pytest.raises(Exception, match="header|JSON|delimiter"):
            tensors.read_tensors(spark, f"{tmp_path}/bad.safetensors").collect()


def test_written_copy_is_equal(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"t{i}", d, [3, i], rng.integers(0, 2, 3 * i).astype(float).tolist()) for i, d in enumerate(tensors.DTYPES)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = f"file://{tmp_path}/model"
    tensors.write_tensors(df, out)
    names = sorted(os.listdir(tmp_path / "model"))
    index = json.loads((tmp_path / "model" / "model.safetensors.index.json").read_text())
    assert sorted(index["weight_map"]) == sorted(r[0] for r in rows) and set(index["weight_map"].values()) == set(names) - {"model.safetensors.index.json"}
    back = tensors.read_tensors(spark, out)
    same = state_diff(df.withColumn("device", F.lit("cpu")), back.withColumn("device", F.lit("cpu")))
    assert {r["verdict"] for r in same.collect()} == {"same"} and same.count() == len(rows)
    with pytest.raises(Exception, match="has weight files"):
        tensors.write_tensors(df, out)
    assert sorted(os.listdir(tmp_path / "model")) == names
    tensors.write_tensors(df.where("name = 't1'").coalesce(1), out, mode="overwrite")
    assert sorted(os.listdir(tmp_path / "model")) == ["model-00001-of-00001.safetensors", "model.safetensors.index.json"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    good = spark.createDataFrame([("a", "F32", [1], [1.0])], SCHEMA)
    for bad in ([("b", "F32", [2], [1.0])], [("a", "F32", [1], [2.0])]):  # a wrong shape; a name of another task
        with pytest.raises(Exception, match="its shape|two tasks"):
            tensors.write_tensors(good.unionByName(spark.createDataFrame(bad, SCHEMA)), f"{tmp_path}/out")
        assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
    tensors.write_tensors(good.limit(0), f"{tmp_path}/none")
    assert os.listdir(tmp_path / "none") == ["model.safetensors.index.json"]


def test_bfloat16_rounds_to_nearest():
    x = np.array([1.0, 1.00390625, 1.01171875, -3.14159, np.nan, np.inf, 0.0])  # the second and third lie in the middle
    got = tensors.elements(tensors.stored(x, "BF16"), "BF16")
    assert got[:3].tolist() == [1.0, 1.0, 1.015625] and abs(got[3] + 3.14159) < 0.01 and np.isnan(got[4]) and np.isinf(got[5]) and got[6] == 0


def test_position_table_is_resampled(spark, tmp_path):
    grid = np.random.default_rng(1).normal(size=(1, 16, 3))
    df = spark.createDataFrame([("pos", "F64", [1, 16, 3], grid.ravel().tolist()), ("other", "F32", [2], [1.0, 2.0])], SCHEMA)
    got = {r["name"]: r for r in tensors.resampled(df, "pos", 36).collect()}
    assert got["pos"]["shape"] == [1, 36, 3] and np.allclose(got["pos"]["data"], bicubic_grid(grid[0], 6).ravel())
    assert got["other"]["data"] == [1, 2]
    assert sorted(tensors.resampled(df, "pos", 16).collect()) == sorted(df.collect())
    with pytest.raises(ValueError, match="square"):
        tensors.resampled(df, "pos", 15)
