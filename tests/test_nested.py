import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import pretty
from tokenloom.operators import attention, kernels, layout, prompts

VALUES = [
    {"b": {"z": 1, "a": [1, 2, {"x": None, "y": []}]}, "a": "true", "c": {}, "no": "it's"},
    [[1, [2, 3]], {"k": [{"m": 1}]}],
    {"a": [[], {}, [[{"q": {"w": [1]}}]]]},
    {"k": "a: b", "l": "#x", "m": "12", "n": "x y", "p": "", "r": 1.5, "s": True, "t": "http://x.y/z", "u": "- a", "v": "a #b", "w": "2024-01-01", "x": "a,b", "y": "n", "z": "~", "'": "ends ", '"': "a:"},
    {"deep": {str(i): [{"d": [i, {"e": {"f": "Null"}}]}] for i in range(12)}},
]
FIRST = """a: 'true'
b:
    a:
    - 1
    - 2
    -   x: null
        y: []
    z: 1
c: {}
'no': it's"""


def shown(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, j string")
    return [r["shown"] for r in pretty.pretty_nested(df, ["k"], "j").orderBy("k").collect()]


def test_nested_values(spark):
    got = shown(spark, [json.dumps(v) for v in VALUES])
    assert got[0] == FIRST
    assert got[1] == "-   - 1\n    -   - 2\n        - 3\n-   k:\n    -   m: 1"
    yaml = pytest.importorskip("yaml")
    for text, value in zip(got, VALUES, strict=True):
        assert text == yaml.dump(value, sort_keys=True, indent=4, width=10**6).rstrip("\n")
        assert yaml.safe_load(text) == value


def test_odd_nested_values(spark):
    assert shown(spark, ["5", '"on"', "no json", None, "{}", "[]", "null", '{"a": "x\\ny", "b": "é"}']) == ["5", "'on'", None, None, "{}", "[]", "null", 'a: "x\\ny"\nb: "é"']
    assert shown(spark, []) == []
    deep = "[" * 40 + "1" + "]" * 40
    assert shown(spark, [deep])[0] == "-   " * 39 + "- 1"


def test_calls(spark):
    df = spark.createDataFrame([(0, "T(name='x', size=3, extra={'a': 1, 'b': 'z'}, bad={'a'}, f=g(1)),\tmore"), (1, "no call"), (2, None), (3, "A(b"), (4, "A(x={})")], "k int, t string")
    got = [r[0] for r in df.orderBy("k").select(pretty.pretty_call(F.col("t"))).collect()]
    lines = ["T(", "    name='x',", "    size=3,", "    extra={", '        "a": 1,', '        "b": "z"', "    },", "    bad={'a'},", "    f=g(1,", "),", "    more"]
    assert got == ["\n".join(lines), None, None, None, "A(\n    x={},\n),\n"]


def test_padding_by_batch(spark):
    rows = [(0, 1, [1, 2, 3]), (1, 1, [4]), (2, None, [5, 6]), (3, None, []), (4, 2, [])]
    df = spark.createDataFrame(rows, "k int, b int, ids array<int>")
    got = {r["k"]: (r["padded"], r["mask"]) for r in prompts.left_pad(df, "ids", 0, [9], batch=["b"]).collect()}
    assert got == {0: ([1, 2, 3, 9], [1] * 4), 1: ([0, 0, 4, 9], [0, 0, 1, 1]), 2: ([5, 6, 9], [1] * 3), 3: ([0, 0, 9], [0, 0, 1]), 4: ([9], [1])}
    assert prompts.left_pad(df.limit(0), "ids", 0, batch=["b"]).count() == 0


def model_step(ids, attn, first, n, embeds, static):
    """Arrays of one sample, as a model that slices them would do it."""
    places = list(range(first, first + n))
    if embeds or places[-1] >= len(ids):
        at = list(range(len(ids)))[-n:]
    elif len(ids) != n:
        at = places
    else:
        at = list(range(len(ids)))
    position = np.where(np.array(attn) == 0, 1, np.cumsum(attn) - 1)[-len(at) :]
    vectors = embeds and first == 0
    mask = [[int(k <= p and (k >= len(attn) or attn[k] == 1)) for k in range(static)] for p in places]
    return [(i, at[i], None if vectors else ids[at[i]], "embeds" if vectors else "ids", int(position[i]), mask[i]) for i in range(len(at))]


def test_steps_of_generation(spark):
    rng = np.random.default_rng(4)
    tokens, cache, want = [], [], {}
    for s in range(60):
        length = int(rng.integers(1, 7))
        ids, attn = rng.integers(0, 50, length).tolist(), rng.integers(0, 2, length).tolist()
        first = int(rng.integers(0, length + 1)) if s % 3 else 0
        n = 1 if first >= length else int(rng.integers(1, length - first + 1))
        embeds = s % 2 == 0
        if embeds and first == 0:
            n = length
        tokens += [(s, p, ids[p], attn[p]) for p in range(length)]
        cache.append((s, first, n, embeds))
        want[s] = model_step(ids, attn, first, n, embeds, 8)
    t, c = spark.createDataFrame(tokens, "sample_id int, pos int, token_id int, attn int"), spark.createDataFrame(cache, "sample_id int, first int, n int, embeds boolean")
    got = {}
    for r in layout.generation_step(t, c, 8).orderBy("sample_id", "step").collect():
        got.setdefault(r["sample_id"], []).append((r["step"], r["pos"], r["token_id"], r["source"], r["position_id"], r["mask"]))
    assert got == want
    assert "mask" not in layout.generation_step(t, c).columns
    assert layout.generation_step(t.limit(0), c, 8).count() == 0


def test_mask_forms(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (1, 1)], "s int, attn int")
    forms = {k: {r["s"]: r["mask"] for r in attention.mask_form(df, "s", "attn", k).collect()} for k in ("flash", "sdpa", "eager")}
    assert forms == {"flash": {0: "padding", 1: "none"}, "sdpa": {0: "full", 1: "none"}, "eager": {0: "full", 1: "full"}}
    with pytest.raises(ValueError):
        attention.mask_form_of("attn", "other")


def test_autoencode():
    rng = np.random.default_rng(0)
    encode = kernels.init_weights(kernels.autoencoder_shapes(3, 2, [4, 4], False), seed=1, std=0.3)
    decode = kernels.init_weights(kernels.autoencoder_shapes(3, 2, [4, 4], True), seed=2, std=0.3)
    x = rng.normal(size=(3, 8, 8))
    image, moments = kernels.autoencode(x, encode, decode, 2, 2)
    assert image.shape == x.shape and moments.shape == (4, 4, 4)
    assert np.allclose(image, kernels.decoder(moments[:2], decode, 2, 2))
    noise, shift = rng.normal(size=(2, 2, 4, 4))
    z = kernels.posterior(moments, noise) + shift
    assert np.allclose(kernels.autoencode(x, encode, decode, 2, 2, noise, shift)[0], kernels.decoder(z, decode, 2, 2))
