import numpy as np

from tokenloom.llm import gsaca


def texts():
    rng = np.random.default_rng(0)
    out = [[], [3], [0, 0], [1] * 50, [1, 0] * 30, list(b"mississippi"), list(b"abracadabra" * 5), [0, 5, 0, 5, 0], list(range(20)), list(range(20, 0, -1))]
    for k in (2, 3, 5, 250):
        for n in (10, 57, 300):
            out += [rng.integers(0, k, n).tolist() for _ in range(25)]
    a, b = [1], [0]
    for _ in range(9):
        a, b = a + b, a
    return [*out, a]


def brute(t):
    return sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_array():
    for t in texts():
        assert gsaca.suffix_array(t) == brute(t)


def test_runs():
    rng = np.random.default_rng(1)
    for _ in range(20):
        t = rng.integers(0, 2, 200).astype(np.uint16)
        valid = np.arange(200) <= 200 - 5
        valid &= rng.random(200) < 0.8
        order = np.array(gsaca.suffix_array(t.tolist()))
        want = [x > 0 and bool(valid[order[x]] and valid[order[x - 1]]) and t[order[x] : order[x] + 5].tolist() == t[order[x - 1] : order[x - 1] + 5].tolist() for x in range(200)]
        assert gsaca.equal_runs(t, valid, order, 5).tolist() == want
