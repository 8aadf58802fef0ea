import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tokenloom.llm import turn_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, bucket long, rep long"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h]) + tuple(mine[h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if whole[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, **options):
    rows = [(*r, "clash", None, 7) for r in rows]
    got = sorted((tuple(r) for r in turn_trie.trie(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=repr)
    assert got == brute(rows)
    return got


def random_rows(seed, n, turns, words):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for c in range(n) for t in range(rng.randint(1, turns))]


@pytest.mark.parametrize("local_cells", [1, 30, 4096])
def test_random_conversations(spark, local_cells):
    check(spark, random_rows(local_cells, 60, 14, ["a", "b", "é", "", None]), local_cells=local_cells)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (3, None, None, None), (3, None, "user", "b"), (3, 0, "user", "b"), (3, 0, "user", "b"), (3, 0, "user", "a"), (-7, 1, "user", "n"), (-5, 1, "user", "n")]
    rows += [(40, t, "user", "w" * 100_000 + str(t)) for t in range(3)] + [(41, 0, "user", "only one turn"), (44, 0, "", ""), (2**62, 5, "user", "far")]
    check(spark, rows, local_cells=2)
    check(spark, rows)


def test_turnless_and_empty(spark):
    lone = next(c for c in range(1, 10**4) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 8)  # nothing of its own is left, and no base
    got = check(spark, [(lone, 0, "user", "gone")])
    assert [r[:4] for r in got] == [(lone, 0, None, 1)]
    assert check(spark, []) == []


def test_hot_copies_and_a_long_chain(spark, monkeypatch):
    """Copies share one sequence, and their list of members comes in many pieces; one conversation is longer than a bucket may be."""
    monkeypatch.setattr(turn_trie, "PIECE_BYTES", 20)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 600, 5) for t in range(3)]
    rows += [(10_000 + 5 * i, t, "user", f"long {t}") for i in range(2) for t in range(120 + 40 * i)]
    check(spark, rows, local_cells=16)


def test_multikey_alone():
    sequences = [(1, 1, 0, [0, 5, 6], [0, 2, 3]), (2, 3, 0, [0, 5, 7], [0, 2, 4]), (4, 1, 0, [0], [0]), (5, 1, 0, [0, 9], [0, 1])]
    nodes = {(x[0], x[1]): tuple(x[3:]) for x in turn_trie.multikey(sequences)}
    assert nodes == {(1, 0): (6, 2, 3, 0 + 3 * 2 + 2 * 4, 4), (1, 1): (4, 2, 2, 6 + 8, None), (1, 2): (1, 0, 1, 0, 1), (2, 2): (3, 0, 1, 8, 2), (5, 1): (1, 0, 1, 0, 5)}
