"""Suffix arrays by linear grouping.

Phase 1 sorts the suffixes into groups of equal longest Lyndon prefix.  It starts from groups of
equal first symbol and takes the groups in descending order.  Each suffix of the group gets a
pointer to the last position before it in a lower group (its previous smaller one), found along the
pointers of what lies between.  A suffix pointed to has this group's word appended to its own, once
for each pointer, so it leaves its group for a new one right behind it; more copies, further behind.

Phase 2 takes the suffixes in their final order.  The suffixes whose Lyndon prefix ends where the
current suffix begins are the position before it and the chain of previous smaller ones from there,
as far as not placed yet; each goes to the next free place of its group.  Nothing is renamed and no
text is reduced recursively.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    n = len(text)
    symbols = np.array(text, np.int64)
    order = np.argsort(symbols.astype(np.uint16) if n and symbols.min() >= 0 and symbols.max() < 1 << 16 else symbols, kind="stable").tolist()  # radix sort of small symbols
    group, size, at = [0] * n, [0] * n, [0] * n
    for x, i in enumerate(order):
        group[i] = group[order[x - 1]] if x and text[order[x - 1]] == text[i] else x
        size[group[i]] += 1
        at[i] = x
    prev: list[int | None] = [None] * n
    end = n - 1
    while end >= 0:
        g = group[order[end]]
        if g == end:  # a single suffix, as most are in the end
            i = order[g]
            if (p := prev[i]) is None:
                p = i - 1
                while p >= 0 and group[p] >= g:
                    p = prev[p]
                prev[i] = p
            if p >= 0:
                h = group[p]
                size[h] -= 1
                last = h + size[h]
                other = order[last]
                order[at[p]], order[last], at[other], at[p] = other, p, at[p], last
                group[p] = last
                size[last] += 1
            end = g - 1
            continue
        copies: dict[int, int] = {}
        for x in range(g, end + 1):
            if prev[order[x]] is None:
                passed, p = [order[x]], order[x] - 1
                while p >= 0 and group[p] >= g:
                    if prev[p] is None:  # of the same group: it gets the same pointer
                        passed.append(p)
                        p -= 1
                    else:
                        p = prev[p]
                for i in passed:
                    prev[i] = p
        for x in range(g, end + 1):
            if (p := prev[order[x]]) >= 0:
                copies[p] = copies.get(p, 0) + 1
        by_copies: dict[int, list[int]] = {}
        for p, c in copies.items():
            by_copies.setdefault(c, []).append(p)
        for c in sorted(by_copies, reverse=True) if len(by_copies) > 1 else by_copies:
            for p in by_copies[c]:
                h = group[p]
                size[h] -= 1
                last = h + size[h]
                other = order[last]
                order[at[p]], order[last], at[other], at[p] = other, p, at[p], last
            for p in by_copies[c]:
                group[p] += size[group[p]]
            for p in by_copies[c]:
                size[group[p]] += 1
        end = g - 1
    out, free, placed = [0] * n, list(range(n)), [False] * n
    for x in range(-1, n):
        j = (out[x] if x >= 0 else n) - 1
        while j >= 0 and not placed[j]:
            out[free[group[j]]] = j
            free[group[j]] += 1
            placed[j] = True
            j = prev[j]
    return out


def equal_runs(text: np.ndarray, valid: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place of the suffix array, whether its suffix and the one before agree in ``length`` symbols (valid ones only)."""
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        at = np.flatnonzero(valid[order[1:]] & valid[order[:-1]]) + 1
        for k in range(length):
            at = at[text[order[at] + k] == text[order[at - 1] + k]]
        same[at] = True
    return same
