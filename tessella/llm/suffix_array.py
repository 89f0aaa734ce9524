"""Suffix arrays by linear grouping (Baier, 2016), in plain Python over integer symbols."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of the suffixes in lexicographic order; a suffix that is a prefix of another comes first.

    First the suffixes are grouped by their longest Lyndon prefix: groups begin as the symbols' buckets and
    are taken from the greatest down; each member points to the nearest place before it whose group is less,
    and places that are pointed at are moved, by how often, into new groups right above their own. Then the
    order inside the groups is read off from the smallest suffix up, following the same pointers.
    """
    n = len(symbols) + 1  # an end symbol, less than all others
    if n == 1:
        return np.empty(0, np.int64)
    _, ranks = np.unique(symbols, return_inverse=True)
    values = np.append(ranks.astype(np.int64) + 1, 0)
    order = np.argsort(values, kind="stable")
    sizes = np.bincount(values)
    begins = np.cumsum(sizes) - sizes
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = begins[values].tolist()  # each suffix's group, named by where it begins in ``order``
    size = np.zeros(n, np.int64)
    size[begins] = sizes
    size, order, place = size.tolist(), order.tolist(), place.tolist()
    before = [-1] * n

    end = n
    while end:
        begin = group[order[end - 1]]
        members = order[begin:end] if end - begin == 1 else sorted(order[begin:end])
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= begin:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        end = begin
        if not pointed:
            continue
        by_count: dict[int, list[int]] = {}
        for j, c in pointed.items():
            by_count.setdefault(c, []).append(j)
        for level in (by_count[c] for c in sorted(by_count, reverse=True)):
            moved: dict[int, int] = {}
            for j in level:
                g = group[j]
                k = moved[g] = moved.get(g, 0) + 1
                at, to = place[j], g + size[g] - k  # swap to the end of the group
                other = order[to]
                order[to], order[at] = j, other
                place[j], place[other] = to, at
            for g, k in moved.items():
                left = size[g] - k
                if left:
                    new = g + left
                    size[g], size[new] = left, k
                    for x in range(new, new + k):
                        group[order[x]] = new

    out = [-1] * n
    out[0] = n - 1
    taken = [0] * n  # how many of a group are placed
    for x in range(n):
        j = out[x] - 1
        while j >= 0:
            if place[j] < 0:  # placed already, and so is what it points to
                break
            g = group[j]
            out[g + taken[g]] = j
            taken[g] += 1
            place[j] = -1
            j = before[j]
    return np.array(out[1:], np.int64)

