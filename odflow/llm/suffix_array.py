"""Suffix sorting by grouping suffixes that share their longest Lyndon prefix.

After U. Baier, "Linear-time Suffix Sorting: a new approach for suffix array
construction" (CPM 2016). Phase one walks the groups from the highest to the
lowest. Each suffix i of a group points to prev(i), the last earlier position
whose group is lower; positions pointed to l times move, largest l first, to
a new group right after their own. Phase two emits the order from the lowest
group upwards, each emitted suffix placing its left neighbour and that one's
chain of prev pointers. There is no recursion and no renaming of symbols.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of symbols (non-negative integers) in lexicographic order.

    A suffix that is a prefix of another one comes first. Empty input gives an empty array.
    """
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    order, prev, start = _groups(np.asarray(symbols, np.int64))
    return np.asarray(_emit(n, prev, start), np.int64)


def _groups(symbols: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Phase one: (positions by group, prev pointers, first slot of each position's group).

    A group is a slice of `order`; its number is the slice's first slot, so
    comparing numbers compares groups, and a split keeps all other numbers.
    """
    n = len(symbols)
    by_symbol = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[by_symbol]
    first = np.searchsorted(sorted_symbols, symbols, "left")
    order, start = by_symbol.tolist(), first.tolist()
    slot = np.empty(n, np.int64)
    slot[by_symbol] = np.arange(n)
    slot = slot.tolist()
    stop = [0] * (n + 1)  # by group number: one past its last slot
    edges = np.flatnonzero(np.r_[True, sorted_symbols[1:] != sorted_symbols[:-1]]).tolist()
    for a, b in zip(edges, [*edges[1:], n], strict=True):
        stop[a] = b
    prev = [-1] * n

    end = n
    while end > 0:
        group = start[order[end - 1]]
        if end - group == 1:  # alone: at most one position points from here
            i = order[group]
            p = i - 1
            while p >= 0 and start[p] >= group:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                g = start[p]
                last = stop[g] - 1
                if last > g:
                    at, other = slot[p], order[last]
                    order[at], order[last] = other, p
                    slot[other], slot[p] = at, last
                    stop[g] = last
                    start[p] = last
                    stop[last] = last + 1
            end = group
            continue
        members = sorted(order[group:end])
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and start[p] >= group:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        times: dict[int, list[int]] = {}
        for p, k in pointed.items():
            times.setdefault(k, []).append(p)
        for k in sorted(times, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in times[k]:
                moved.setdefault(start[p], []).append(p)
            for g, these in moved.items():
                last = stop[g]
                if last - g == len(these):
                    continue  # the whole group moves: its order among the groups stays
                top = last
                for p in these:
                    last -= 1
                    at, other = slot[p], order[last]
                    order[at], order[last] = other, p
                    slot[other], slot[p] = at, last
                stop[g] = last
                stop[last] = top
                for p in these:
                    start[p] = last
        end = group
    return order, prev, start


def _emit(n: int, prev: list[int], start: list[int]) -> list[int]:
    """Phase two: fill the groups from the lowest up, following prev from each emitted suffix's left neighbour."""
    out = [-1] * n
    free = list(range(n + 1))  # by group number: its next free slot
    placed = bytearray(n)

    def place(s: int) -> None:
        while s >= 0 and not placed[s]:
            placed[s] = 1
            g = start[s]
            out[free[g]] = s
            free[g] += 1
            s = prev[s]

    place(n - 1)  # the left neighbour of the empty suffix, which is the smallest of all
    for i in range(n):
        place(out[i] - 1)
    return out


def common_at_least(symbols: np.ndarray, order: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each neighbouring pair of the order: do the two suffixes share need[i] symbols (of the later one's start)?"""
    n, same = len(symbols), np.ones(max(len(order) - 1, 0), bool)
    a, b = order[:-1], order[1:]
    want = need[b]
    for k in range(int(want.max(initial=0))):
        inside = (a + k < n) & (b + k < n)
        equal = np.zeros(len(a), bool)
        equal[inside] = symbols[a[inside] + k] == symbols[b[inside] + k]
        same &= equal | (k >= want)
    return same
