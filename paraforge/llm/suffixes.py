"""Suffix arrays by linear grouping: Lyndon-prefix groups first, then the order within them."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of a string of non-negative integers in lexicographic order.

    Phase 1 groups suffixes by their longest Lyndon prefix. Groups start as first symbols and are taken in descending order.
    For each suffix of a group the nearest earlier suffix of a lower group is found over previous-smaller pointers;
    those found k times extend their prefix by the group's k times, and so form a group of their own at the upper
    end of the group they leave. Phase 2 takes suffixes in ascending order; a suffix places those whose
    Lyndon prefix ends just before it, which the pointers chain up, at the front of their groups. Nothing is
    renamed or sorted again."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    new_group = np.concatenate([[True], np.diff(symbols[order]) != 0])
    first = np.maximum.accumulate(np.where(new_group, np.arange(n), 0))
    group_np = np.empty(n, np.int64)
    group_np[order] = first
    place_np = np.empty(n, np.int64)
    place_np[order] = np.arange(n)
    sa, group, place = order.tolist(), group_np.tolist(), place_np.tolist()
    size_np = np.zeros(n, np.int64)
    starts = np.flatnonzero(new_group)
    size_np[starts] = np.diff(np.concatenate([starts, [n]]))
    size = size_np.tolist()
    previous = _group(sa, group, place, size, n)
    return np.array(_order(group, previous, n), dtype=np.int64)


def _group(sa: list[int], group: list[int], place: list[int], size: list[int], n: int) -> list[int]:
    """Phase 1: leaves the groups' starts in `group`; gives the previous-smaller pointers."""
    previous = [-1] * n
    end = n
    while end:
        start = group[sa[end - 1]]
        if end - start == 1:
            s = sa[start]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                old = group[p]
                count = size[old]
                if count > 1:
                    last = old + count - 1
                    at, other = place[p], sa[last]
                    sa[at], sa[last] = other, p
                    place[other], place[p] = at, last
                    size[old] = count - 1
                    group[p] = last
                    size[last] = 1
            end = start
            continue
        hits: dict[int, int] = {}
        for s in sorted(sa[start:end]):
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        end = start
        if not hits:
            continue
        #: By how often they were found, most often first; those of one group and number stay together.
        if len(hits) == 1:
            rounds = [list(hits)]
        else:
            by_count: dict[int, list[int]] = {}
            for p, k in hits.items():
                by_count.setdefault(k, []).append(p)
            rounds = [by_count[k] for k in sorted(by_count, reverse=True)]
        for found in rounds:
            moved: dict[int, int] = {}
            for p in found:
                old = group[p]
                k = moved.get(old, 0)
                moved[old] = k + 1
                last = old + size[old] - 1 - k
                at, other = place[p], sa[last]
                sa[at], sa[last] = other, p
                place[other], place[p] = at, last
            for old, k in moved.items():
                left = size[old] - k
                if left:
                    fresh = old + left
                    size[old], size[fresh] = left, k
                    for i in range(fresh, fresh + k):
                        group[sa[i]] = fresh
    return previous


def _order(group: list[int], previous: list[int], n: int) -> list[int]:
    """Phase 2: the suffix array from the groups and the pointers."""
    sa = [-1] * n
    front = list(range(n))  # the next free place of the group that starts here
    placed = [False] * n

    def place_chain(j: int) -> None:
        while j >= 0 and not placed[j]:
            start = group[j]
            sa[front[start]] = j
            front[start] += 1
            placed[j] = True
            j = previous[j]

    place_chain(n - 1)  # those whose prefix ends with the string: the empty suffix is the least
    for i in range(n):
        j = sa[i] - 1
        while j >= 0 and not placed[j]:
            start = group[j]
            sa[front[start]] = j
            front[start] += 1
            placed[j] = True
            j = previous[j]
    return sa
