"""Suffix array of one bounded block by linear grouping, and the equal windows that can be read off it."""

from __future__ import annotations

import numpy as np


def suffix_array(data: bytes) -> list[int]:
    """Start of every suffix of ``data`` in lexicographic order (a suffix before its extensions).

    First phase: suffixes stand in groups by a common prefix, at first one byte. Groups are taken in descending
    order. Each member points to the nearest earlier suffix of a lower group; a suffix that is pointed to k times
    has a prefix that goes on with k times the group's prefix, so it leaves its group for a new one right above
    it, the higher the larger k. At the end the common prefix of a group is a Lyndon word and the pointers lead to the
    previous smaller suffix. Second phase: the ready part of the array is walked upward; the suffix before each entry,
    and then its chain of pointers, take the lowest free place of their groups. Nothing is renamed or sorted again.
    """
    n = len(data)
    if n < 2:
        return list(range(n))
    codes = np.frombuffer(data, np.uint8)
    place = np.argsort(codes, kind="stable")
    order: list[int] = place.tolist()
    rank = np.empty(n, np.int64)
    rank[place] = np.arange(n)
    where: list[int] = rank.tolist()
    sizes = np.bincount(codes, minlength=256)
    starts = np.cumsum(sizes) - sizes
    group: list[int] = starts[codes].tolist()  # the first place of a suffix's group
    size = [0] * n
    for first, count in zip(starts.tolist(), sizes.tolist(), strict=True):
        if count:
            size[first] = count
    before = [-1] * n

    high = n
    while high > 0:
        low = group[order[high - 1]]
        members = order[low:high]
        high = low
        if len(members) == 1:
            i = members[0]
            j = i - 1
            while j >= 0 and group[j] > low:
                j = before[j]
            before[i] = j
            if j >= 0:  # one suffix moves to the upper end of its group
                old = group[j]
                last = old + size[old] - 1
                if last != old:
                    at = where[j]
                    other = order[last]
                    order[at], where[other] = other, at
                    order[last], where[j] = j, last
                    size[old] -= 1
                    size[last] = 1
                    group[j] = last
            continue
        members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_times: dict[int, list[int]] = {}
        for j, times in pointed.items():
            by_times.setdefault(times, []).append(j)
        for times in sorted(by_times, reverse=True):
            ends: dict[int, int] = {}
            movers = by_times[times]
            for j in movers:
                old = group[j]
                last = ends.get(old)
                last = old + size[old] - 1 if last is None else last - 1
                ends[old] = last
                at = where[j]
                if at != last:
                    other = order[last]
                    order[at], where[other] = other, at
                    order[last], where[j] = j, last
            for j in movers:
                old = group[j]
                group[j] = ends[old]
            for old, last in ends.items():
                moved = size[old] - (last - old)
                size[old] = last - old
                size[last] = moved

    result = [-1] * n
    free = group  # from here on, entries at a group's first place tell its next free place
    step = [0] * n
    result[group[n - 1]] = n - 1
    step[group[n - 1]] = 1
    j = before[n - 1]
    while j >= 0:
        first = free[j]
        result[first + step[first]] = j
        step[first] += 1
        j = before[j]
    done = [False] * n
    j = n - 1
    while j >= 0:
        done[j] = True
        j = before[j]
    for i in range(n):
        j = result[i] - 1
        while j >= 0 and not done[j]:
            first = free[j]
            result[first + step[first]] = j
            step[first] += 1
            done[j] = True
            j = before[j]
    return result


def equal_windows(data: bytes, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(start, class)`` of the valid starts in suffix order; equal windows of ``length`` bytes share a class."""
    order = np.array(suffix_array(data), np.int64)
    order = order[valid[order]]
    if not len(order):
        return order, order
    codes = np.frombuffer(data, np.uint8)
    new = np.ones(len(order), bool)
    for a in range(1, len(order), 4096):
        b = min(a + 4096, len(order))
        views = np.lib.stride_tricks.sliding_window_view(codes, length)
        new[a:b] = (views[order[a:b]] != views[order[a - 1 : b - 1]]).any(axis=1)
    return order, np.cumsum(new) - 1
