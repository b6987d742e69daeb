"""Suffix trees of number sequences (Ukkonen), and common extensions in constant time by the Euler tour."""

from __future__ import annotations

import numpy as np

_OPEN = 1 << 60  # the end of a leaf's edge while the tree grows


def _ukkonen(s: list[int], width: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Edges ``node * width + symbol -> child`` of the suffix tree of ``s``, and where each node's edge label begins and ends.

    ``s`` ends with a symbol that stands nowhere else; symbols are below ``width``. Node 0 is the root.
    """
    go: dict[int, int] = {}
    first, last, link = [0], [0], [0]
    node = length = at = waiting = 0  # the active point: ``length`` symbols below ``node``, on the edge that begins with s[at]
    for i, symbol in enumerate(s):
        waiting += 1
        fresh = 0  # an inner node made in this phase whose suffix link is still open
        while waiting:
            if not length:
                at = i
            key = node * width + s[at]
            child = go.get(key)
            if child is None:
                go[key] = len(first)
                first.append(i)
                last.append(_OPEN)
                link.append(0)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                begin = first[child]
                end = last[child]
                size = (end if end != _OPEN else i + 1) - begin
                if length >= size:
                    node = child
                    length -= size
                    at += size
                    continue
                if s[begin + length] == symbol:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                inner = len(first)
                first += (begin, i)
                last += (begin + length, _OPEN)
                link += (0, 0)
                go[key] = inner
                first[child] = begin + length
                go[inner * width + s[begin + length]] = child
                go[inner * width + symbol] = inner + 1
                if fresh:
                    link[fresh] = inner
                fresh = inner
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - waiting + 1
    return go, first, last


class SuffixTree:
    """The suffix tree of ``s`` (numbers of at least 1), walked once.

    ``rank[i]`` is the place of suffix i among all in ascending order (a prefix comes first). ``common(i, j)`` is the length
    of the longest common prefix of the suffixes i and j: the least string depth between their leaves in the Euler tour is
    that of their lowest common ancestor, and minima of stretches of 2^k entries answer any stretch at once.
    """

    def __init__(self, s: list[int]):
        n = len(s) + 1
        width = max(s, default=0) + 1
        go, first, last = _ukkonen([*s, 0], width)
        nodes = len(first)
        keys = np.fromiter(go.keys(), np.int64, len(go))
        order = np.argsort(keys)
        begin = np.searchsorted(keys[order], np.arange(nodes + 1) * width).tolist()
        children = np.fromiter(go.values(), np.int64, len(go))[order].tolist()
        depth = [0] * nodes
        tour: list[int] = []  # string depths along the Euler tour
        place = np.zeros(n, np.int64)  # where the leaf of each suffix stands in it
        leaves: list[int] = []
        path, following = [0], begin[:-1]
        tour.append(0)
        while path:
            node = path[-1]
            k = following[node]
            if k == begin[node + 1]:
                path.pop()
                if path:
                    tour.append(depth[path[-1]])
                continue
            following[node] = k + 1
            child = children[k]
            if last[child] == _OPEN:
                size = depth[node] + n - first[child]
                leaves.append(n - size)
                place[n - size] = len(tour)
                tour.append(size)
                tour.append(depth[node])
            else:
                depth[child] = depth[node] + last[child] - first[child]
                tour.append(depth[child])
                path.append(child)
        self.rank = np.zeros(n, np.int64)
        self.rank[leaves] = np.arange(n)
        self._place = place
        row = np.array(tour, np.int32)
        self._least = np.empty((len(row).bit_length(), len(row)), np.int32)  # row k: the minimum of 2^k entries
        self._least[0] = row
        for k in range(1, len(self._least)):
            half = 1 << (k - 1)
            self._least[k] = self._least[k - 1]
            np.minimum(self._least[k - 1, : len(row) - half], self._least[k - 1, half:], out=self._least[k, : len(row) - half])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefixes of the suffixes ``i`` and ``j``, which differ."""
        left, right = np.minimum(self._place[i], self._place[j]), np.maximum(self._place[i], self._place[j])
        k = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        return np.minimum(self._least[k, left], self._least[k, right - (1 << k) + 1]).astype(np.int64)
