"""Linear suffix sorting by grouping.

Suffixes are put into groups by their Lyndon prefixes, from the highest group down: the suffixes of a
group are seen from the next smaller suffix before each, and those are moved, by how often they are
pointed to, to new groups behind their old ones. In the second pass each group's order follows from the
suffixes already placed. No name is computed and no text is reduced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes in order; the last symbol must be the smallest and occur once."""
    n = len(text)
    if n == 0:
        return []
    group_of, start, size, members, place = _by_first_symbol(text)
    before = [-1] * n
    high = n
    while high > 0:
        group = group_of[members[high - 1]]
        low = start[group]
        high = low
        if size[group] == 1:
            i = members[low]
            j = i - 1
            while j >= 0 and start[group_of[j]] >= low:
                j = before[j]
            before[i] = j
            if j >= 0 and size[group_of[j]] > 1:
                _split((j,), group_of, start, size, members, place)
            continue
        rows = sorted(members[low:low + size[group]])
        pointed: dict[int, int] = {}
        for i in rows:
            j = i - 1
            while j >= 0 and start[group_of[j]] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, count in pointed.items():
            by_count.setdefault(count, []).append(j)
        for count in sorted(by_count, reverse=True):
            _split(by_count[count], group_of, start, size, members, place)
    return _ordered(n, group_of, start, before)


def _by_first_symbol(text):
    symbols = np.asarray(text)
    members = np.argsort(symbols, kind="stable")
    new = np.diff(symbols[members], prepend=symbols[members[0]] - 1) != 0
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(symbols)))
    group_of, place = np.empty_like(members), np.empty_like(members)
    group_of[members] = np.cumsum(new) - 1
    place[members] = np.arange(len(symbols))
    return group_of.tolist(), start.tolist(), size.tolist(), members.tolist(), place.tolist()


def _split(rows, group_of, start, size, members, place) -> None:
    """Move the rows of each group to a new group right behind it."""
    fresh: dict[int, int] = {}
    for j in rows:
        old = group_of[j]
        new = fresh.get(old)
        if new is None:
            if size[old] == 1:
                continue  # alone already
            new = fresh[old] = len(start)
            start.append(start[old] + size[old])
            size.append(0)
        # swap with the last row of the old group, which then shrinks by one
        edge = start[old] + size[old] - 1
        other, at = members[edge], place[j]
        members[at], members[edge] = other, j
        place[other], place[j] = at, edge
        size[old] -= 1
        size[new] += 1
        start[new] = edge
        group_of[j] = new


def _ordered(n, group_of, start, before) -> list[int]:
    out = [-1] * n
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            group = group_of[j]
            out[start[group]] = j
            start[group] += 1
            placed[j] = True
            j = before[j]
    return out
