"""Suffix arrays of integer sequences by linear grouping.

First, suffixes are grouped by their longest Lyndon prefix. Groups are taken in descending
order; each member points at the nearest earlier suffix of a smaller group, and the suffixes
pointed at move, by how often, to new groups right after their old ones. Then one pass from
the smallest suffix on puts the members of each group in order: a suffix that has found its
place places the suffixes whose Lyndon prefix ends just before it, along the same pointers.
Nothing is renamed and there is no recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int] | np.ndarray) -> list[int]:
    """The starts of all suffixes in ascending order; the last symbol must be the smallest and occur once."""
    n = len(text)
    symbols = np.asarray(text)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    ends = np.concatenate([begins[1:], [n]])
    by_suffix, by_place = np.empty(n, np.int64), np.empty(n, np.int64)
    by_suffix[order], by_place[order] = np.arange(n), np.repeat(begins, ends - begins)
    place = order.tolist()
    at = by_suffix.tolist()  # where a suffix stands in `place`
    group = by_place.tolist()  # the first index of its group there
    last = [0] * n  # by first index: the last one
    for first, end in zip(begins.tolist(), ends.tolist(), strict=True):
        last[first] = end - 1
    smaller = [-1] * n

    end = n - 1
    while end >= 0:
        first = group[place[end]]
        targets = []
        for s in (place[end],) if first == end else sorted(place[first : end + 1]):
            p = s - 1
            while p >= 0 and group[p] >= first:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                targets.append(p)
        end = first - 1
        if len(targets) == 1 or len(targets) == 2 and group[targets[0]] != group[targets[1]]:
            for p in targets:  # each goes to the end of its old group, which is a group of its own then
                old = group[p]
                tail = last[old]
                if tail != old:
                    k, other = at[p], place[tail]
                    place[k] = other
                    at[other] = k
                    place[tail] = p
                    at[p] = group[p] = last[tail] = tail
                    last[old] = tail - 1
            continue
        hits: dict[int, int] = {}
        for p in targets:
            hits[p] = hits.get(p, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for p, count in hits.items():
            moves.setdefault((count, group[p]), []).append(p)
        for count, old in sorted(moves, reverse=True):
            tail = old_end = last[old]
            for p in moves[count, old]:
                k, other = at[p], place[tail]
                place[k], at[other] = other, k
                place[tail], at[p] = p, tail
                tail -= 1
            last[old] = tail
            new = tail + 1
            last[new] = old_end
            for p in moves[count, old]:
                group[p] = new
    free = list(range(n))  # by first index of a group: the next place to fill
    placed = [False] * n
    out = [-1] * n
    out[0], placed[n - 1] = n - 1, True
    free[group[n - 1]] += 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = smaller[j]
    return out
