"""Suffix arrays by linear grouping construction, over many strings at once.

First phase: suffixes are grouped by first symbol and the groups are taken from the largest down.  Every member of the
group in hand looks for its previous smaller suffix (the nearest suffix to the left in a smaller group); that suffix's known
Lyndon prefix grows by the group's, so within its own group it moves up into a new group, behind those that gain fewer
copies.  At the end each group holds the suffixes with one Lyndon prefix.  Second phase: suffixes are read in ascending order,
and each puts the suffix before it, and that one's chain of previous smaller suffixes, at the front of what is left of
their groups.  No string is renamed or solved recursively.

All strings advance in step: one group of each string per round, as NumPy operations over the members of all of them.
A string ends with its smallest symbol, which occurs nowhere else in it.
"""

from __future__ import annotations

import numpy as np


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``count`` steps, then the next run."""
    return np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)


def _groups(x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place where the suffix's group begins in the array, previous smaller suffix or -1), per suffix."""
    n = len(x)
    string = np.repeat(np.arange(len(start) - 1), np.diff(start))
    sa = np.argsort(string * (int(x.max()) + 1) + x, kind="stable")
    first = np.ones(n, bool)
    first[1:] = (x[sa][1:] != x[sa][:-1]) | (string[sa][1:] != string[sa][:-1])
    begins = np.flatnonzero(first)
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(begins, np.diff(np.append(begins, n)))
    end = np.zeros(n + 1, np.int64)
    end[begins] = np.append(begins[1:], n)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    previous, jump, touched = np.full(n, -1), np.full(n, -1), np.zeros(n, bool)
    base, now = start[:-1].copy(), group[sa[start[1:] - 1]]
    while len(base):
        count = end[now] - now
        s = sa[_runs(now, count)]
        low, own = np.repeat(base, count), np.repeat(now, count)
        p = s - 1
        far = np.flatnonzero((p >= low) & (group[p] > own))
        while len(far):  # over suffixes of larger groups, which know their previous smaller one
            p[far] = previous[p[far]]
            far = far[(p[far] >= low[far]) & (group[p[far]] > own[far])]
        same = np.flatnonzero((p >= low) & (group[p] == own))
        if len(same):  # over members of the same group: pointer doubling
            jump[s] = p
            while len(same):
                p[same] = jump[p[same]]
                jump[s[same]] = p[same]
                same = same[(p[same] >= low[same]) & (group[p[same]] == own[same])]
        found = p >= low
        previous[s] = np.where(found, p, -1)

        grown, copies = np.unique(p[found], return_counts=True)
        if len(grown):
            order = np.lexsort((copies, group[grown]))
            grown, copies = grown[order], copies[order]
            old = group[grown]
            head = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
            k = np.diff(np.append(head, len(grown)))
            stop = end[old[head]]
            cut = stop - k
            slots = _runs(cut, k)
            touched[grown] = True
            displaced = sa[slots][~touched[sa[slots]]]
            at = place[grown]
            vacant = at[at < np.repeat(cut, k)]
            sa[vacant], place[displaced] = displaced, vacant
            sa[slots], place[grown] = grown, slots
            touched[grown] = False
            fresh = np.concatenate([[True], (old[1:] != old[:-1]) | (copies[1:] != copies[:-1])])
            at = np.flatnonzero(fresh)
            size = np.diff(np.append(at, len(grown)))
            end[old[head]] = cut
            end[slots[at]] = slots[at] + size
            group[grown] = np.repeat(slots[at], size)
        more = now > base
        base = base[more]
        now = group[sa[now[more] - 1]]
    return group, previous


def suffix_arrays(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Positions in ``x`` of all suffixes, each string's (start[i] .. start[i + 1] - 1) in ascending order."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    group, previous = _groups(x, start)
    out, front, put = np.full(n, -1), np.arange(n), np.zeros(n, bool)
    base, size = start[:-1], np.diff(start)
    last = start[1:] - 1
    out[base] = last
    put[last] = True
    front[base] += 1
    order = np.argsort(-size, kind="stable")  # long strings first, so those still running are a prefix
    base, size = base[order], size[order]
    for i in range(int(size.max())):
        running = int(np.searchsorted(-size, -i, side="left"))
        low = base[:running]
        p = out[low + i] - 1
        live = np.flatnonzero((p >= low))
        p, low = p[live], low[live]
        live = ~put[p]
        p, low = p[live], low[live]
        while len(p):
            g = group[p]
            out[front[g]] = p
            front[g] += 1
            put[p] = True
            p = previous[p]
            live = p >= low
            p, low = p[live], low[live]
            live = ~put[p]
            p, low = p[live], low[live]
    return out
