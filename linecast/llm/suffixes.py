"""Suffix arrays by linear grouping, for many strings at once.

Method (G. Baier, "Linear-time suffix sorting - a new approach for suffix array construction").
Phase 1 gathers suffixes with the same longest Lyndon prefix in one group, with the groups in order:
groups start as first characters and are processed in descending order; each suffix of the current
group finds its previous-smaller pointer, the closest earlier suffix in a lower group, and the
suffixes pointed at leave their groups for new ones right behind, ordered by how many pointers they
got. Phase 2 walks the array from the smallest suffix up and puts the suffix before each entry, and
then those along its previous-smaller pointers, to the front of their groups. No names are assigned
and nothing recurses.

Each step handles one group (phase 1) or one entry (phase 2) of *every* string in numpy, so the
work per character is constant and Python's overhead is shared by all strings of a batch.
"""

from __future__ import annotations

import numpy as np


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start[i] .. start[i] + size[i] - 1`` for all ``i``, one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(total) + np.repeat(start - ends + size, size)


def lyndon_groups(text: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1. ``text``: characters of all strings, each ended by a unique smallest character;
    ``off``: bounds of the strings. Returns each suffix's group (its first slot) and its pointer."""
    n = len(text)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    key = owner * 65536 + text
    sa = np.argsort(key, kind="stable")
    slot = np.empty(n, np.int64)
    slot[sa] = np.arange(n)
    new = np.append(True, key[sa][1:] != key[sa][:-1]) if n else np.zeros(0, bool)
    first = np.flatnonzero(new)
    grp = np.empty(n, np.int64)
    grp[sa] = np.repeat(first, np.diff(np.append(first, n)))
    gend = np.zeros(n + 1, np.int64)
    gend[first] = np.append(first[1:], n)
    prev = np.arange(n) - 1
    prev[off[:-1]] = -1
    grp_at = np.append(grp, -1)  # grp_at[-1]: below every group
    low, high = off[:-1].copy(), off[1:].copy()
    moving = np.zeros(n, bool)
    while True:
        live = high > low
        if not live.all():  # strings of a batch are of similar length, and most end together
            low, high = low[live], high[live]
        if not len(low):
            return grp_at[:-1], prev
        start = grp_at[sa[high - 1]]
        mem = sa[ragged(start, high - start)]
        high = start
        mine = grp_at[mem]
        todo, want = mem, mine
        while len(todo):
            j = prev[todo]
            up = grp_at[j] >= want
            todo, want, j = todo[up], want[up], j[up]
            prev[todo] = prev[j]
        to = np.sort(prev[mem])
        to = to[np.searchsorted(to, 0) :]  # without pointers to nothing
        if not len(to):
            continue
        edge = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        to, count = to[edge], np.diff(np.append(edge, len(to)))
        h = grp_at[to]
        order = np.argsort(h * (n + 1) + count, kind="stable")
        to, count, h = to[order], count[order], h[order]
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        moved = np.diff(np.append(edge, len(h)))
        end = gend[h[edge]]
        target = ragged(end - moved, moved)
        # what stays but sits where the moved ones go takes the places these leave
        leaving = slot[to]
        gap = np.sort(leaving[leaving < np.repeat(end - moved, moved)])
        there = sa[target]
        moving[to] = True
        stay = there[~moving[there]]  # groups are apart, so both lists come group by group
        moving[to] = False
        sa[gap] = stay
        slot[stay] = gap
        sa[target] = to
        slot[to] = target
        run = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (count[1:] != count[:-1])))
        size = np.diff(np.append(run, len(h)))
        gend[h[edge]] = end - moved
        gend[target[run]] = target[run] + size
        grp_at[to] = np.repeat(target[run], size)


def suffix_arrays(text: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Suffix arrays of all strings, in the strings' slots; entries are places in ``text``."""
    grp, prev = lyndon_groups(text, off)
    n = len(text)
    out = np.full(n, -1)
    front = np.arange(n)  # next free slot of the group that begins here
    placed = np.zeros(n + 1, bool)
    placed[-1] = True  # pointer -1: nothing there
    begin = off[:-1].copy()
    out[begin] = off[1:] - 1  # the end is the smallest suffix
    placed[off[1:] - 1] = True
    i, stop = begin.copy(), off[1:]
    s = np.where(out[i] > begin, out[i] - 1, -1)
    while len(i):
        go = ~placed[s]
        p = s[go]
        g = grp[p]
        out[front[g]] = p
        front[g] += 1
        placed[p] = True
        s[go] = prev[p]
        rest = ~go
        i[rest] += 1
        keep = i < stop
        if not keep.all():
            i, stop, begin, s, rest = i[keep], stop[keep], begin[keep], s[keep], rest[keep]
        at = out[i[rest]]
        s[rest] = np.where(at > begin[rest], at - 1, -1)
    return out
