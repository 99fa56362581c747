"""Suffix arrays of many short texts at once, by Lyndon groups.

Phase one groups every text's suffixes by their longest Lyndon prefix. Groups begin as the
suffixes of equal first symbol and are treated from the greatest down. A group's members
are extensions of their previous smaller suffixes, found over pointers of greater groups:
those suffixes leave for new groups just above what stays of their own, the higher the
more members extend them. Groups are intervals of the suffix array, so nothing is renamed.
Phase two walks the array upward: the suffix just placed is the next smaller one of the
suffix before it and of that one's chain of previous smaller suffixes, as far as they are
not placed yet; each goes to the next free slot of its group.

Both phases are linear in a text's length. All texts of a batch take their steps together.
"""

from __future__ import annotations

import numpy as np


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin .. begin + size - 1 of all ranges in a row."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def groups(symbols: np.ndarray, offsets: np.ndarray):
    """(suffix array sorted by group, group start of every suffix, previous smaller suffix).

    ``symbols`` holds all texts, each ending in a symbol 0 that it holds nowhere else;
    ``offsets`` their starts and the end. Suffixes and places count over the whole batch.
    """
    n, texts = len(symbols), len(offsets) - 1
    text = np.repeat(np.arange(texts), np.diff(offsets))
    sa = np.lexsort((symbols, text))
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = (symbols[sa[1:]] != symbols[sa[:-1]]) | (text[sa[1:]] != text[sa[:-1]])
    heads = np.flatnonzero(fresh)
    size = np.zeros(n, np.int64)
    size[heads] = np.diff(np.append(heads, n))
    start = np.empty(n, np.int64)
    start[sa] = np.repeat(heads, size[heads])
    before = np.full(n, -1, np.int64)
    moving = np.zeros(n, bool)
    top, low = offsets[1:].copy(), offsets[:-1]
    live = np.flatnonzero(top > low)
    while len(live):
        head = start[sa[top[live] - 1]]
        count = top[live] - head
        own = sa[_ranges(head, count)]
        bound = np.repeat(head, count)
        first = np.repeat(low[live], count)
        top[live] = head
        live = live[head > low[live]]
        # Previous smaller suffix: jump over greater groups, stop at a member of this one.
        at = own - 1
        todo = np.flatnonzero(at >= first)
        at[at < first] = -1
        while len(todo):
            todo = todo[start[at[todo]] > bound[todo]]
            at[todo] = before[at[todo]]
            todo = todo[at[todo] >= 0]
        before[own] = at
        todo = np.flatnonzero(at >= 0)
        todo = todo[start[at[todo]] == bound[todo]]
        while len(todo):
            at[todo] = before[at[todo]]
            before[own[todo]] = at[todo]
            todo = todo[at[todo] >= 0]
            todo = todo[start[at[todo]] == bound[todo]]
        at = at[at >= 0]
        if not len(at):
            continue
        movers, times = np.unique(at, return_counts=True)
        order = np.lexsort((times, start[movers]))
        movers, times = movers[order], times[order]
        home = start[movers]
        new_home = np.ones(len(movers), bool)
        new_home[1:] = home[1:] != home[:-1]
        heads = np.flatnonzero(new_home)
        counts = np.diff(np.append(heads, len(movers)))
        region = home[heads] + size[home[heads]] - counts
        target = _ranges(region, counts)
        moving[movers] = True
        there = sa[target]
        pushed = there[~moving[there]]
        was = place[movers]
        free = was[was < np.repeat(region, counts)]
        sa[free], place[pushed] = pushed, free
        sa[target], place[movers] = movers, target
        moving[movers] = False
        size[home[heads]] -= counts
        new_home[1:] |= times[1:] != times[:-1]
        heads = np.flatnonzero(new_home)
        counts = np.diff(np.append(heads, len(movers)))
        size[target[heads]] = counts
        start[movers] = np.repeat(target[heads], counts)
    return sa, start, before


def suffix_arrays(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The suffix arrays of all texts in a row; see ``groups`` for the arguments."""
    _, start, before = groups(symbols, offsets)
    n = len(symbols)
    slot = np.arange(n)  # next free place of the group that starts here
    out = np.full(n, -1, np.int64)
    placed = np.zeros(n, bool)
    low, size = offsets[:-1], np.diff(offsets)
    last = offsets[1:] - 1
    out[low] = last
    placed[last] = True
    slot[low] += 1
    order = np.argsort(-size, kind="stable")
    low, size = low[order], size[order]
    for step in range(int(size.max()) if len(size) else 0):
        live = np.searchsorted(-size, -step, "left")  # texts longer than ``step``
        k = out[low[:live] + step]
        at = k - 1
        at = at[k > low[:live]]
        at = at[~placed[at]]
        while len(at):
            home = start[at]
            out[slot[home]] = at
            slot[home] += 1
            placed[at] = True
            at = before[at]
            at = at[at >= 0]
            at = at[~placed[at]]
    return out
