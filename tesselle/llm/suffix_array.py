"""Suffix arrays by linear grouping (public literature: Baier 2016, "Linear-time suffix sorting").

Phase one sorts suffixes into groups that share their Lyndon prefix. It visits groups in descending order; each suffix
of the group in hand points at its previous smaller suffix, and these parents move above the rest of their own group,
the more children the higher. Phase two walks the array in ascending order and puts each suffix into the next free
place of its group. Nothing is renamed and there is no recursion.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def suffix_array(codes: list[int]) -> list[int]:
    """The start positions of the sorted suffixes of `codes`, whose last value must be its only smallest one.

    An empty list gives an empty list. Equal texts give equal arrays; there are no ties between suffixes.
    """
    n = len(codes)
    if not n:
        return []
    place, at = {}, 0
    for value, count in sorted(Counter(codes).items()):
        place[value] = at
        at += count
    #: A group is named by the first of its places, so names compare as groups do.
    group = [place[x] for x in codes]
    members: list[list[int] | None] = [None] * n
    for i, g in enumerate(group):
        if members[g] is None:
            members[g] = [i]
        else:
            members[g].append(i)
    size = [len(x) if x else 0 for x in members]
    smaller = [-1] * n
    for now in range(n - 1, 0, -1):
        here = members[now]
        if here is None:
            continue
        members[now] = None
        parents: dict[int, int] = {}
        for i in here if len(here) == 1 else sorted(here):
            if group[i] != now:
                continue  # it has moved up since
            p = i - 1
            while group[p] >= now:  # group[-1] is the sentinel's, the lowest
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                parents[p] = parents.get(p, 0) + 1
        if not parents:
            continue
        if len(parents) == 1:
            ((p, _),) = parents.items()
            old = group[p]
            if size[old] > 1:
                size[old] -= 1
                new = old + size[old]
                size[new] = 1
                group[p] = new
                members[new] = [p]
            continue
        moved: dict[int, list[tuple[int, int]]] = {}
        for p, count in parents.items():
            moved.setdefault(group[p], []).append((count, p))
        for old, pairs in moved.items():
            pairs.sort()
            rest = size[old] - len(pairs)
            if not rest and pairs[0][0] == pairs[-1][0]:
                continue  # the whole group moves as one: its order is unchanged
            at, start, last = old + rest, old + rest, pairs[0][0]
            size[old] = rest
            if not rest:
                members[old] = []
            for count, p in pairs:
                if count != last:
                    size[start], start, last = at - start, at, count
                group[p] = start
                if members[start] is None or at == start:
                    members[start] = [p]
                else:
                    members[start].append(p)
                at += 1
            size[start] = at - start
    free = list(range(n))
    out = [-1] * n
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            placed[i] = True
            i = smaller[i]
    return out


def window_classes(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All starts of `width`-byte windows within the strings, as (string number, offset, class).

    Two windows have the same class if and only if their bytes are equal. Strings shorter than `width` have none.
    """
    lengths = np.array([len(x) for x in strings], np.int64)
    joined = b"".join(x + b"\0" for x in strings)
    raw = np.frombuffer(joined, np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    codes = raw.astype(np.int16) + 2
    codes[starts + lengths] = 1  # between strings
    order = np.array(suffix_array([*codes.tolist(), 0])[1:], np.int64)
    number = np.repeat(np.arange(len(strings)), lengths + 1)
    offset = np.arange(len(raw)) - starts[number]
    order = order[offset[order] + width <= lengths[number[order]]]
    if not len(order):
        return order, order, order
    windows = np.lib.stride_tricks.sliding_window_view(raw, width)
    fresh = np.empty(len(order), bool)
    fresh[0] = True
    for lo in range(1, len(order), 1 << 16):  # neighbours in the suffix array, a block at a time
        hi = min(len(order), lo + (1 << 16))
        fresh[lo:hi] = (windows[order[lo:hi]] != windows[order[lo - 1 : hi - 1]]).any(axis=1)
    return number[order], offset[order], np.cumsum(fresh) - 1
