"""Suffix arrays by linear grouping construction."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a list of positive integers.

    Phase one puts suffixes into groups by their longest Lyndon prefix: groups
    are taken from the highest down; each suffix of a group points to the last
    suffix before it in a lower group (its previous smaller one), and suffixes
    that the group points to equally often move up into a group of their own,
    right behind their old one, most pointers first.  Phase two walks the
    finished order: behind each emitted suffix its left neighbour and that one's
    chain of previous smaller suffixes take the next free places of their groups.
    Nothing is renamed and nothing recurses.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    order = sorted(range(n), key=text.__getitem__)  # places by group
    place = [0] * n
    start = [0] * n  # of each suffix's group
    size: dict[int, int] = {}
    first = 0
    for at, s in enumerate(order):
        if at and text[s] != text[order[at - 1]]:
            first = at
        place[s] = at
        start[s] = first
        size[first] = size.get(first, 0) + 1
    before = [-1] * n
    high = n
    while high:
        low = start[order[high - 1]]
        pointed: dict[int, int] = {}
        for s in [order[low]] if high - low == 1 else sorted(order[low:high]):
            p = s - 1
            while p >= 0 and start[p] >= low:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1:
            ((p, _),) = pointed.items()
            moves = (((start[p], (p,)),),)
        else:
            levels: dict[int, dict[int, list[int]]] = {}
            for p, times in pointed.items():
                levels.setdefault(times, {}).setdefault(start[p], []).append(p)
            moves = tuple(tuple(levels[k].items()) for k in sorted(levels, reverse=True))
        for level in moves:
            for old, own in level:
                many = size[old]
                if len(own) == many:
                    continue
                fresh = old + many - len(own)
                to = old + many
                for p in own:
                    to -= 1
                    at, other = place[p], order[to]
                    # what stands at the end of the group changes places with p
                    order[at], order[to] = other, p
                    place[other], place[p] = at, to
                for p in own:
                    start[p] = fresh
                size[old] = many - len(own)
                size[fresh] = len(own)
        high = low
    out = [-1] * n
    free = {}
    done = bytearray(n)

    def put(s):
        while s >= 0 and not done[s]:
            g = start[s]
            at = free.get(g, g)
            out[at] = s
            free[g] = at + 1
            done[s] = 1
            s = before[s]

    put(n - 1)
    for i in range(n):
        put(out[i] - 1)
    return out
