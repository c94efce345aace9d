"""Linear-time suffix sorting by grouping, without recursive renaming.

Phase one sorts suffixes into groups that share their longest Lyndon prefix.  Groups
start as the symbols and are taken in descending order.  For each suffix of a group the
previous-smaller pointer is the nearest place to its left whose suffix is in a group not
yet taken; the suffixes pointed at get the taken group's prefix appended to theirs, so
they move to new groups right above their old ones, those pointed at more often higher.

Phase two reads the order off the groups: each suffix in turn, from the smallest, lets
the chain of suffixes whose Lyndon prefix ends where it begins take the next free slot
of their groups.

Both phases touch each suffix a constant number of times beside the pointer chains.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[list[int]]]:
    """Previous-smaller pointers (-1: none), the final group of each suffix, and the groups
    from the highest to the lowest, as lists of suffixes."""
    n = len(text)
    symbols = sorted(set(text))
    number = {s: k for k, s in enumerate(symbols)}
    members: list[list[int]] = [[] for _ in symbols]
    group = [number[s] for s in text]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(symbols) - 1))  # the next lower group
    above = [*range(1, len(symbols)), -1]
    previous = list(range(-1, n - 1))
    taken = bytearray(n + 1)  # place n stands for -1 and is never taken
    descending: list[list[int]] = []
    g = len(symbols) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        if not own:
            g = below[g]
            continue
        descending.append(own)
        for i in own:
            taken[i] = 1
        if len(own) == 1:
            i = own[0]
            j = i - 1
            while taken[j]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                h = group[j]
                new = len(members)
                group[j] = new
                members.append([j])
                up = above[h]
                below.append(h)
                above.append(up)
                above[h] = new
                below[up] = new
            g = below[g]
            continue
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while taken[j]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            levels: dict[int, dict[int, list[int]]] = {}
            for j, t in times.items():
                levels.setdefault(t, {}).setdefault(group[j], []).append(j)
            for t in sorted(levels, reverse=True):
                for h, moved in levels[t].items():
                    new = len(members)
                    for j in moved:
                        group[j] = new
                    members.append(moved)
                    up = above[h]
                    below.append(h)
                    above.append(up)
                    above[h] = new
                    below[up] = new
        g = below[g]
    return previous, group, descending


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of the suffixes of a sequence of non-negative integers in ascending order.

    The empty sequence has none.  A suffix that is a prefix of another comes before it.
    """
    n = len(text)
    if not n:
        return []
    # The end must be smaller than every symbol, and have a place of its own.
    previous, group, descending = lyndon_groups([*text, -1])
    free: dict[int, int] = {}
    slot = 0
    for own in reversed(descending):
        free[group[own[0]]] = slot
        slot += len(own)
    order = [-1] * (n + 1)
    order[0] = n
    placed = bytearray(n + 2)
    placed[n] = placed[n + 1] = 1  # place n + 1 stands for -1
    for k in range(n + 1):
        j = order[k] - 1
        while not placed[j]:
            g = group[j]
            at = free[g]
            order[at] = j
            free[g] = at + 1
            placed[j] = 1
            j = previous[j]
    return order[1:]
