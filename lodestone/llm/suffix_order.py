"""Linear suffix sorting by grouping Lyndon prefixes.

Suffixes are first grouped by their symbol. Groups are then taken in descending order: every suffix of a
group looks up the nearest earlier suffix of a smaller group, and those found move behind the rest of
their own group, further the more suffixes of the present group point at them. When all groups are done,
suffixes of one group share their Lyndon prefix. A second pass in ascending order places, for each suffix
in turn, the suffixes before it along the same pointers at the next free place of their group.
Symbols are never renamed and no smaller string is sorted in between.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in ascending order; a suffix that is a prefix of another comes first.

    ``symbols`` are any integers. Time is linear up to the walks along shortened pointers.
    """
    n = len(symbols) + 1
    text = np.zeros(n, dtype=np.int64)  # ends with a symbol smaller than all others
    text[:-1] = np.unique(symbols, return_inverse=True)[1] + 1
    sizes = np.bincount(text)
    first = np.cumsum(sizes) - sizes
    sorted_by_symbol = np.argsort(text, kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[sorted_by_symbol] = np.arange(n)
    group = first[text].tolist()  # a group is named by its first place in ``order``
    size = [0] * n
    for name, many in zip(first.tolist(), sizes.tolist(), strict=True):
        size[name] = many
    order, place, smaller = sorted_by_symbol.tolist(), place.tolist(), list(range(-1, n - 1))

    end = n
    while end > 0:
        name = group[order[end - 1]]
        found: dict[int, int] = {}
        for i in order[name:end]:
            j = smaller[i]
            while j >= 0 and group[j] >= name:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        if len(found) == 1:  # most groups have one suffix, which splits one other off
            ((j, _),) = found.items()
            old = group[j]
            many = size[old]
            if many > 1:
                tail, at = old + many - 1, place[j]
                other = order[tail]
                order[at], order[tail], place[other], place[j] = other, j, at, tail
                size[old], size[tail], group[j] = many - 1, 1, tail
        elif found:
            moved: dict[int, list[tuple[int, int]]] = {}
            for j, times in found.items():
                moved.setdefault(group[j], []).append((times, j))
            for old, members in moved.items():
                members.sort(reverse=True)
                tail = old + size[old]
                size[old] -= len(members)
                k = 0
                while k < len(members):
                    times, start = members[k][0], k
                    while k < len(members) and members[k][0] == times:
                        j = members[k][1]
                        tail -= 1
                        at, other = place[j], order[tail]
                        order[at], order[tail], place[other], place[j] = other, j, at, tail
                        k += 1
                    for _, j in members[start:k]:
                        group[j] = tail
                    size[tail] = k - start
        end = name

    free = list(range(n))  # by a group's name: its next free place
    out = [-1] * n
    out[0] = n - 1
    done = [False] * n
    done[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            name = group[j]
            out[free[name]] = j
            free[name] += 1
            done[j] = True
            j = smaller[j]
    return np.array(out[1:], dtype=np.int64)
