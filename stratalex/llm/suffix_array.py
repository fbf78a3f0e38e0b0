"""Sorting suffixes deep and shallow, and the windows that two of them share.

Suffixes come in groups, each as a row of words of eight bytes. A multikey
quicksort takes them by their first words, all groups and segments a round at
a time; what is still equal at the shallow depth is put in order by blind tries.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the quicksort looks at; the tries take the rest.
SHALLOW = 96


def lanes(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, back: bool = False) -> np.ndarray:
    """Row i: the ``size[i]`` bytes from ``start[i]`` on (or, ``back``, before it, last first) in big-endian words, filled up with zeros."""
    words = -(-width // 8)
    step = np.arange(words * 8)
    where = start[:, None] + (-1 - step if back else step)[None, :]
    there = step[None, :] < size[:, None]
    rows = np.where(there, data[np.where(there, where, 0)] if len(data) else 0, 0).astype(np.uint8)
    return rows.view(">u8").astype(np.uint64).reshape(len(start), words)


def multikey_quicksort(rows: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order of ``rows`` within their groups (sorted numbers) by their first ``depth`` words, and the places of those that are equal so far.

    Each round parts every open segment into what is less than, equal to and more
    than the word of a pivot; equal parts go on with the next word.
    """
    order = np.arange(len(rows))
    edge = np.flatnonzero(np.diff(group, prepend=-1 if not len(group) else group[0] - 1))
    start, size = edge, np.diff(np.append(edge, len(rows)))
    level, deep = np.zeros(len(start), np.int64), []
    while True:
        live = size > 1
        start, size, level = start[live], size[live], level[live]
        done = level >= depth
        deep += [np.arange(s, s + n) for s, n in zip(start[done].tolist(), size[done].tolist())]
        start, size, level = start[~done], size[~done], level[~done]
        if not len(start):
            return order, deep
        segment = np.repeat(np.arange(len(start)), size)
        place = np.arange(len(segment)) - np.repeat(np.cumsum(size) - size, size) + start[segment]
        value = rows[order[place], level[segment]]
        ends = [rows[order[start + k], level] for k in (0 * size, size // 2, size - 1)]
        pivot = np.maximum(np.minimum(ends[0], ends[1]), np.minimum(np.maximum(ends[0], ends[1]), ends[2]))[segment]
        part = segment * 3 + (value >= pivot) + (value > pivot)
        order[place] = order[place[np.argsort(part, kind="stable")]]
        sizes = np.bincount(part, minlength=3 * len(start)).reshape(-1, 3)
        starts = start[:, None] + np.cumsum(sizes, axis=1) - sizes
        level = level[:, None] + np.array([0, 1, 0])
        start, size, level = starts.ravel(), sizes.ravel(), level.ravel()


class BlindTrie:
    """Strings of one length in order. A node holds the byte at which its strings part, and descends without looking at the others."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        #: A node is a place and the children by byte there; a leaf is the list of the strings that are equal.
        self.root: list = [0]
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while isinstance(node, tuple):
            # any child will do where there is none of this byte
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        if s == other:
            node.append(i)
            return
        split = common(s, other)
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < split:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == split:
            node[1][s[split]] = [i]
            return
        made = (split, {other[split]: node, s[split]: [i]})
        if above is None:
            self.root = made
        else:
            above[1][s[above[0]]] = made

    def sorted(self) -> list[int]:
        """Numbers of the strings in order; equal ones as they came."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def common(a: bytes, b: bytes) -> int:
    """Bytes that two different strings of one length have in common at their beginning."""
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - 1 - (differ.bit_length() - 1) // 8


def suffix_array(rows: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``rows`` within their groups, and the bytes each has in common with the one before it (-1: another group)."""
    depth = min(rows.shape[1], max(1, shallow // 8))
    order, deep = multikey_quicksort(rows, group, depth)
    if depth < rows.shape[1]:
        for at in deep:
            own = order[at]
            tails = rows[own, depth:].astype(">u8").tobytes()
            size = 8 * (rows.shape[1] - depth)
            order[at] = own[BlindTrie([tails[k : k + size] for k in range(0, len(tails), size)]).sorted()]
    same = np.full(len(rows), -1, np.int64)
    if len(rows) > 1:
        differ = rows[order[1:]] ^ rows[order[:-1]]
        first = (differ != 0).argmax(axis=1)
        word = differ[np.arange(len(differ)), first]
        # leading zero bytes of the first word that differs
        zeros = (8 - sum((word >> np.uint64(8 * k)) > 0 for k in range(8))).astype(np.int64)
        equal = word == 0
        same[1:] = np.where(equal, 8 * rows.shape[1], 8 * first + zeros)
        same[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, same


def recurring_offsets(
    data: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, times: np.ndarray, low: np.ndarray, high: np.ndarray, least: int, shallow: int = SHALLOW
) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the smallest and the largest offset of a window that recurs (-1 and -1: none does).

    A place stands in ``data`` at ``start``, with ``left`` bytes of its text before
    it and ``right`` from it on; ``times`` is how often the whole of it is there. A window of ``least`` bytes
    begins ``offset`` bytes before a place, low <= offset <= high. It recurs if
    another place of the group has the same bytes around it. The suffix array of what
    follows the places and that of what goes before them, read backwards, tell for each
    offset which places have equal parts on either side.
    """
    n = len(start)
    smallest, largest = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if not n:
        return smallest, largest
    sides = []
    for width, size, back in ((least, right, False), (least, left, True)):
        order, same = suffix_array(lanes(data, start, np.minimum(size, width), width, back), group, shallow)
        next_same = np.append(same[1:], -1)
        best = np.empty(n, np.int64)
        best[order] = np.maximum(same, next_same)
        sides.append((order, same, np.minimum(np.where(times > 1, least, best), size)))
    (r_order, r_same, r_best), (l_order, l_same, l_best) = sides
    low, high = np.maximum(low, least - r_best), np.minimum(high, l_best)
    several = (times > 1) & (low <= high)
    smallest[several], largest[several] = low[several], high[several]
    open_ = (low <= high) & ~several
    if not open_.any():
        return smallest, largest

    def classes(order: np.ndarray, same: np.ndarray, depth: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(same < depth)
        return out

    for found, offsets in ((smallest, range(int(low[open_].min()), int(high[open_].max()) + 1)), (largest, range(int(high[open_].max()), int(low[open_].min()) - 1, -1))):
        left_over = open_.copy()
        for offset in offsets:
            has = (low <= offset) & (offset <= high)
            if not (left_over & has).any():
                if not left_over.any():
                    break
                continue
            here = np.flatnonzero(has)
            key = classes(r_order, r_same, least - offset)[here] * (n + 1) + classes(l_order, l_same, offset)[here]
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            again = here[count[inverse] > 1]
            again = again[left_over[again]]
            found[again] = offset
            left_over[again] = False
    return smallest, largest
