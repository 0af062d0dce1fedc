"""Deep-shallow suffix sorting: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

import numpy as np

from cellweave.llm.kernels import runs

#: Bytes that the quicksort compares before the tries take over; a multiple of its eight-byte characters.
SHALLOW = 24


def characters(buf: np.ndarray) -> np.ndarray:
    """The big-endian eight-byte character at each position; zeros follow the end."""
    x = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        x = (x[:-width] << np.uint64(8 * width)) | x[width:]
    return x[: len(buf) + 1]


class BlindTrie:
    """Strings of one length by the bytes in which they branch; a search compares with one leaf only."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, s: bytes, member: int) -> None:
        node = self.root
        if node is None:
            self.root = [None, s, [member]]
            return
        while node[0] is not None:
            kids = node[1]
            node = kids.get(s[node[0]]) or next(iter(kids.values()))
        other = node[1]
        if other == s:
            node[2].append(member)
            return
        at = next(i for i, (x, y) in enumerate(zip(s, other, strict=True)) if x != y)
        parent, node = None, self.root
        while node[0] is not None and node[0] < at:
            parent, node = node, node[1][s[node[0]]]
        leaf = [None, s, [member]]
        if node[0] == at:
            node[1][s[at]] = leaf
            return
        fork = [at, {s[at]: leaf, other[at]: node}]
        if parent is None:
            self.root = fork
        else:
            parent[1][s[parent[0]]] = fork

    def leaves(self) -> list[list[int]]:
        """The members of equal strings, in the strings' order."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                out.append(node[2])
            else:
                stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
        return out


def deep_shallow_sort(buf: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at starts by their first length bytes, and where each run of equal ones begins.

    Every start needs length bytes in buf. A character is eight bytes. Each pass of the multikey quicksort parts all
    open segments at once, each by a pivot of its own into less, equal and greater; only the equal part goes on to the
    next character. The segments that still tie after SHALLOW bytes, if not of equal strings, go to tries.
    """
    order, n = np.arange(len(starts)), len(starts)
    head = np.zeros(n, bool)
    if not n:
        return order, head
    head[0] = True
    chars = characters(buf)

    def tied() -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(head)
        segment = np.cumsum(head) - 1
        size = np.diff(np.append(first, n))
        at = np.flatnonzero(size[segment] > 1)
        return at, segment[at]

    done = min(SHALLOW, length - length % 8)
    depth = np.zeros(n, np.int64)
    while True:
        at, segment = tied()
        live = depth[at] < done
        at, segment = at[live], segment[live]
        if not len(at):
            break
        first, last = runs(segment)
        middle = at[(first + last) // 2]
        pivot = np.repeat(chars[starts[order[middle]] + depth[middle]], last - first)
        key = chars[starts[order[at]] + depth[at]]
        side = (key > pivot).astype(np.int8) - (key < pivot)
        by = np.lexsort((side, segment))
        order[at], side = order[at][by], side[by]
        depth[at[side == 0]] += 8  # those that tie with their pivot go on to the next character
        head[at[1:]] |= (side[1:] != side[:-1]) & (segment[1:] == segment[:-1])
    at, segment = tied()
    if not len(at):
        return order, head
    first, last = runs(segment)
    lead = np.repeat(order[at[first]], last - first)
    same = np.ones(len(at), bool)
    tails = [*range(done, length - 7, 8), length - 8] if length >= 8 else []
    for depth in tails:
        same &= chars[starts[order[at]] + depth] == chars[starts[lead] + depth]
    mixed = np.flatnonzero(~np.logical_and.reduceat(same, first)) if tails else np.arange(len(first))
    for i in mixed:
        where = at[first[i] : last[i]]
        trie = BlindTrie()
        for member in order[where].tolist():
            trie.add(buf[starts[member] + done : starts[member] + length].tobytes(), member)
        k = where[0]
        for members in trie.leaves():
            head[k] = True
            order[k : k + len(members)] = members
            k += len(members)
    return order, head
