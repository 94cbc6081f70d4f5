"""A signature tree over shingle sets and its dual traversal."""

from __future__ import annotations

import numpy as np

FANOUT = 8


class Node:
    """A run of sets: the OR of their bitmaps, their size range, and how far a set's size may exceed its bits."""

    __slots__ = ("bits", "children", "excess", "item", "largest", "merged", "smallest")

    def __init__(self, children: list[Node], item: int = -1, bits: int = 0, size: int = 0):
        self.children, self.item, self.merged = children, item, item >= 0
        if item >= 0:
            self.bits, self.smallest, self.largest = bits, size, size
            self.excess = size - bits.bit_count()
        else:
            self.bits = 0
            for c in children:
                self.bits |= c.bits
            self.smallest, self.largest = min(c.smallest for c in children), max(c.largest for c in children)
            self.excess = max(c.excess for c in children)

    def first(self) -> int:
        node = self
        while node.item < 0:
            node = node.children[0]
        return node.item


def bitmap(shingles: np.ndarray, width: int) -> int:
    mark = np.zeros(width, dtype=bool)
    mark[(shingles & np.uint64(width - 1)).astype(np.int64)] = True
    return int.from_bytes(np.packbits(mark).tobytes(), "little")


def build(sets: list[np.ndarray], items: list[int], width: int) -> Node | None:
    """Leaves by size and smallest shingle, so that like sets share a parent."""
    order = sorted(items, key=lambda i: (len(sets[i]), int(sets[i][0])))
    level = [Node([], i, bitmap(sets[i], width), len(sets[i])) for i in order]
    while len(level) > 1:
        level = [Node(level[a : a + FANOUT]) if len(level[a : a + FANOUT]) > 1 else level[a] for a in range(0, len(level), FANOUT)]
    return level[0] if level else None


class Join:
    """Links sets with 100 |x & y| >= percent |x | y|; pairs already in one component are not compared again."""

    def __init__(self, sets: list[np.ndarray], percent: int = 75, groups: list | None = None):
        """``groups``: what is known of the sets' components; sets of equal value are connected already."""
        self.sets, self.percent, self.links = sets, percent, []
        first: dict = {}
        self.parent = list(range(len(sets))) if groups is None else [first.setdefault(g, i) for i, g in enumerate(groups)]
        self.compared = 0

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def is_merged(self, node: Node) -> bool:
        """Are all sets below in one component? Once true it stays true."""
        if not node.merged and all(map(self.is_merged, node.children)):
            root = self.find(node.children[0].first())
            node.merged = all(self.find(c.first()) == root for c in node.children[1:])
        return node.merged

    def may_link(self, p: Node, q: Node) -> bool:
        """Can any pair reach the overlap that the smallest sets of both need?"""
        t = self.percent
        if p.largest * 100 < q.smallest * t or q.largest * 100 < p.smallest * t:
            return False
        most = min((p.bits & q.bits).bit_count() + min(p.excess, q.excess), p.largest, q.largest)
        return most * (100 + t) >= (p.smallest + q.smallest) * t

    def within(self, node: Node | None) -> None:
        if node is None or node.item >= 0:
            return
        for child in node.children:
            self.within(child)
        for i, p in enumerate(node.children):
            for q in node.children[i + 1 :]:
                self.between(p, q)

    def between(self, p: Node | None, q: Node | None) -> None:
        if p is None or q is None or not self.may_link(p, q):
            return
        if self.is_merged(p) and self.is_merged(q) and self.find(p.first()) == self.find(q.first()):
            return
        if p.item >= 0 and q.item >= 0:
            self.verify(p.item, q.item)
        elif q.item >= 0 or (p.item < 0 and len(p.children) >= len(q.children) and p.largest >= q.largest):
            for child in p.children:
                self.between(child, q)
        else:
            for child in q.children:
                self.between(p, child)

    def verify(self, i: int, j: int) -> None:
        x, y = self.sets[i], self.sets[j]
        self.compared += 1
        both = np.concatenate([x, y])
        both.sort(kind="stable")
        shared = int((both[1:] == both[:-1]).sum())
        if 100 * shared >= self.percent * (len(x) + len(y) - shared):
            self.links.append((i, j))
            self.parent[max(self.find(i), self.find(j))] = min(self.find(i), self.find(j))


def spanning_links(sets: list[np.ndarray], left: list[int], right: list[int] | None = None, percent: int = 75, groups: list | None = None) -> list[tuple[int, int]]:
    """Links that connect exactly the sets that chains of similar pairs connect; ``right``: also between two groups."""
    largest = max((len(s) for s in sets), default=1)
    width = 1 << max(9, min(17, (4 * largest - 1).bit_length()))
    join = Join(sets, percent, groups)
    a, b = build(sets, left, width), build(sets, right, width) if right else None
    join.within(a)
    join.within(b)
    join.between(a, b)
    return join.links
