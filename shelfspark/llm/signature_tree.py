"""Signature trees: nodes hold OR-combined token bitmaps and size ranges; pairs of nodes are pruned by their largest possible overlap."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from shelfspark.llm.components import contracted
from shelfspark.llm.text_batches import mixed

LEAF, FANOUT = 4, 4
#: Bytes of bitmaps that are tested together.
TOGETHER = 4 << 20
_SALT = np.uint64(0xA24BAED4963EE407)


def width_class(sizes: np.ndarray) -> np.ndarray:
    """log2 of the bits of the bitmap of a set: at least one for each token, 64 at least."""
    return np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64)


def bitmaps(tokens: np.ndarray, bounds: np.ndarray, each: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(words, bounds): each set's tokens as a bitmap of a power of two, at least ``each`` bits for a token."""
    width = np.left_shift(np.int64(1), width_class(each * np.diff(bounds)))
    at = np.concatenate([[0], np.cumsum(width)])
    bits = np.zeros(at[-1], bool)
    of = np.repeat(np.arange(len(width)), np.diff(bounds))
    bits[at[:-1][of] + (tokens & (width[of] - 1).astype(np.uint64)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64), at >> 6


def similarity_codes(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A min-hash of each set, by which alike sets come together in a tree; 0 for an empty one."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.minimum.reduceat(mixed(tokens ^ _SALT), bounds[:-1][some])
    return out


def folded(words: np.ndarray, bounds: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The bitmaps of ``rows`` as a matrix of ``width`` words: wider ones are OR-combined halves, which hold the same tokens."""
    out = np.zeros((len(rows), width), np.uint64)
    has = np.diff(bounds)[rows] // width
    for k in range(int(has.max(initial=1))):
        on = np.flatnonzero(has > k)
        out[on] |= words[bounds[rows[on]][:, None] + k * width + np.arange(width)]
    return out


def ones(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): first[i], first[i] + 1, ... for each i."""
    which = np.repeat(np.arange(len(first)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


class Level:
    """The nodes of one height in all trees: children (by number, one below), size range, OR of the bitmaps, the most
    tokens that a set hides behind shared bits, the label that all sets below have (-1: several), and the size of the
    least set that may be the smaller one of a pair."""

    def __init__(self, first: np.ndarray, group: np.ndarray, small: np.ndarray, large: np.ndarray, bits: np.ndarray, hidden: np.ndarray, label: np.ndarray, least: np.ndarray):
        self.first, self.group = first, group
        self.count = np.diff(np.append(first, len(small)))
        self.small, self.large = np.minimum.reduceat(small, first), np.maximum.reduceat(large, first)
        self.bits, self.hidden = np.bitwise_or.reduceat(bits, first, axis=0), np.maximum.reduceat(hidden, first)
        low, high = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
        self.label = np.where(low == high, low, -1)
        self.least = np.minimum.reduceat(least, first)


class Forest:
    """The signature trees of many groups of sets, whose bitmaps have one width, and their dual traversal.

    A group's sets are ordered by min-hash, so that leaves of LEAF sets hold
    alike ones, and nodes of FANOUT children stand above them up to one root. A
    tree is traversed against itself: a pair of nodes goes if its size ranges or
    its bitmaps leave no room for a similar pair, if all below is joined
    already, or if no set of ``inner`` (all by default) below one is as small as
    some below the other: the smaller set of a pair must be such a one. What the traversal leaves is tested by the bitmaps of both sets, and
    by ``sure`` if given. ``tested`` and ``pruned`` count pairs of nodes.
    """

    def __init__(self, group: np.ndarray, sizes: np.ndarray, bits: np.ndarray, codes: np.ndarray, percent: int, labels: np.ndarray | None = None, sure: Callable[[int, int], bool] | None = None, inner: np.ndarray | None = None):
        self.order = np.lexsort((sizes, codes, group))
        self.group, self.sizes, self.bits = group[self.order], sizes[self.order].astype(np.int64), bits[self.order]
        self.percent, self.sure = percent, sure
        self.least = self.sizes if inner is None else np.where(inner[self.order], self.sizes, np.int64(1) << 62)
        self.step = max(LEAF**2, TOGETHER // (8 * bits.shape[1]))
        self.tested = self.pruned = 0
        self.label = np.arange(len(group))
        if labels is not None:
            _, first, at = np.unique(labels[self.order], return_index=True, return_inverse=True)
            self.label = first[at]
        self.given = self.label.copy()
        beside = np.flatnonzero(self.group[1:] == self.group[:-1])
        self._test(beside, beside + 1)
        hidden = self.sizes - ones(self.bits)
        level = None
        self.levels: list[Level] = []
        while level is None or (level.group[1:] == level.group[:-1]).any():
            up = (self.group, self.sizes, self.sizes, self.bits, hidden, self.label, self.least) if level is None else (level.group, level.small, level.large, level.bits, level.hidden, level.label, level.least)
            new = np.ones(len(up[0]), bool)
            new[1:] = up[0][1:] != up[0][:-1]
            place = np.arange(len(new)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            first = np.flatnonzero(place % (LEAF if level is None else FANOUT) == 0)
            level = Level(first, up[0][first], *up[1:])
            self.levels.append(level)

    def _possible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether two sets may be similar: of the tokens of one, those at bits that the other lacks are not shared."""
        n, m = self.sizes[x], self.sizes[y]
        left, right = self.bits[x], self.bits[y]
        both = left & right
        most = np.minimum(n - ones(left) + ones(both), m - ones(right) + ones(both))
        return np.minimum(most, np.minimum(n, m)) * (100 + self.percent) >= self.percent * (n + m)

    def _test(self, x: np.ndarray, y: np.ndarray) -> None:
        for lo in range(0, len(x), self.step):
            a, b = x[lo : lo + self.step], y[lo : lo + self.step]
            apart = (self.label[a] != self.label[b]) & ((self.least[a] <= self.sizes[b]) | (self.least[b] <= self.sizes[a]))
            a, b = a[apart], b[apart]
            near = self._possible(a, b)
            a, b = a[near], b[near]
            if self.sure is None:
                self._merge(a, b)
                continue
            up: dict[int, int] = {}

            def top(i: int) -> int:
                while i in up:
                    i = up[i]
                return i

            linked = []
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                s, t = top(int(self.label[i])), top(int(self.label[j]))
                if s != t and self.sure(int(self.order[i]), int(self.order[j])):
                    up[max(s, t)] = min(s, t)
                    linked.append((i, j))
            if linked:
                self._merge(*np.array(linked).T)

    def _merge(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            node, to = contracted(self.label[a], self.label[b])
            mapped = np.arange(len(self.label))
            mapped[node] = to
            self.label = mapped[self.label]

    def _apart(self, level: Level, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no set below node a can be similar to one below node b."""
        percent = self.percent
        out = (100 * level.large[a] < percent * level.small[b]) | (100 * level.large[b] < percent * level.small[a])
        out |= (level.least[a] > level.large[b]) & (level.least[b] > level.large[a])
        on = np.flatnonzero(~out)
        for lo in range(0, len(on), self.step):
            i = on[lo : lo + self.step]
            overlap = ones(level.bits[a[i]] & level.bits[b[i]]) + np.minimum(level.hidden[a[i]], level.hidden[b[i]])
            out[i] = overlap * (100 + percent) < percent * (level.small[a[i]] + level.small[b[i]])
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(set, set): links that join what is similar, one for each set that is joined to an earlier one."""
        top = self.levels[-1]
        a = b = np.arange(len(top.first))
        for height in range(len(self.levels) - 1, -1, -1):
            level = self.levels[height]
            two = a != b
            open_ = ((level.label[a] < 0) | (level.label[a] != level.label[b])) & ((level.least[a] <= level.large[b]) | (level.least[b] <= level.large[a]))
            a, b, two = a[open_], b[open_], two[open_]
            gone = np.zeros(len(a), bool)
            gone[two] = self._apart(level, a[two], b[two])
            self.tested, self.pruned = self.tested + int(two.sum()), self.pruned + int(gone.sum())
            a, b = a[~gone], b[~gone]
            if height:
                a, b = self._below(level, a, b)
                continue
            step = self.step // LEAF**2
            for lo in range(0, len(a), step):
                self._test(*self._below(level, a[lo : lo + step], b[lo : lo + step], True))
        joined = np.flatnonzero(self.label != self.given)
        return self.order[joined], self.order[self.label[joined]]

    @staticmethod
    def _below(level: Level, a: np.ndarray, b: np.ndarray, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of children; of a node with itself, each pair once, without (``strict``) a child with itself."""
        pair, x = _ranges(level.first[a], level.count[a])
        pair2, y = _ranges(level.first[b[pair]], level.count[b[pair]])
        x, same = x[pair2], (a == b)[pair][pair2]
        keep = ~same | (x < y) | ((x == y) & (not strict))
        return x[keep], y[keep]


def forests(group: np.ndarray, sizes: np.ndarray, words: np.ndarray, bounds: np.ndarray, codes: np.ndarray, percent: int, inner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Possible links (row, row) within each ``group`` (sorted), as a spanning set: a forest for each width of bitmap.

    The sets of a group take the width of its narrowest bitmap.
    """
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    width = np.repeat(np.minimum.reduceat(np.diff(bounds), start), np.diff(np.append(start, len(group))))
    found = []
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        x, y = Forest(group[rows], sizes[rows], folded(words, bounds, rows, w), codes[rows], percent, inner=None if inner is None else inner[rows]).links()
        found.append((rows[x], rows[y]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def exact_links(tokens: list[np.ndarray], percent: int, labels: np.ndarray | None = None, each: int = 32) -> tuple[np.ndarray, np.ndarray, Forest | None]:
    """Links among whole sets (sorted tokens), as a spanning set: one tree over wide bitmaps, then token by token.

    Sets of equal ``labels`` are joined from the start.
    """
    sizes = np.array([len(t) for t in tokens], np.int64)
    if len(sizes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), None
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(tokens)

    def sure(i: int, j: int) -> bool:
        both = len(np.intersect1d(tokens[i], tokens[j], assume_unique=True))
        return both * 100 >= percent * (len(tokens[i]) + len(tokens[j]) - both)

    words, at = bitmaps(flat, bounds, each)
    wide = folded(words, at, np.arange(len(sizes)), int(np.diff(at).min()))
    forest = Forest(np.zeros(len(sizes), np.int64), sizes, wide, similarity_codes(flat, bounds), percent, labels, sure)
    return *forest.links(), forest
