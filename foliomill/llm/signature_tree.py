"""Signature trees: an exact Jaccard self-join of some thousand sets in one task.

A leaf is a set, with a bitmap of its hashed members and its size. A node above holds the OR of its children's bitmaps, the range of
their sizes and their largest excess (members less bits set, as members may share a bit). Two sets below nodes a and b share at most
popcount(a & b) + min(excess) members, so a pair of nodes goes as soon as that is too few for their smallest sizes. Both trees are
descended together; pairs of leaves that remain are compared member by member.
"""

from __future__ import annotations

import numpy as np

FAN = 8
#: Words of bitmaps that are compared at once.
AT_ONCE = 1 << 21


class _Level:
    def __init__(self, bits, low, high, excess, comp):
        self.bits, self.low, self.high, self.excess, self.comp = bits, low, high, excess, comp


class SetForest:
    """Sets with their links: union-find over members whose Jaccard similarity is num / den or more."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den, self.n = num, den, len(sets)
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        values, self.tokens, self.df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.mark = np.zeros(len(values), dtype=bool)
        self.root = np.arange(self.n)
        typical = int(np.percentile(self.size, 90))
        self.width = int(min(1 << 15, max(256, 1 << (4 * typical - 1).bit_length())))
        self.sets = sets

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def settle(self) -> None:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return
            self.root = up

    def compare(self, i: int, others: np.ndarray) -> None:
        """Links i with each of others whose similarity is large enough, counted member by member."""
        own = self.tokens[self.at[i] : self.at[i + 1]]
        self.mark[own] = True
        for k in range(0, len(others), 1024):
            part = others[k : k + 1024]
            part = part[self.size[part] > 0]
            if not len(part):
                continue
            held = self.mark[np.concatenate([self.tokens[self.at[j] : self.at[j + 1]] for j in part])]
            starts = np.concatenate([[0], np.cumsum(self.size[part])[:-1]])
            both = np.add.reduceat(held.astype(np.int64), starts)
            self.found(i, part[self.den * both >= self.num * (self.size[i] + self.size[part] - both)])
        self.mark[own] = False

    def found(self, i: int, others: np.ndarray) -> None:
        for j in others:
            a, b = self.find(i), self.find(int(j))
            self.root[max(a, b)] = min(a, b)

    def tree(self, members: np.ndarray) -> tuple[np.ndarray, list[_Level]]:
        """Members in the order of leaves (like sizes and least hashes stand together), and the levels from leaves to root."""
        tier = np.floor(np.log(np.maximum(self.size[members], 1)) / np.log(self.den / self.num)) if self.num < self.den else self.size[members]
        least = np.array([self.sets[i][0] for i in members], dtype=np.uint64)
        order = members[np.lexsort((least, tier))]
        grid = np.zeros((len(order), self.width), dtype=bool)
        for r, i in enumerate(order):
            grid[r, (self.sets[i] % np.uint64(self.width)).astype(np.int64)] = True
        bits = np.packbits(grid, axis=1).view(np.uint64)
        size = self.size[order]
        levels = [_Level(bits, size, size, size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), self.root[order])]
        while len(levels[-1].low) > 1:
            x = levels[-1]
            cut = np.arange(0, len(x.low), FAN)
            same = np.minimum.reduceat(x.comp, cut) == np.maximum.reduceat(x.comp, cut)
            levels.append(_Level(np.bitwise_or.reduceat(x.bits, cut, axis=0), np.minimum.reduceat(x.low, cut), np.maximum.reduceat(x.high, cut), np.maximum.reduceat(x.excess, cut), np.where(same, x.comp[cut], -1)))
        return order, levels

    def _survive(self, x: _Level, y: _Level, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = (x.comp[a] < 0) | (x.comp[a] != y.comp[b])
        ok &= np.minimum(x.high[a], y.high[b]) * (self.num + self.den) >= self.num * (x.low[a] + y.low[b])
        at = np.flatnonzero(ok)
        step = max(1, AT_ONCE // x.bits.shape[1])
        for k in range(0, len(at), step):
            i = at[k : k + step]
            shared = np.bitwise_count(x.bits[a[i]] & y.bits[b[i]]).sum(axis=1, dtype=np.int64) + np.minimum(x.excess[a[i]], y.excess[b[i]])
            ok[i] = shared * (self.num + self.den) >= self.num * (x.low[a[i]] + y.low[b[i]])
        return ok

    def join(self, left: np.ndarray, right: np.ndarray | None = None) -> None:
        """Links all similar pairs of left with right, or within left. Pairs already linked are passed over."""
        left = left[self.size[left] > 0]
        right = right if right is None else right[self.size[right] > 0]
        if not len(left) or (right is not None and not len(right)):
            return
        self.settle()
        own, up = self.tree(left)
        other, down = (own, up) if right is None else self.tree(right)
        while len(up) < len(down):
            up.append(up[-1])
        while len(down) < len(up):
            down.append(down[-1])
        stack = [(len(up) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while stack:
            level, a, b = stack.pop()
            ok = self._survive(up[level], down[level], a, b)
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            if level == 0:
                self._leaves(own[a], other[b])
                continue
            a, b = self._below(up, level, a), self._below(down, level, b)
            a, b = np.broadcast_arrays(a[:, :, None], b[:, None, :])
            a, b = a.reshape(-1), b.reshape(-1)
            fits = (a < len(up[level - 1].low)) & (b < len(down[level - 1].low)) & (a >= 0) & (b >= 0)
            if right is None:
                fits &= (a < b) if level == 1 else (a <= b)
            a, b = a[fits], b[fits]
            for k in range(0, len(a), 1 << 16):
                stack.append((level - 1, a[k : k + (1 << 16)], b[k : k + (1 << 16)]))

    @staticmethod
    def _below(levels: list[_Level], level: int, x: np.ndarray) -> np.ndarray:
        """The children of nodes, a row each; a level that only fills up a shorter tree repeats its node."""
        if levels[level] is levels[level - 1]:
            return np.concatenate([x[:, None], np.full((len(x), FAN - 1), -1)], axis=1)
        return x[:, None] * FAN + np.arange(FAN)

    def _leaves(self, a: np.ndarray, b: np.ndarray) -> None:
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        for s, e in zip(cut, np.append(cut[1:], len(a))):
            self.settle()
            others = b[s:e][self.root[b[s:e]] != self.root[a[s]]]
            if len(others):
                self.compare(int(a[s]), others)

    def link(self, left: np.ndarray, right: np.ndarray | None = None) -> np.ndarray:
        """The least member linked to each, directly or through others. The member that shares most is compared first, with all."""
        if self.n > 2:
            common = np.add.reduceat(np.append(self.df[self.tokens], 0), np.minimum(self.at[:-1], len(self.tokens)))
            centre = int(np.argmax(np.where(self.size > 0, common, -1)))
            self.compare(centre, np.delete(np.arange(self.n), centre))
        self.join(left, right)
        self.settle()
        return self.root


class LinkCounter(SetForest):
    """Sets with the summed weights of what each is linked with; no pair is passed over, as roots stay apart until merge().

    A pair counts only if its members share none of their keys, so that of several tasks that see it just one counts it.
    """

    def __init__(self, sets: list[np.ndarray], num: int, den: int, weight: np.ndarray, keys: list[np.ndarray]):
        super().__init__(sets, num, den)
        self.weight, self.links, self.up = weight, np.zeros(self.n, dtype=np.int64), np.arange(self.n)
        held = np.array([len(x) for x in keys])
        _, codes = np.unique(np.concatenate([*keys, np.empty(0, np.int64)]), return_inverse=True)
        self.keys = np.split(codes, np.cumsum(held)[:-1])
        self.keyed, self.key_mark = held > 0, np.zeros(len(codes) + 1, dtype=bool)

    def found(self, i: int, others: np.ndarray) -> None:
        if not len(others):
            return
        apart = others[self.up[others] != self.up[i]]
        if len(apart):
            joined = np.unique(np.append(self.up[apart], self.up[i]))
            self.up[np.isin(self.up, joined)] = joined[0]
        if self.keyed[i]:
            self.key_mark[self.keys[i]] = True
            other = np.flatnonzero(self.keyed[others])
            shared = np.array([self.key_mark[self.keys[j]].any() for j in others[other]], dtype=bool)
            self.key_mark[self.keys[i]] = False
            others = np.delete(others, other[shared])
        self.links[i] += self.weight[others].sum()
        self.links[others] += self.weight[i]

    def merge(self) -> None:
        self.root = self.up
