"""Vantage-point trees over 64-bit fingerprints under the Hamming metric.

A tree splits the fingerprints by their distance to a vantage point. The triangle inequality bounds what a ball of
radius r around a query can reach: the inner child only if d - r <= threshold, the outer only if d + r > threshold.
Around a boundary both hold, and the query goes to both shards.

Distances between unrelated fingerprints gather at 32 +- 4 bits, so over all 64 bits a ball of radius 4 straddles
nearly every boundary and prunes nothing. The trees are therefore built in the Hamming metric of *parts* of the bits:
of `blocks` blocks, k differing bits leave at least `blocks - k` blocks untouched, so each close pair is at distance 0
in the metric of one of the C(blocks, k) masks, and one tree for each mask, searched with radius 0, loses no pair.

Before that, a tree asks the full metric: where fingerprints gather around a vantage point (large groups of near
copies), few lie between the ball and the rest, the triangle bounds send each to one side but for those near the
boundary, and the group leaves the tree in shards of its own. Where neither such a gap nor a mask's metric splits a
shard, the tree goes on with vantage points in the full metric, whatever the overlap.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A ball in the full metric is taken if at most this share straddles its boundary, and each side has at least that one.
OVERLAP, SHARE = 0.03, 0.15


def masks(blocks: int, radius: int) -> list[int]:
    """The masks on one of which any two fingerprints within the radius agree."""
    if not radius < blocks <= 64:
        raise ValueError("need radius < blocks <= 64")
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(part[i] for i in keep) for keep in combinations(range(blocks), blocks - radius)]


def blocks_for(rows: int, radius: int) -> int:
    """Blocks that leave about a thousand fingerprints or fewer for each value of a mask."""
    blocks = radius + 1
    while rows > 1000 * 2 ** (64 * (blocks - radius) / blocks) and blocks < radius + 6:
        blocks += 1
    return blocks


@dataclass
class Tree:
    """Nodes in arrays; a child below zero is the leaf -1 - child."""

    mask: int
    vantage: list[int] = field(default_factory=list)
    metric: list[int] = field(default_factory=list)
    radius: list[int] = field(default_factory=list)
    threshold: list[int] = field(default_factory=list)
    inner: list[int] = field(default_factory=list)
    outer: list[int] = field(default_factory=list)
    root: int = -1
    leaves: int = 0

    def route(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, leaf) of each fingerprint's own shard and of those that its ball overlaps."""
        rows, leaf, todo = [], [], [(self.root, np.arange(len(prints)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                rows.append(at)
                leaf.append(np.full(len(at), -1 - node, dtype=np.int32))
                continue
            d = distance(prints[at], self.vantage[node], self.metric[node])
            r, t = self.radius[node], self.threshold[node]
            for child, take in ((self.inner[node], d - r <= t), (self.outer[node], d + r > t)):
                if take.any():
                    todo.append((child, at[take]))
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        return np.concatenate(rows), np.concatenate(leaf)


def distance(prints: np.ndarray, vantage: int, metric: int) -> np.ndarray:
    return np.bitwise_count((prints ^ np.uint64(vantage)) & np.uint64(metric)).astype(np.int16)


def part_of(prints: np.ndarray, mask: int, parts: int) -> np.ndarray:
    """One of so many parts, the same for all fingerprints that agree on the mask."""
    mixed = (prints & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def build(sample: np.ndarray, mask: int, radius: int, leaf: int, seed: int = 42) -> Tree:
    """A tree whose leaves hold about `leaf` fingerprints of the sample. The sample affects balance only, not results."""
    rng, tree = np.random.default_rng(seed), Tree(mask)

    def node(prints: np.ndarray, vantage: int, metric: int, r: int, threshold: int) -> int:
        here, d = len(tree.vantage), distance(prints, vantage, metric)
        for column, value in ((tree.vantage, vantage), (tree.metric, metric), (tree.radius, r), (tree.threshold, threshold), (tree.inner, 0), (tree.outer, 0)):
            column.append(value)
        tree.inner[here], tree.outer[here] = split(prints[d - r <= threshold]), split(prints[d + r > threshold])
        return here

    def gap(prints: np.ndarray) -> tuple[int, int] | None:
        """(vantage, threshold) of a ball that few fingerprints straddle and that has a share of them, or None."""
        best = None
        for v in rng.choice(prints, min(16, len(prints)), replace=False):
            upto = np.cumsum(np.bincount(distance(prints, int(v), int(FULL)), minlength=65))
            t = np.arange(radius, 65 - radius)
            inner, outer = upto[t + radius], len(prints) - upto[t - radius]
            fine = (inner + outer - len(prints) <= OVERLAP * len(prints)) & (inner >= SHARE * len(prints)) & (outer >= SHARE * len(prints))
            if fine.any():
                k = int(np.argmin(np.where(fine, np.maximum(inner, outer), len(prints) + 1)))
                most = int(max(inner[k], outer[k]))
                if best is None or most < best[0]:
                    best = (most, int(v), int(t[k]))
        return best[1:] if best else None

    def split(prints: np.ndarray) -> int:
        if len(prints) > leaf:
            if found := gap(prints):
                return node(prints, found[0], int(FULL), radius, found[1])
            for metric, r, most_left in ((mask, 0, 0.85), (int(FULL), radius, 0.7)):
                best = None
                for v in rng.choice(prints, min(8, len(prints)), replace=False):
                    d = distance(prints, int(v), metric)
                    for t in {int(np.median(d)) - 1, int(np.median(d))}:
                        most = max((d - r <= t).sum(), (d + r > t).sum())
                        if t >= 0 and (best is None or most < best[0]):
                            best = (most, int(v), t)
                if best and best[0] <= most_left * len(prints):
                    return node(prints, best[1], metric, r, best[2])
        tree.leaves += 1
        return -tree.leaves

    tree.root = split(sample)
    return tree


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of n positions over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def link(prints: np.ndarray, mask: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one leaf between fingerprints that agree on the mask, as a star for each of its components.

    Runs of up to 64 fingerprints with the same masked value are compared in full. In longer ones components grow from
    a pivot: what lies within the radius joins it and is never compared with its own kind again.
    """
    key = prints & np.uint64(mask)
    order = np.lexsort((prints, key))
    prints, key = prints[order], key[order]
    n = len(prints)
    run = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[run, n])
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    left = np.repeat(np.where(size <= 64, run + size, 0), size)  # where the run of each position ends
    for step in range(1, int(size[size <= 64].max(initial=0))):
        i = np.flatnonzero(np.arange(n) + step < left)
        i = i[np.bitwise_count(prints[i] ^ prints[i + step]) <= radius]
        a.append(i)
        b.append(i + step)
    for start, many in zip(run[size > 64], size[size > 64], strict=True):
        rest = np.arange(start, start + many)
        while len(rest):
            front, first, rest = [rest[0]], rest[0], rest[1:]
            while front and len(rest):
                near = np.bitwise_count(prints[rest] ^ prints[front.pop()]) <= radius
                if near.any():
                    got, rest = rest[near], rest[~near]
                    front.extend(got)
                    a.append(np.full(len(got), first))
                    b.append(got)
    root = roots(n, np.concatenate(a), np.concatenate(b))
    far = np.flatnonzero(root != np.arange(n))
    return prints[root[far]], prints[far]
