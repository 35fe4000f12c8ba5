"""A hierarchical navigable small-world graph over the vectors of one shard.

Nodes are numbered by falling level, so a layer is a prefix of the nodes and its
links are one flat array of neighbour numbers.  Blocks of nodes are inserted, and
blocks of queries searched, together: each step works on all of them in numpy.
"""

from __future__ import annotations

import math

import numpy as np

#: Links of a node in the upper layers, and in the lowest.
LINKS, LOW_LINKS = 16, 32
#: Candidates kept while a node's links are sought, and of those the ones they are chosen from.
BUILD_BEAM, CHOICES = 96, 64
#: Nodes or queries that are worked on together.
TOGETHER = 256


def spread(keys: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that only depend on the keys."""
    x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54


def on_sphere(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate puts all on a sphere, where the largest product with a query is the nearest point."""
    squares = np.einsum("ij,ij->i", vectors, vectors)
    return np.c_[vectors, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0))].astype(np.float32)


class Graph:
    """``points`` lie on a sphere; ``layers[0]`` holds all nodes, ``layers[k]`` the first ones. -1 fills up."""

    def __init__(self, points: np.ndarray, layers: list[np.ndarray]):
        self.points, self.layers = points, layers

    @classmethod
    def build(cls, points: np.ndarray, draws: np.ndarray) -> Graph:
        """``draws`` (0 to 1, falling levels first, see ``order``) decide the nodes' levels."""
        levels = _levels(draws)
        graph = cls(points, [np.full((int((levels >= k).sum()), LINKS if k else LOW_LINKS), -1, np.int32) for k in range(int(levels.max(initial=0)) + 1)])
        low = 0
        while low < len(points):
            high = min(len(points), low + min(TOGETHER, max(low, 1)))  # never more than are there to link to
            graph._insert(low, high)
            low = high
        return graph

    @staticmethod
    def order(draws: np.ndarray, *ties: np.ndarray) -> np.ndarray:
        """The nodes by falling level."""
        return np.lexsort((*ties[::-1], draws))

    def _insert(self, low: int, high: int) -> None:
        new = np.arange(low, high)
        queries, entry = self.points[new], np.zeros((high - low, 1), np.int32)
        for k in range(len(self.layers) - 1, -1, -1):
            layer = self.layers[k]
            inside = new < len(layer)
            if low and not inside.all():
                entry[~inside] = self._beam(queries[~inside], entry[~inside], 1, k)[0]
            if not inside.any():
                continue
            own, mine = new[inside], queries[inside]
            beside = mine @ mine.T  # of the block
            np.fill_diagonal(beside, -np.inf)
            near = np.argsort(-beside, axis=1)[:, :CHOICES]
            ids, sims = own[near].astype(np.int32), np.take_along_axis(beside, near, 1)
            if low:
                found, scores = self._beam(mine, entry[inside], BUILD_BEAM, k)
                entry[inside] = found[:, :1]
                ids, sims = np.c_[found, ids], np.c_[scores, sims]
            links = self._chosen(ids, sims, LINKS)
            layer[own, : links.shape[1]] = links
            self._link_back(layer, own, links)

    def _chosen(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates the nearest ones that lie apart, then the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, :CHOICES]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        there = np.isfinite(sims) & (ids >= 0)
        at = self.points[np.where(there, ids, 0)]
        between = at @ at.transpose(0, 2, 1)
        closest, kept = np.full(ids.shape, -np.inf, np.float32), np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            take = there[:, c] & (closest[:, c] < sims[:, c]) & (kept.sum(axis=1) < most)
            kept[:, c] = take
            np.maximum(closest, between[:, c], out=closest, where=take[:, None])
        first = np.argsort(np.where(kept, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(there, first, 1), np.take_along_axis(ids, first, 1), -1)

    def _link_back(self, layer: np.ndarray, own: np.ndarray, links: np.ndarray) -> None:
        """Each chosen neighbour links back; those with too many links choose anew."""
        source = np.repeat(own, links.shape[1])[links.ravel() >= 0]
        target = links.ravel()[links.ravel() >= 0]
        nodes = np.unique(target)
        held = layer[nodes]
        pairs = np.r_[np.c_[np.repeat(nodes, held.shape[1]), held.ravel()], np.c_[target, source]]
        pairs = np.unique(pairs[pairs[:, 1] >= 0], axis=0)
        sims = np.concatenate([np.einsum("ij,ij->i", self.points[p[:, 0]], self.points[p[:, 1]]) for p in np.array_split(pairs, len(pairs) // 65536 + 1)])
        order = np.lexsort((pairs[:, 1], -sims, pairs[:, 0]))
        pairs, sims = pairs[order], sims[order]
        starts = np.searchsorted(pairs[:, 0], nodes)
        rank = np.arange(len(pairs)) - np.repeat(starts, np.diff(np.r_[starts, len(pairs)]))
        width = min(max(int(rank.max(initial=0)) + 1, layer.shape[1]), CHOICES)
        row, near = np.searchsorted(nodes, pairs[:, 0]), rank < width
        ids, score = np.full((len(nodes), width), -1, np.int32), np.full((len(nodes), width), -np.inf, np.float32)
        ids[row[near], rank[near]], score[row[near], rank[near]] = pairs[near, 1], sims[near]
        full = np.bincount(row, minlength=len(nodes)) > layer.shape[1]
        layer[nodes[~full]] = ids[~full, : layer.shape[1]]
        for part in np.array_split(np.flatnonzero(full), full.sum() // TOGETHER + 1):
            if len(part):
                layer[nodes[part]] = self._chosen(ids[part], score[part], layer.shape[1])

    def _beam(self, queries: np.ndarray, entry: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, products) of the ``width`` best found in layer ``k``, best first; -1 where there are fewer."""
        layer, n = self.layers[k], len(queries)
        width = min(width, len(layer))
        seen = np.zeros((n, len(layer)), bool)
        rows = np.arange(n)
        seen[rows, entry[:, 0]] = True
        ids, sims, done = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32), np.ones((n, width), bool)
        ids[:, 0], done[:, 0] = entry[:, 0], False
        sims[:, 0] = np.einsum("ij,ij->i", queries, self.points[entry[:, 0]])
        live = rows
        while len(live):
            best = np.argmax(np.where(done[live], -np.inf, sims[live]), axis=1)
            done[live, best] = True
            near = layer[ids[live, best]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            score = np.full(near.shape, -np.inf, np.float32)
            score[r, c] = np.einsum("ij,ij->i", queries[live[r]], self.points[near[r, c]])
            sims_all = np.c_[sims[live], score]
            top = np.argpartition(-sims_all, width - 1, axis=1)[:, :width]
            sims[live] = np.take_along_axis(sims_all, top, 1)
            ids[live] = np.take_along_axis(np.c_[ids[live], np.where(fresh, near, -1)], top, 1)
            done[live] = np.take_along_axis(np.c_[done[live], ~fresh], top, 1)
            live = live[~done[live].all(axis=1)]
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """The best ``beam`` nodes found for each query, best first; -1 where there are fewer."""
        out = []
        queries = np.c_[queries, np.zeros(len(queries))].astype(np.float32)
        for low in range(0, len(queries), TOGETHER):
            part = queries[low : low + TOGETHER]
            entry = np.zeros((len(part), 1), np.int32)
            for k in range(len(self.layers) - 1, 0, -1):
                entry = self._beam(part, entry, 1, k)[0]
            found = self._beam(part, entry, beam, 0)[0]
            out.append(np.pad(found, ((0, 0), (0, beam - found.shape[1])), constant_values=-1))
        return np.concatenate(out) if out else np.empty((0, beam), np.int32)


def _levels(draws: np.ndarray) -> np.ndarray:
    return np.floor(-np.log(draws) / math.log(LINKS)).astype(int)
