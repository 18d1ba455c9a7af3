"""A directed search graph over the vectors of one shard: greedy searches propose neighbours, relaxed pruning keeps diverse ones.

All steps work on batches of points at once with numpy, so that Python runs per hop of a batch and not per point.
"""

from __future__ import annotations

import numpy as np

#: Edges kept per point, width of the beam, and how much longer a detour must be for an edge to be dropped.
DEGREE, BEAM, RELAX = 16, 20, 1.2
_BATCH = 512


class SearchGraph:
    """Unit vectors (float32) with at most ``degree`` edges each; ``search`` finds the nearest by inner product."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, seed: int = 7):
        self.vectors, self.degree, self.beam, self.relax = np.ascontiguousarray(vectors, np.float32), degree, beam, relax
        n = len(vectors)
        self.edges = np.full((n, degree), -1, np.int32)
        self.starts = np.zeros(0, np.int64)
        if n:
            self._build(np.random.default_rng(seed).permutation(n))

    def _similar(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Inner products of each query with its own row of ``ids``; -inf where an id is missing."""
        found = np.matmul(self.vectors[np.maximum(ids, 0)], queries[:, :, None])[:, :, 0]
        found[ids < 0] = -np.inf
        return found

    def search(self, queries: np.ndarray, beam: int | None = None, visited: bool = False, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids and inner products of the ``beam`` best points that a greedy walk of each query reaches, best first.

        ``first`` gives points to begin with besides the common starts, -1 for none. Missing results have id -1.
        """
        beam = min(beam or self.beam, max(1, len(self.vectors)))
        b = len(queries)
        begin = np.broadcast_to(self.starts, (b, len(self.starts)))
        if first is not None:
            begin = np.concatenate([begin, np.where(np.isin(first, self.starts), -1, first)], axis=1)
        ids, sims = self._best(begin.astype(np.int64), self._similar(queries, begin), beam)
        seen = np.zeros((b, len(self.vectors)), bool)
        at = np.arange(b)[:, None]
        np.put_along_axis(seen, np.maximum(begin, 0).astype(np.int64), True, axis=1)
        if seen.shape[1]:
            seen[:, 0] = (begin == 0).any(axis=1)
        done = ids < 0
        active = np.arange(b)
        while len(active):
            # each walk opens its two best unopened points
            open_sims = np.where(done[active], -np.inf, sims[active])
            pick = np.argpartition(-open_sims, min(1, open_sims.shape[1] - 1), axis=1)[:, :2]
            usable = np.take_along_axis(open_sims, pick, axis=1) > -np.inf
            going = usable.any(axis=1)
            active, pick, usable = active[going], pick[going], usable[going]
            if not len(active):
                break
            rows = active[:, None]
            done[rows, pick] = True
            opened = np.where(usable, ids[rows, pick], -1)
            near = np.where(opened[:, :, None] >= 0, self.edges[np.maximum(opened, 0)], -1).reshape(len(active), -1)
            fresh = (near >= 0) & ~seen[rows, np.maximum(near, 0)]
            # one point may be a neighbour of both
            order = np.argsort(near, axis=1, kind="stable")
            ordered = np.take_along_axis(near, order, axis=1)
            twice = np.zeros_like(fresh)
            twice[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
            repeated = np.empty_like(fresh)
            np.put_along_axis(repeated, order, twice, axis=1)
            fresh &= ~repeated
            width = int(fresh.sum(axis=1).max(initial=0))
            if not width:
                continue
            left = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            near = np.where(np.take_along_axis(fresh, left, axis=1), np.take_along_axis(near, left, axis=1), -1).astype(np.int64)
            r, c = np.nonzero(near >= 0)
            seen[active[r], near[r, c]] = True
            new = self._similar(queries[active], near)
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_sims = np.concatenate([sims[active], new], axis=1)
            all_done = np.concatenate([done[active], near < 0], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam] if all_sims.shape[1] > beam else np.broadcast_to(np.arange(all_sims.shape[1]), all_sims.shape)
            if ids.shape[1] < top.shape[1]:
                grow = top.shape[1] - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, grow)), constant_values=-1)
                sims = np.pad(sims, ((0, 0), (0, grow)), constant_values=-np.inf)
                done = np.pad(done, ((0, 0), (0, grow)), constant_values=True)
            for whole, part in ((ids, all_ids), (sims, all_sims), (done, all_done)):
                whole[active[:, None], np.arange(top.shape[1])] = np.take_along_axis(part, top, axis=1)
        del at
        return self._best(ids, sims, beam)

    @staticmethod
    def _best(ids: np.ndarray, sims: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        top = np.argsort(-sims, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(ids, top, axis=1).copy(), np.take_along_axis(sims, top, axis=1).copy()

    def _prune(self, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The edges of ``points`` among the candidates ``ids``: the nearest first, and none that is ``relax`` times nearer to one kept."""
        ids = np.where(ids == points[:, None], -1, ids)
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        sims = self._similar(self.vectors[points], ids)
        ids, sims = self._best(ids, sims, min(ids.shape[1], 2 * self.degree))
        block = self.vectors[np.maximum(ids, 0)]
        between = np.matmul(block, block.transpose(0, 2, 1))
        # squared distances of unit vectors are 2 - 2 * product; the factor of 2 cancels out
        far, apart = 1 - sims, 1 - between
        alive, kept = ids >= 0, np.zeros(ids.shape, bool)
        rows = np.arange(len(ids))
        for _ in range(self.degree):
            pick = np.argmax(alive, axis=1)
            some = alive[rows, pick]
            if not some.any():
                break
            kept[rows[some], pick[some]] = True
            alive &= ~((self.relax * apart[rows, pick] <= far) & some[:, None])
            alive[rows, pick] = False
        # places left over go to the nearest of those dropped
        order = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, : self.degree]
        chosen = np.take_along_axis(ids, order, axis=1)
        if chosen.shape[1] < self.degree:
            chosen = np.pad(chosen, ((0, 0), (0, self.degree - chosen.shape[1])), constant_values=-1)
        return chosen.astype(np.int32)

    def _build(self, order: np.ndarray) -> None:
        """Points join in batches that double up to a limit; each batch searches the graph of those before and itself."""
        n = len(order)
        head = order[: min(n, 2 * self.degree)]
        self.starts = head[: min(len(head), 8)].astype(np.int64)
        self.edges[head] = self._prune(head, np.broadcast_to(head, (len(head), len(head))).astype(np.int64))
        at = len(head)
        while at < n:
            batch = order[at : at + min(at, _BATCH)].astype(np.int64)
            found, _ = self.search(self.vectors[batch])
            # points of one batch don't see each other in the graph yet; the nearest of them are candidates as well
            own = self.vectors[batch] @ self.vectors[batch].T
            np.fill_diagonal(own, -np.inf)
            k = min(8, len(batch))
            mates = batch[np.argpartition(-own, k - 1, axis=1)[:, :k]]
            candidates = np.concatenate([found, mates], axis=1)
            edges = self._prune(batch, candidates)
            self.edges[batch] = edges
            self._join_back(np.repeat(batch, self.degree), edges.ravel())
            at += len(batch)

    def _join_back(self, sources: np.ndarray, targets: np.ndarray) -> None:
        """Edges back from each target, the nearest first; targets with too many are pruned again.

        Of those that a batch adds to one target, the nearest ``2 * degree`` are candidates: pruning takes the nearest
        first, so what is farther could only be kept in a place that is left over.
        """
        ok = targets >= 0
        sources, targets = sources[ok], targets[ok].astype(np.int64)
        near = np.einsum("nd,nd->n", self.vectors[sources], self.vectors[targets])
        order = np.lexsort((-near, targets))
        sources, targets = sources[order], targets[order]
        points, begins, counts = np.unique(targets, return_index=True, return_counts=True)
        slot = np.arange(len(targets)) - np.repeat(begins, counts)
        for lo in range(0, len(points), _BATCH * 2):
            chosen = points[lo : lo + _BATCH * 2]
            width = int(min(counts[lo : lo + _BATCH * 2].max(), 2 * self.degree))
            extra = np.full((len(chosen), width), -1, np.int64)
            a = begins[lo]
            b = begins[lo + len(chosen) - 1] + counts[lo + len(chosen) - 1]
            row, col = np.repeat(np.arange(len(chosen)), counts[lo : lo + len(chosen)]), slot[a:b]
            fits = col < width
            extra[row[fits], col[fits]] = sources[a:b][fits]
            have = self.edges[chosen].astype(np.int64)
            free = (have < 0).sum(axis=1)
            roomy = free >= counts[lo : lo + len(chosen)]
            if roomy.any():
                both = np.sort(np.concatenate([have[roomy], extra[roomy]], axis=1), axis=1)
                both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
                self.edges[chosen[roomy]] = -np.sort(-both, axis=1)[:, : self.degree]
            if (~roomy).any():
                self.edges[chosen[~roomy]] = self._prune(chosen[~roomy], np.concatenate([have[~roomy], extra[~roomy]], axis=1))
