"""A hierarchical navigable small-world graph over unit vectors; whole batches are inserted and searched
in step."""

from __future__ import annotations

import numpy as np

LINKS = 16          # of a node on each upper layer; twice as many on the lowest
BEAM = 64           # nodes held while inserting, and at first while searching
AT_ONCE = 512       # nodes inserted, or queries searched, in step
EXPANDED = 4        # nodes of each beam expanded in one step


class Graph:
    """``vectors`` is an array of unit vectors (float32), one row each."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        self.vectors = vectors
        size = len(vectors)
        random = np.random.default_rng(seed)
        self.level = np.minimum(np.floor(-np.log(1 - random.random(size)) / np.log(LINKS)), 8).astype(int)
        self.layers: list[np.ndarray] = [
            np.full((size, LINKS * (2 if layer == 0 else 1)), -1, np.int32)
            for layer in range(self.level.max() + 1 if size else 0)]
        # High nodes first: the upper layers stand before the lower ones fill up.
        order = np.lexsort((random.random(size), -self.level))
        self.entry = int(order[0]) if size else -1
        at = 1
        while at < size:
            batch = order[at:at + min(AT_ONCE, at)]
            self._insert(batch)
            at += len(batch)

    def _similar(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        found = np.einsum("qd,qnd->qn", queries, self.vectors[nodes])
        found[nodes < 0] = -2
        return found

    def _beam(self, queries: np.ndarray, start: np.ndarray, layer: int, width: int):
        """The best ``width`` nodes found on a layer for each query, best first: (nodes, similarities)."""
        links, rows = self.layers[layer], np.arange(len(queries))[:, None]
        beam = np.full((len(queries), width), -1, np.int64)
        score = np.full((len(queries), width), -2, np.float32)
        start = start[:, :width]
        beam[:, :start.shape[1]] = start
        score[:, :start.shape[1]] = self._similar(queries, start)
        seen = np.zeros((len(queries), len(self.vectors) + 1), bool)  # the last stands for "no node"
        seen[rows, start] = True
        done = beam < 0
        while not done.all():
            # The best nodes not yet expanded, of queries that have any.
            going = np.flatnonzero(~done.all(axis=1))
            waiting = np.where(done[going], -3, score[going])
            best = np.argsort(-waiting, axis=1)[:, :EXPANDED]
            mine = np.arange(len(going))[:, None]
            chosen = np.where(waiting[mine, best] > -3, beam[going[:, None], best], -1)
            done[going[:, None], best] = True
            near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(going), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = np.where(seen[going[:, None], near], -1, near)
            seen[going[:, None], near] = True
            value = self._similar(queries[going], near)
            nodes = np.concatenate([beam[going], near], axis=1)
            values = np.concatenate([score[going], value], axis=1)
            old = np.concatenate([done[going], near < 0], axis=1)
            top = np.argsort(-values, axis=1, kind="stable")[:, :width]
            beam[going], score[going] = nodes[mine, top], values[mine, top]
            done[going] = old[mine, top] | (beam[going] < 0)
        return beam, score

    def _descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Where to start on layer ``to``."""
        start = np.full((len(queries), 1), self.entry, np.int64)
        for layer in range(len(self.layers) - 1, to, -1):
            start = self._beam(queries, start, layer, 1)[0]
        return start

    def _diverse(self, nodes: np.ndarray, score: np.ndarray, count: int) -> np.ndarray:
        """Of each row's candidates, best first, those nearer to the query than to one chosen before; then the
        best others, up to ``count``."""
        rows = np.arange(len(nodes))
        chosen = np.full((len(nodes), count), -1, np.int64)
        filled = np.zeros(len(nodes), int)
        taken = np.zeros(nodes.shape, bool)
        for strict in (True, False):
            for column in range(nodes.shape[1]):
                node = nodes[:, column]
                can = (node >= 0) & (filled < count) & ~taken[:, column]
                if strict and can.any():
                    near = np.einsum("qd,qnd->qn", self.vectors[node], self.vectors[chosen])
                    near[chosen < 0] = -2
                    can &= near.max(axis=1) < score[:, column]
                here = rows[can]
                chosen[here, filled[here]] = node[here]
                filled[here] += 1
                taken[here, column] = True
        return chosen

    def _insert(self, batch: np.ndarray) -> None:
        among = self.vectors[batch] @ self.vectors[batch].T
        np.fill_diagonal(among, -2)
        for layer in range(len(self.layers)):
            here = np.flatnonzero(self.level[batch] >= layer)
            if not len(here):
                break
            nodes, links = batch[here], self.layers[layer]
            queries, count = self.vectors[nodes], links.shape[1]
            beam, score = self._beam(queries, self._descend(queries, layer), layer, BEAM)
            # Nodes of the batch can't be found yet; they are compared directly.
            own = among[np.ix_(here, here)]
            own_top = np.argsort(-own, axis=1)[:, :LINKS]
            own_score = np.take_along_axis(own, own_top, axis=1)
            beam = np.concatenate([beam, np.where(own_score > -2, nodes[own_top], -1)], axis=1)
            score = np.concatenate([score, own_score], axis=1)
            order = np.argsort(-score, axis=1, kind="stable")[:, :BEAM]
            beam, score = np.take_along_axis(beam, order, 1), np.take_along_axis(score, order, 1)
            chosen = self._diverse(beam, score, LINKS)
            links[nodes, :LINKS] = chosen
            self._link_back(nodes, chosen, links)

    def _link_back(self, nodes: np.ndarray, chosen: np.ndarray, links: np.ndarray) -> None:
        source = np.repeat(nodes, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        targets, first, many = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(targets), AT_ONCE):
            mine, begin, n = targets[at:at + AT_ONCE], first[at:at + AT_ONCE], many[at:at + AT_ONCE]
            column = np.arange(n.max())
            new = np.where(column < n[:, None],
                           source[np.minimum(begin[:, None] + column, len(source) - 1)], -1)
            all_nodes = np.concatenate([links[mine], new], axis=1)
            all_nodes.sort(axis=1)
            all_nodes[:, 1:][all_nodes[:, 1:] == all_nodes[:, :-1]] = -1
            all_nodes[all_nodes == mine[:, None]] = -1
            score = self._similar(self.vectors[mine], all_nodes)
            order = np.argsort(-score, axis=1, kind="stable")
            all_nodes = np.take_along_axis(all_nodes, order, 1)
            score = np.take_along_axis(score, order, 1)
            full = (all_nodes >= 0).sum(axis=1) > links.shape[1]
            links[mine[~full]] = all_nodes[~full, :links.shape[1]]
            if full.any():
                links[mine[full]] = self._diverse(all_nodes[full], score[full], links.shape[1])

    def within(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of similarities of at least ``least``, as far as found. A beam that is full of such nodes
        is widened until it isn't."""
        found_query, found_node = [], []
        for at in range(0, len(queries), AT_ONCE):
            waiting = np.arange(at, min(at + AT_ONCE, len(queries)))
            width = min(beam, len(self.vectors))
            while len(waiting):
                mine = queries[waiting]
                nodes, score = self._beam(mine, self._descend(mine, 0), 0, width)
                full = (score[:, -1] >= least) & (width < len(self.vectors))
                row, column = np.nonzero((score >= least) & ~full[:, None])
                found_query.append(waiting[row])
                found_node.append(nodes[row, column])
                waiting, width = waiting[full], min(4 * width, len(self.vectors))
        none = np.zeros(0, np.int64)
        return np.concatenate([*found_query, none]), np.concatenate([*found_node, none])
