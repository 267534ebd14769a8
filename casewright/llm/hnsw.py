"""Hierarchical navigable small-world graphs in numpy: flat neighbour arrays, searched for many queries in step."""

from __future__ import annotations

import numpy as np

#: Rows of a batch searched in step; and the most marks of rows seen that they hold together, 4 bytes each.
STEP, MARKS = 512, 16 << 20


def levels_of(keys: np.ndarray, m: int) -> np.ndarray:
    """Geometric levels from a hash of the row's key, so builds agree."""
    from .common import mix

    u = (mix(keys.astype(np.uint64) + np.uint64(11)) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(m)).astype(np.int64)


class Layer:
    """nodes: row numbers of the vectors; links: (n, width) places in nodes, -1 where empty."""

    def __init__(self, nodes: np.ndarray, links: np.ndarray):
        self.nodes, self.links = nodes, links


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, floor: float | None = None, marks: np.ndarray | None = None):
    """Best-first search by inner product for all queries in step. entry: (q, e) places, -1 empty.
    -> (q, width) places and products, best first, -1 and -inf where empty; and whether the beam is full of rows at or
    above floor (then a wider beam could find more). marks: zeros to mark rows in, one for each query and row at least;
    they are zeros again afterwards."""
    q, n = len(queries), len(vectors)
    width = min(width, n)
    place = np.full((q, width), -1, dtype=np.int32)
    score = np.full((q, width), -np.inf, dtype=np.float32)
    done = np.zeros((q, width), dtype=bool)
    seen = np.zeros(q * n, dtype=np.int32) if marks is None else marks
    marked: list[np.ndarray] = []
    rows = np.arange(q)
    few = max(1, width // 16)

    def offer(r: np.ndarray, cand: np.ndarray) -> None:
        cell = (r[:, None] * n + cand)[cand >= 0]
        cell = cell[seen[cell] == 0]
        serial = np.arange(1, len(cell) + 1, dtype=np.int32)
        seen[cell] = serial
        cell = cell[seen[cell] == serial]  # a place that two lists hold, once
        marked.append(cell)
        own, p = np.divmod(cell, n)
        val = np.einsum("ij,ij->i", vectors[p], queries[own])
        good = val > score[own, -1]  # the others don't enter the beam
        own, p, val = own[good], p[good], val[good]
        if not len(own):
            return
        first = np.flatnonzero(np.diff(own, prepend=-1))
        count = np.diff(np.append(first, len(own)))
        u = own[first]
        at = (np.repeat(np.arange(len(u)), count), np.arange(len(own)) - np.repeat(first, count))
        new_s = np.full((len(u), int(count.max())), -np.inf, dtype=np.float32)
        new_p = np.full(new_s.shape, -1, dtype=np.int32)
        new_s[at], new_p[at] = val, p
        all_s = np.concatenate([score[u], new_s], axis=1)
        top = np.argsort(-all_s, axis=1)[:, :width]
        score[u] = np.take_along_axis(all_s, top, 1)
        place[u] = np.take_along_axis(np.concatenate([place[u], new_p], axis=1), top, 1)
        done[u] = np.take_along_axis(np.concatenate([done[u], np.zeros(new_s.shape, dtype=bool)], axis=1), top, 1)

    offer(rows, entry)
    active = rows
    while len(active):
        open_ = ~done[active] & (place[active] >= 0)
        has = open_.any(axis=1)
        active, open_ = active[has], open_[has]
        if not len(active):
            break
        # the best few of each query at once: fewer steps, and no fewer places seen
        rank = np.cumsum(open_, axis=1, dtype=np.int16)
        r, c = np.nonzero(open_ & (rank <= few))
        done[active[r], c] = True
        cand = np.full((len(active), few, links.shape[1]), -1, dtype=np.int64)
        cand[r, rank[r, c] - 1] = links[place[active[r], c]]
        offer(active, cand.reshape(len(active), -1))
    for cell in marked if marks is not None else ():
        marks[cell] = 0
    full = (score[:, -1] >= floor) if floor is not None and width < n else np.zeros(q, dtype=bool)
    return place, score, full


def in_step(n: int) -> int:
    """How many queries are searched in step over n rows, so that their marks stay within bounds."""
    return max(1, min(STEP, MARKS // max(1, n)))


def select_diverse(vectors: np.ndarray, base: np.ndarray, cand: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 empty), up to m that are nearer to the row than to any chosen before;
    then the best of the rest, if there is room."""
    b, c = cand.shape
    safe = np.maximum(cand, 0)
    v = vectors[safe]
    own = np.einsum("bcd,bd->bc", v, base)
    own[cand < 0] = -np.inf
    mutual = v @ v.swapaxes(1, 2)
    chosen = np.zeros((b, c), dtype=bool)
    near = np.full((b, c), -np.inf, dtype=np.float32)  # greatest product with a chosen one
    count = np.zeros(b, dtype=np.int64)
    for i in range(c):
        take = (cand[:, i] >= 0) & (own[:, i] > near[:, i]) & (count < m)
        chosen[:, i] = take
        count += take
        near = np.where(take[:, None], np.maximum(near, mutual[:, i]), near)
    rank = np.where(chosen, 0, 1) * (2 * c) + np.arange(c)[None, :] + np.where(cand < 0, 4 * c, 0)
    top = np.argsort(rank, axis=1)[:, :m]
    out = np.full((b, m), -1, dtype=np.int64)
    out[:, : top.shape[1]] = np.take_along_axis(cand, top, 1)
    return out


class Graph:
    """A shard: vectors (n, d) float32 and the layers, bottom first. Larger product: nearer."""

    def __init__(self, vectors: np.ndarray, layers: list[Layer]):
        self.vectors, self.layers = vectors, layers
        self.local: np.ndarray | None = None  # the vectors in the order of the bottom layer, once something is searched

    @classmethod
    def build(cls, vectors: np.ndarray, keys: np.ndarray, m: int = 12, beam: int = 48) -> Graph:
        vectors = np.ascontiguousarray(vectors, dtype=np.float32)
        level = levels_of(keys, m)
        layers: list[Layer] = []  # top first while building
        for depth in range(int(level.max(initial=0)), -1, -1):
            nodes = np.flatnonzero(level >= depth)
            nodes = nodes[np.argsort(-level[nodes], kind="stable")]  # those of the layer above come first
            layers.append(_build_layer(vectors, nodes, layers, m if depth else 2 * m, m, beam))
        return cls(vectors, layers[::-1])

    def entries(self, queries: np.ndarray) -> np.ndarray:
        return _descend(self.vectors, self.layers[:0:-1], queries, self.layers[0].nodes)

    def search(self, queries: np.ndarray, width: int, floor: float | None = None):
        """(rows, products, full) as beam_search, in blocks of queries that bound memory."""
        bottom = self.layers[0]
        if self.local is None:
            self.local = self.vectors[bottom.nodes]
        local, step, out = self.local, in_step(len(bottom.nodes)), []
        marks = np.zeros(step * len(local), dtype=np.int32)
        for i in range(0, len(queries), step):
            q = np.ascontiguousarray(queries[i : i + step], dtype=np.float32)
            place, score, full = beam_search(local, bottom.links, q, self.entries(q), width, floor, marks)
            out.append((np.where(place >= 0, bottom.nodes[np.maximum(place, 0)], -1), score, full))
        if not out:
            return np.zeros((0, width), np.int64), np.zeros((0, width), np.float32), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def arrays(self) -> list[np.ndarray]:
        """Flat arrays for storage: sizes, vectors, then nodes and neighbours of each layer."""
        sizes = [len(self.vectors), self.vectors.shape[1] if self.vectors.ndim == 2 else 0]
        flat: list[np.ndarray] = []
        for x in self.layers:
            sizes += [len(x.nodes), x.links.shape[1]]
            flat += [x.nodes.astype("<i4"), x.links.astype("<i4").ravel()]
        return [np.array(sizes, dtype="<i8"), self.vectors.astype("<f4").ravel(), *flat]

    @classmethod
    def from_arrays(cls, arrays: list[np.ndarray]) -> Graph:
        sizes, vectors, *flat = arrays
        n, d = sizes[:2]
        layers = [Layer(flat[2 * i].astype(np.int64), flat[2 * i + 1].astype(np.int64).reshape(-1, w)) for i, w in enumerate(sizes[3::2])]
        return cls(vectors.reshape(n, d), layers)


def _descend(vectors: np.ndarray, above: list[Layer], queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Places in `nodes` to start from. Nodes of a layer come first, in the same order, in the layer below."""
    best = np.zeros((len(queries), 1), dtype=np.int64)
    for layer in above:
        best = beam_search(vectors[layer.nodes], layer.links, queries, best, 1)[0]
    return np.minimum(best, len(nodes) - 1)


def _build_layer(vectors, nodes, above, width, m, beam) -> Layer:
    n = len(nodes)
    local = vectors[nodes]
    links = np.full((n, width), -1, dtype=np.int64)
    first = min(n, 256)
    if n > 1:  # the first rows by brute force
        s = local[:first] @ local[:first].T
        np.fill_diagonal(s, -np.inf)
        cand = np.argsort(-s, axis=1, kind="stable")[:, : min(beam, first - 1)]
        chosen = select_diverse(local, local[:first], cand, m)
        links[:first, : chosen.shape[1]] = chosen
        _link_back(local, links, np.arange(first), chosen)
    have, marks = first, np.zeros(in_step(n) * n, dtype=np.int32)
    while have < n:
        new = np.arange(have, min(n, have + min(STEP, have)))
        q = local[new]
        entry = np.concatenate([_descend(vectors, above, q[i : i + in_step(n)], nodes) for i in range(0, len(q), in_step(n))])
        entry = np.where(entry < have, entry, 0)
        step = len(marks) // have
        found = [beam_search(local[:have], links[:have], q[i : i + step], entry[i : i + step], beam, None, marks)[:2] for i in range(0, len(q), step)]
        cand, score = (np.concatenate(x) for x in zip(*found, strict=True))
        mutual = q @ q.T  # rows of one batch may be each other's neighbours
        np.fill_diagonal(mutual, -np.inf)
        k = min(16, len(new) - 1)
        if k > 0:
            mate = np.argpartition(-mutual, k - 1, axis=1)[:, :k]
            cand = np.concatenate([cand, new[mate]], axis=1)
            score = np.concatenate([score, np.take_along_axis(mutual, mate, 1)], axis=1)
            top = np.argsort(-score, axis=1)[:, :beam]
            cand = np.take_along_axis(cand, top, 1)
        chosen = select_diverse(local, q, cand, m)
        links[new, : chosen.shape[1]] = chosen
        _link_back(local, links, new, chosen)
        have += len(new)
    return Layer(nodes, links)


def _link_back(local: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Adds the reverse links; where a row has too many, the diverse ones stay."""
    width = links.shape[1]
    r, c = np.nonzero(chosen >= 0)
    to, frm = chosen[r, c], new[r]
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    target, first, count = np.unique(to, return_index=True, return_counts=True)
    for lo in range(0, len(target), 1024):
        t, f, k = target[lo : lo + 1024], first[lo : lo + 1024], count[lo : lo + 1024]
        wide = int(k.max())
        add = np.full((len(t), wide), -1, dtype=np.int64)
        rr = np.repeat(np.arange(len(t)), k)
        cc = np.arange(len(rr)) - np.repeat(np.cumsum(k) - k, k)
        add[rr, cc] = frm[np.repeat(f, k) + cc]
        both = np.concatenate([links[t], add], axis=1)
        s = np.sort(both, axis=1)
        s[:, 1:][s[:, 1:] == s[:, :-1]] = -1
        val = np.einsum("bcd,bd->bc", local[np.maximum(s, 0)], local[t])
        val[s < 0] = -np.inf
        top = np.argsort(-val, axis=1)[:, : 3 * width]
        s, val = np.take_along_axis(s, top, 1), np.take_along_axis(val, top, 1)
        fits = (s >= 0).sum(axis=1) <= width
        if fits.any():
            keep = s[fits][:, :width]
            links[t[fits], : keep.shape[1]] = keep
            links[t[fits], keep.shape[1] :] = -1
        over = np.flatnonzero(~fits)
        for i in range(0, len(over), 256):
            o = over[i : i + 256]
            links[t[o]] = select_diverse(local, local[t[o]], s[o], width)
