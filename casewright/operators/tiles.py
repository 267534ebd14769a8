"""Pairs of two tiles of rows in numpy: the sums of scoring.similarity for all of them at once, in the same order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that are scored in one step.
STEP = 1 << 19


def _joint(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list]:
    """Codes of both columns, and the values that they stand for."""
    coded = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks().dictionary_encode()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    code = coded.indices.to_numpy(zero_copy_only=False)
    return code[: len(a)], code[len(a) :], coded.dictionary.to_pylist()


def _jaccard(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of each row's set of words, and the index of each two kinds. Words are counted for the rows that have
    them, so the work is what is shared."""
    sets: list[dict[tuple, int]] = [{}, {}]
    kinds = [np.array([own.setdefault(tuple(x), len(own)) for x in c.to_pylist()], np.int64) for own, c in zip(sets, (a, b), strict=True)]
    having: list[dict[int, list[int]]] = [{}, {}]
    for own, by_word in zip(sets, having, strict=True):
        for words, kind in own.items():
            for w in words:
                by_word.setdefault(w, []).append(kind)
    shared = np.zeros((len(sets[0]), len(sets[1])), np.int32)
    for w in having[0].keys() & having[1].keys():
        shared[np.ix_(having[0][w], having[1][w])] += 1
    n = [np.array([len(x) for x in own], np.int32) for own in sets]
    return kinds[0], kinds[1], shared / np.maximum(n[0][:, None] + n[1][None, :] - shared, 1)


def _padded(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of codes; what fills them up differs between both sides."""
    code: dict = {}
    out = []
    for fill, lists in ((-1, a.to_pylist()), (-2, b.to_pylist())):
        rows = np.full((len(lists), max([1, *map(len, lists)])), fill, np.int64)
        for k, x in enumerate(lists):
            rows[k, : len(x)] = [code.setdefault(y, len(code)) for y in x]
        out.append(rows)
    return out[0], out[1]


def pairs(a: pa.Table, b: pa.Table, least: float, equal: tuple[str, ...], worded: tuple[str, ...], schema: pa.Schema) -> pa.Table:
    """left, right, similarity of the pairs of a's and b's rows that are at least that similar and share no key before
    this one; in a tile with itself (i = j) each two rows are taken once."""
    if not a.num_rows or not b.num_rows:
        return schema.empty_table()
    ids = pa.chunked_array([*a.column("id").chunks, *b.column("id").chunks], a.column("id").type).combine_chunks()
    rank = np.asarray(pc.rank(ids, tiebreaker="dense")).astype(np.int64)
    rank_a, rank_b = rank[: a.num_rows], rank[a.num_rows :]
    itself = a.column("i")[0].as_py() == a.column("j")[0].as_py()
    same = []
    for f in equal:
        x, y, values = _joint(a.column(f), b.column(f))
        same.append((np.where(x == (values.index("") if "" in values else -1), -1, x), y))
    near = [_jaccard(a.column(f), b.column(f)) for f in worded]
    number = lambda t, c: t.column(c).to_numpy()
    has_a, has_b, day_a, day_b = number(a, "has"), number(b, "has"), number(a, "day").astype(np.int64), number(b, "day").astype(np.int64)
    before_a, before_b = _padded(a.column("before"), b.column("before"))
    rows, cols, scores = [], [], []
    step = max(1, STEP // b.num_rows)
    for k in range(0, a.num_rows, step):
        own = slice(k, k + step)
        total = np.zeros((len(rank_a[own]), b.num_rows))
        for x, y in same:
            total += x[own, None] == y[None, :]
        for x, y, index in near:
            total += index[x[own]][:, y]
        both = has_a[own, None] & has_b[None, :]
        total += np.where(both >= 32, np.maximum(1.0 - np.abs(day_a[own, None] - day_b[None, :]) / 365, 0.0), 0.0)
        total /= np.maximum(np.bitwise_count(both), 1)
        good = total >= least
        if itself:
            good &= rank_a[own, None] < rank_b[None, :]
        r, c = np.nonzero(good)
        met = np.zeros(len(r), dtype=bool)
        for x in before_a.T:
            for y in before_b.T:
                met |= x[own][r] == y[c]
        r, c = r[~met], c[~met]
        rows.append(r + k)
        cols.append(c)
        scores.append(total[r, c])
    r, c = np.concatenate(rows), np.concatenate(cols)
    lower = rank_a[r] < rank_b[c]
    at, other = np.where(lower, r, c + a.num_rows), np.where(lower, c + a.num_rows, r)
    return pa.Table.from_arrays([ids.take(pa.array(at)), ids.take(pa.array(other)), pa.array(np.concatenate(scores))], schema=schema)
