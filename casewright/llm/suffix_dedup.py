"""Suffix-array dedup: longest previous factors from suffix order, removing later copies and keeping the first."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import loads, ranges
from .spans import covered_runs, earlier_spans


def smaller_neighbours(rank_of: np.ndarray, near: np.ndarray | None = None):
    """Previous and next smaller values: for each i the nearest j < i (-1) and j > i (n) with rank_of[j] < rank_of[i].
    Pointers jump over what is already known to be no smaller, so runs of equal or falling values take few rounds.
    near[i]: what i has in common with i - 1. Given it, the least of near on the way to each neighbour is returned too."""
    n = len(rank_of)
    out = []
    for step, wall in ((-1, -1), (1, n)):
        at = np.arange(n) + step
        low = np.zeros(n, dtype=np.int16)
        if near is not None and n:
            low = near.astype(np.int16) if step < 0 else np.append(near[1:], 0).astype(np.int16)
        todo = np.arange(n)
        while len(todo):
            j = at[todo]
            inside = (j >= 0) & (j < n)
            todo, j = todo[inside], j[inside]
            more = rank_of[j] >= rank_of[todo]
            todo, j = todo[more], j[more]
            low[todo], at[todo] = np.minimum(low[todo], low[j]), at[j]
        low[at == wall] = 0
        out += [at, low]
    return (out[0], out[2]) if near is None else tuple(out)


def suffix_order(data: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that begin at `place` by their first `length` bytes, and what each has in common with the
    one before: whole 8-byte words, in bytes, and `length` where all is equal. `length` bytes of data follow each place."""
    view, words, tail = loads(data), -(-length // 8), length % 8
    keep = np.uint64((~((1 << (8 * (8 - tail))) - 1) & ((1 << 64) - 1)) if tail else (1 << 64) - 1)
    keys = [view[place + 8 * j].byteswap() for j in range(words)]
    keys[-1] = keys[-1] & keep
    sa = np.lexsort(keys[::-1])
    near = np.zeros(len(sa), dtype=np.int16)
    same = np.ones(len(sa), dtype=bool)
    same[:1] = False
    for j, k in enumerate(keys):
        k = k[sa]
        same[1:] &= k[1:] == k[:-1]
        near[same] = min(8 * (j + 1), length)
    return sa, near


def longest_previous_factors(data: np.ndarray, place: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each suffix, what it has in common with the nearest suffixes, before and after it in suffix order, of a smaller
    document: the longest factor there that an earlier document has too, in 8-byte words up to `length`. Exact at
    `length`: it is reached if and only if an earlier document holds the first `length` bytes."""
    sa, near = suffix_order(data, place, length)
    _, before, _, after = smaller_neighbours(doc[sa], near)
    out = np.empty(len(sa), dtype=np.int16)
    out[sa] = np.maximum(before, after)
    return out


def suffix_order_solver(h, off, start, n_win, ids, body, length):
    """The windows of one bucket's segments whose longest previous factor has `length` bytes: later copies."""
    dup = np.zeros(int(n_win.sum()), dtype=bool)
    base = np.cumsum(n_win) - n_win
    order = np.argsort(h, kind="stable")
    g = h[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = g[1:] != g[:-1]
    size = np.bincount(np.cumsum(new) - 1) if len(g) else np.zeros(0, np.int64)
    order = order[np.repeat(size > 1, size)]  # an anchor with one segment has nothing to match
    reach = np.cumsum(n_win[order])
    done = 0
    while done < len(order):
        # blocks of some 400,000 windows, cut between anchors
        upto = max(done + 1, int(np.searchsorted(reach, (reach[done - 1] if done else 0) + 400_000)))
        while upto < len(order) and h[order[upto]] == h[order[upto - 1]]:
            upto += 1
        s = order[done:upto]
        done = upto
        doc = np.unique(ids[s], return_inverse=True)[1]
        lpf = longest_previous_factors(body, ranges(start[s], n_win[s]), np.repeat(doc, n_win[s]), length)
        dup[ranges(base[s], n_win[s])[lpf >= length]] = True
    return dup


def _digest(p, units, covered):
    removed, spans = covered_runs(covered, p.starts, p.ends)
    kept = [p.data[s:e][~covered[s:e]] if r else p.data[s:e] for s, e, r in zip(p.starts, p.ends, removed, strict=True)]
    return {
        "doc_id": pa.array(p.ids, mask=~p.known),
        "n_bytes": p.ends - p.starts,
        "n_removed": removed,
        "n_spans": spans,
        "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept],
    }


def remove_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per row of df: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of its text as UTF-8.

    Every byte covered by a `length`-byte string that also starts in a row with a smaller id is removed; matches never
    cross texts, and strings are judged on the input. Null text: empty. A null id: the row is neither removed from nor
    a source. Rows with equal ids don't remove from each other; repeated rows give one result each. Other columns are
    not read, so their names can't clash. An empty table gives an empty result.
    """
    return earlier_spans(df, id_col, text_col, "byte", length, suffix_order_solver, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(data: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """covered without the characters of which only some bytes are covered."""
    lead = (data & 0xC0) != 0x80
    number = np.cumsum(lead) - lead[:1]
    if not len(data):
        return covered
    full = np.bincount(number, weights=~covered) == 0
    return full[number]


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, size_col: str | None = None) -> DataFrame:
    """df with repeated passages (as in remove_repeated_bytes) cut out of the text; characters are cut whole or not at
    all, so the text stays valid. size_col, if given, is set to the new number of characters. Null text stays null."""
    cols = df.columns
    others = [c for c in cols if c != text_col]
    flag = "__null_text"
    while flag in cols:
        flag += "_"
    from pyspark.sql import functions as F

    def finish(p, units, covered):
        cut = whole_characters(p.data, covered)
        extra = p.extra().to_pydict()
        null = extra.pop(flag)
        texts = [None if x else p.data[s:e][~cut[s:e]].tobytes().decode() for s, e, x in zip(p.starts, p.ends, null, strict=True)]
        out = {c: extra[c] for c in others} | {text_col: texts}
        if size_col:
            out[size_col] = [len(x) if x is not None else n for x, n in zip(texts, out[size_col], strict=True)]
        return {c: pa.array(out[c]) if out[c] and any(v is not None for v in out[c]) else out[c] for c in cols}

    return earlier_spans(df.withColumn(flag, F.col(f"`{text_col}`").isNull()), id_col, text_col, "byte", length, suffix_order_solver, finish, df.schema, [*others, flag])
