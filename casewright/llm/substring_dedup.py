"""Substring dedup by relative Lempel-Ziv factors over words, against indexed blocks of earlier documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import gram_hashes, ranges
from .spans import earlier_spans


def relative_lz_solver(h, off, start, n_win, ids, body, length):
    """One bucket's segments are a reference block, indexed by the hash of each `length`-word string with its first
    owner (least document). Each segment is then parsed greedily: the factor at a place is the longest match with the
    owner found there; the next place asked is the first string that straddles the factor's end, so a copy that goes
    on in another source isn't lost at the boundary. Factors of at least `length` words are duplicate spans."""
    n_seg = len(start)
    total = int(n_win.sum())
    dup = np.zeros(total, dtype=bool)
    if not total:
        return dup
    base = np.cumsum(n_win) - n_win
    place = ranges(start, n_win)
    seg = np.repeat(np.arange(n_seg), n_win)
    key = gram_hashes(body, length)[place]
    order = np.lexsort((ids[seg], key))
    new = np.ones(total, dtype=bool)
    new[1:] = key[order][1:] != key[order][:-1]
    owner = np.empty(total, dtype=np.int64)
    owner[order] = order[np.maximum.accumulate(np.where(new, np.arange(total), 0))]
    found = np.flatnonzero(ids[seg[owner]] < ids[seg])
    if not len(found):
        return dup
    # the strings themselves must agree, not only their hashes
    same = np.ones(len(found), dtype=bool)
    for j in range(length):
        same &= body[place[found] + j] == body[place[owner[found]] + j]
    found = found[same]
    hit = np.zeros(total, dtype=bool)
    hit[found] = True
    after = np.where(hit, np.arange(total), total)
    after = np.minimum.accumulate(after[::-1])[::-1]  # the next string of any segment that has an earlier owner
    last = base + n_win  # one past each segment's strings
    active = np.unique(seg[found])
    cur = base[active]
    while len(active):
        cur = after[np.minimum(cur, total - 1)]
        live = cur < last[active]
        active, cur = active[live], cur[live]
        if not len(active):
            break
        src = owner[cur]
        # longest extension of the factor, in words, inside both segments
        room = np.minimum(last[active] - cur, last[seg[src]] - src) + length - 1
        size = np.full(len(cur), length)
        grow = np.flatnonzero(size < room)
        while len(grow):
            ok = body[place[cur[grow]] + size[grow]] == body[place[src[grow]] + size[grow]]
            grow = grow[ok]
            size[grow] += 1
            grow = grow[size[grow] < room[grow]]
        n = size - length + 1
        dup[ranges(cur, n)] = True
        cur = cur + n  # the first string that straddles the factor's end
        live = cur < last[active]
        active, cur = active[live], cur[live]
    return dup


def _digest(p, units, covered):
    first = np.append(units.starts, units.ends[-1:])
    c = np.concatenate([[0], np.cumsum(covered)])
    removed = c[first[1:]] - c[first[:-1]]
    data = p.data.tobytes()
    sha = []
    for i, (s, e) in enumerate(zip(p.starts, p.ends, strict=True)):
        words = data[s:e].split()
        if removed[i]:
            words = [w for w, x in zip(words, covered[first[i] : first[i + 1]].tolist(), strict=True) if not x]
        sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return {"doc_id": pa.array(p.ids, mask=~p.known), "n_words": units.ends - units.starts, "n_removed": removed, "kept_sha256": sha}


def remove_repeated_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per row of df: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space).

    Every word covered by `length` consecutive words whose sequence also starts in a row with a smaller id is removed;
    sequences are judged on the input and never cross texts. Words are runs of bytes other than ASCII blanks, compared
    by 64-bit hashes. Null text: no words. A null id: the row is neither removed from nor a source. Rows with equal
    ids don't remove from each other. Other columns are not read. An empty table gives an empty result.
    """
    return earlier_spans(df, id_col, text_col, "word", length, relative_lz_solver, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
