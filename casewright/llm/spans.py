"""Spans of a document that also start in an earlier document, exactly, at any corpus size.

Method. Every window of `length` units (bytes or words) has one anchor: the leftmost k-gram of least hash inside it.
Equal windows have equal anchors at the same place, so only windows around anchors that occur in two documents need
comparing. (A) each packet sends its distinct anchor hashes to hash buckets, which answer with those seen in two
packets; (B) the packets send the segments around repeated anchors (all windows of one anchor, one copy per packet
and least id) to the anchor's bucket; (C) a solver compares the segments of a bucket (suffix order for bytes, relative
Lempel-Ziv factors for words); (D) the removed runs return to their packets. No text is cut, no bucket is capped:
an anchor shared by a third of all documents arrives once per packet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    block_hashes,
    byte_gram_hashes,
    discard,
    gram_hashes,
    mix,
    pack_arrays,
    pack_sorted,
    parts,
    ranges,
    release,
    stored,
    unpack_arrays,
    unpack_sorted,
    words_of,
)
from .packets import Packet, packed

#: Units in an anchor k-gram.
ANCHOR = {"byte": 16, "word": 8}
#: Bytes of segments that are compared at once in a bucket.
PIECE = 4 << 20


class Units:
    """A packet as a sequence of units with the document bounds in units."""

    def __init__(self, packet: Packet, unit: str):
        self.unit = unit
        if unit == "byte":
            self.raw, self.starts, self.ends = packet.data, packet.starts, packet.ends
            self.values = self.raw
        else:
            self.values, self.w_starts, self.w_ends, first = words_of(packet.data, packet.starts, packet.ends)
            self.starts, self.ends = first[:-1], first[1:]

    def grams(self, k: int) -> np.ndarray:
        return byte_gram_hashes(self.values, k) if self.unit == "byte" else gram_hashes(self.values, k)


def anchors(units: Units, known: np.ndarray, length: int, k: int):
    """(hash, anchor place, first window, one past the last window, document) of each anchor of a packet."""
    h = units.grams(k)
    w = length - k + 1
    lens = units.ends - units.starts
    fits = np.where(known, np.maximum(lens - length + 1, 0), 0)
    if not fits.any():
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < w:
        step = min(have, w - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    start = ranges(units.starts, fits)
    doc = np.repeat(np.arange(len(lens)), fits)
    at = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(at))
    a = at[first]
    # least hashes crowd at one end of their range, so they are scrambled again before they choose a bucket
    return mix(h[a]) >> np.uint64(16), a, start[first], start[end - 1] + 1, doc[first]


def same_runs(values: np.ndarray, starts: np.ndarray, other: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Whether values[s:s+n] equals values[o:o+n], for each run."""
    ok = np.ones(len(starts), dtype=bool)
    for lo in range(0, len(starts), 50_000):
        s, o, n = starts[lo : lo + 50_000], other[lo : lo + 50_000], lens[lo : lo + 50_000]
        bad = values[ranges(s, n)] != values[ranges(o, n)]
        if bad.any():
            ok[lo + np.unique(np.repeat(np.arange(len(n)), n)[bad])] = False
    return ok


def collapse(h, where, start, size, doc, values):
    """Order by (anchor hash, content, document), and for each segment the place in that order of the first with
    equal content. where: the anchor's offset in the segment."""
    content = mix(block_hashes(values, start, start + size) ^ (where.astype(np.uint64) << np.uint64(32)))
    order = np.lexsort((doc, content, h))
    h, content, start, size = h[order], content[order], start[order], size[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (content[1:] != content[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = np.flatnonzero(~new)
    if len(later):
        differ = (size[later] != size[head[later]]) | ~same_runs(values, start[later], start[head[later]], np.minimum(size[later], size[head[later]]))
        head[later[differ]] = later[differ]  # a hash collision stands alone; the solver still compares it
    return order, head


def _send_anchors(unit: str, length: int, n_buckets: int):
    k = ANCHOR[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, head, data in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "head", "data")), strict=True):
                p = Packet(head, data)
                h = np.unique(anchors(Units(p, unit), p.known, length, k)[0])
                cut = np.searchsorted(h, bounds(n_buckets))
                rows = [(b, h[cut[b] : cut[b + 1]]) for b in range(n_buckets) if cut[b] < cut[b + 1]]
                if rows:
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in rows], pa.int32()), "chunk_id": [chunk] * len(rows), "hashes": [pack_sorted(x) for _, x in rows]})

    return run


def bounds(n: int) -> np.ndarray:
    """Bounds of n equal ranges of 48-bit hashes."""
    return np.array([(i << 48) // n for i in range(n)] + [1 << 48], dtype=np.uint64)


def _repeated(table: pa.Table) -> pa.Table:
    chunks = table.column("chunk_id").to_numpy()
    lists = [unpack_sorted(x.as_py()) for x in table.column("hashes")]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    h = np.concatenate(lists)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    same = h[1:] == h[:-1]
    again = np.zeros(len(h), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    h, owner = h[again], owner[again]
    order = np.argsort(owner, kind="stable")
    h, cut = h[order], np.searchsorted(owner[order], np.arange(len(lists) + 1))
    rows = [(int(chunks[i]), pack_sorted(h[cut[i] : cut[i + 1]])) for i in range(len(lists)) if cut[i] < cut[i + 1]]
    return pa.table({"chunk_id": pa.array([c for c, _ in rows], pa.int64()), "hashes": pa.array([x for _, x in rows], pa.binary())})


_SEGMENTS = "bucket int, chunk_id long, kind int, payload binary"


def _send_segments(unit: str, length: int, n_buckets: int):
    k = ANCHOR[unit]

    def run(packets: pa.Table, flags: pa.Table) -> pa.Table:
        out = {"bucket": [], "chunk_id": [], "kind": [], "payload": []}

        def put(bucket, chunk, kind, payload):
            for key, x in zip(out, (bucket, chunk, kind, payload), strict=True):
                out[key].append(x)

        for row in packets.to_pylist():
            p = Packet(row["head"], row["data"])
            units = Units(p, unit)
            h, a, w0, w1, doc = anchors(units, p.known, length, k)
            ids = p.ids[doc]
            order = np.lexsort((ids, h))
            hs, is_ = h[order], ids[order]
            new = np.ones(len(hs), dtype=bool)
            new[1:] = hs[1:] != hs[:-1]
            group = np.cumsum(new) - 1
            local = np.zeros(len(h), dtype=bool)
            if len(hs):
                lo, hi = is_[new], is_[np.append(np.flatnonzero(new)[1:], len(hs)) - 1]
                local[order] = (lo != hi)[group]
            known = np.sort(np.concatenate([unpack_sorted(x.as_py()) for x in flags.column("hashes")])) if flags.num_rows else np.zeros(0, np.uint64)
            at = np.searchsorted(known, h)
            hit = local | (known[np.minimum(at, len(known) - 1)] == h if len(known) else False)
            h, a, w0, w1, ids = h[hit], a[hit], w0[hit], w1[hit], ids[hit]
            if not len(h):
                continue
            size = w1 - w0 + length - 1
            order, head = collapse(h, a - w0, w0, size, ids, units.values)
            h, a, w0, w1, ids, size = (x[order] for x in (h, a, w0, w1, ids, size))
            gone = ids > ids[head]  # the same segment starts in a smaller document of this packet
            if gone.any():
                put(int(row["chunk_id"] % n_buckets), row["chunk_id"], 1, pack_arrays(w0[gone].astype("<u4"), (w1 - w0)[gone].astype("<u4")))
            first = head == np.arange(len(h))
            lead = np.flatnonzero(first)
            stay = ~gone
            number = np.cumsum(first) - 1
            places, which = w0[stay], number[head[stay]]  # every place of each segment that is sent
            by = np.argsort(which, kind="stable")
            places, n_places = places[by].astype("<u4"), np.bincount(which, minlength=len(lead))
            cut = np.searchsorted(h[lead], bounds(n_buckets))
            ends = np.concatenate([[0], np.cumsum(n_places)])
            for b in range(n_buckets):
                i, j = cut[b], cut[b + 1]
                if i < j:
                    g = lead[i:j]
                    body = units.values[ranges(w0[g], size[g])]
                    put(b, row["chunk_id"], 0, pack_arrays(h[g], ids[g], (a - w0)[g].astype("<u2"), (w1 - w0)[g].astype("<u2"), n_places[i:j].astype("<u4"), places[ends[i] : ends[j]], body))
        kinds = {"bucket": pa.int32(), "chunk_id": pa.int64(), "kind": pa.int32(), "payload": pa.binary()}
        return pa.table({c: pa.array(out[c], t) for c, t in kinds.items()})

    return run


def _solve(solver: Callable, unit: str, length: int):
    """solver(segments) -> boolean over all windows of the distinct segments: does it also start in a smaller document?"""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes]] = []
        got = []
        for chunk, kind, payload in zip(*(table.column(c) for c in ("chunk_id", "kind", "payload")), strict=True):
            if kind.as_py() == 1:
                out.append((chunk.as_py(), payload.as_py()))
                continue
            h, ids, off, n_win, n_places, places, body = unpack_arrays(payload.as_py())
            sizes = np.concatenate([[0], np.cumsum(n_win.astype(np.int64) + length - 1)])
            got.append((chunk.as_py(), h, ids, off, n_win, n_places, places, np.concatenate([[0], np.cumsum(n_places, dtype=np.int64)]), body, sizes))
        # anchors in ascending order, some of the bucket's range at a time
        low, high = min((int(x[1][0]) for x in got), default=0), max((int(x[1][-1]) for x in got), default=-1) + 1
        pieces = max(1, sum(x[8].nbytes for x in got) // PIECE)
        for k in range(pieces):
            edges = np.array([low + (high - low) * k // pieces, low + (high - low) * (k + 1) // pieces], dtype=np.uint64)
            some = []
            for chunk, h, ids, off, n_win, n_places, places, p_at, body, b_at in got:
                i, j = np.searchsorted(h, edges)
                if i < j:
                    some.append((chunk, h[i:j], ids[i:j], off[i:j], n_win[i:j], n_places[i:j], places[p_at[i] : p_at[j]], body[b_at[i] : b_at[j]]))
            if some:
                out += solved(some)
        return pa.table({"chunk_id": pa.array([c for c, _ in out], pa.int64()), "runs": pa.array([x for _, x in out], pa.binary())})

    def solved(some) -> list[tuple[int, bytes]]:
        out = []
        h, ids, off, n_win, n_places, places, body = (np.concatenate([x[i] for x in some]) for i in range(1, 8))
        chunk = np.repeat(np.array([x[0] for x in some]), [len(x[1]) for x in some])
        if len(h):
            n_win = n_win.astype(np.int64)
            size = n_win + length - 1
            start = np.cumsum(size) - size
            order, head = collapse(h, off, start, size, ids, body)
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            head = order[head][rank]  # of each segment, the one with the least document
            lead = np.unique(head)
            dup = solver(h[lead], off[lead].astype(np.int64), start[lead], n_win[lead], ids[lead], body, length)
            w_at = np.cumsum(n_win[lead]) - n_win[lead]
            whole = ids > ids[head]
            # runs of duplicate windows of each leading segment
            seg = np.repeat(np.arange(len(lead)), n_win[lead])
            edge = np.ones(len(dup), dtype=bool)
            edge[1:] = (seg[1:] != seg[:-1]) | (dup[1:] != dup[:-1])
            first = np.flatnonzero(edge)
            n = np.diff(np.append(first, len(dup)))
            first, n = first[dup[first]], n[dup[first]]
            r_seg = seg[first]
            r_off, r_from = first - w_at[r_seg], np.searchsorted(r_seg, np.arange(len(lead) + 1))
            # handed to all segments with that content
            slot = np.searchsorted(lead, head)
            n_runs = np.where(whole, 0, r_from[slot + 1] - r_from[slot])
            pick = ranges(r_from[slot], n_runs)
            s = np.concatenate([np.repeat(np.arange(len(h)), n_runs), np.flatnonzero(whole)])
            o = np.concatenate([r_off[pick], np.zeros(int(whole.sum()), np.int64)])
            m = np.concatenate([n[pick], n_win[whole]])
            # and to all places
            p_from = np.cumsum(n_places.astype(np.int64)) - n_places
            copies = n_places[s].astype(np.int64)
            at = places[ranges(p_from[s], copies)].astype(np.int64) + np.repeat(o, copies)
            m, c = np.repeat(m, copies), np.repeat(chunk[s], copies)
            by = np.argsort(c, kind="stable")
            at, m, c = at[by], m[by], c[by]
            for one, i, j in zip(*_groups(c), strict=True):
                out.append((int(one), pack_arrays(at[i:j].astype("<u4"), m[i:j].astype("<u4"))))
        return out

    return run


def _groups(c: np.ndarray):
    first = np.flatnonzero(np.diff(c, prepend=c[:1] - 1)) if len(c) else np.zeros(0, np.int64)
    return c[first], first, np.append(first[1:], len(c))[: len(first)]


def earlier_spans(df: DataFrame, id_col: str, text_col: str, unit: str, length: int, solver: Callable, finish: Callable, schema: str, keep: list[str] = ()) -> DataFrame:
    """Runs A to D. finish(packet, units, covered) -> columns; covered: boolean by unit, True where it is removed."""
    if length < 2 * ANCHOR[unit]:
        raise ValueError(f"length must be at least {2 * ANCHOR[unit]} {unit}s")
    if length > 32_767:
        raise ValueError("length must be at most 32767, for places in a segment are 16-bit numbers")
    packets = packed(df, id_col, text_col, list(keep))
    total = packets.agg(F.sum("n_bytes")).first()[0] or 0
    spark = df.sparkSession
    n = parts(spark, total)
    small = packets.select("chunk_id", "head", "data")
    sent = small.mapInArrow(_send_anchors(unit, length, n), "bucket int, chunk_id long, hashes binary")
    # each step is a job of its own, so that its shuffle files can go before the next writes more
    flags = stored(sent.repartitionById(n, F.col("bucket")).groupBy("bucket").applyInArrow(_repeated, "chunk_id long, hashes binary"), "flags")
    release(spark)
    segments = small.repartition(n, "chunk_id").groupBy("chunk_id").cogroup(flags.repartition(n, "chunk_id").groupBy("chunk_id")).applyInArrow(_send_segments(unit, length, n), _SEGMENTS)
    runs = stored(segments.repartitionById(n, F.col("bucket")).groupBy("bucket").applyInArrow(_solve(solver, unit, length), "chunk_id long, runs binary"), "runs")
    discard(flags)
    release(spark)

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return pa.Table.from_batches([], schema=target)
        (row,) = rows
        p = Packet(row["head"], row["data"], row["extra"])
        units = Units(p, unit)
        edge = np.zeros(len(units.values) + 1, dtype=np.int64)
        for x in right.column("runs"):
            at, m = unpack_arrays(x.as_py())
            at = at.astype(np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + m + length - 1, -1)
        return pa.table(finish(p, units, np.cumsum(edge[:-1]) > 0), schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)
    full = packets.select("chunk_id", "head", "data", "extra")
    return full.repartition(n, "chunk_id").groupBy("chunk_id").cogroup(runs.repartition(n, "chunk_id").groupBy("chunk_id")).applyInArrow(end, schema)


def covered_runs(covered: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(removed units, maximal removed runs) of each document."""
    c = np.concatenate([[0], np.cumsum(covered)])
    begin = covered.copy()
    begin[1:] &= ~covered[:-1]
    inner = starts[starts < len(covered)]
    begin[inner] = covered[inner]
    r = np.concatenate([[0], np.cumsum(begin)])
    return c[ends] - c[starts], r[ends] - r[starts]


