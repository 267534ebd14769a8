"""N-gram Jaccard join: an exact metric-space join of shingle sets with pivots, Voronoi regions and boundary windows.

Unrelated texts all lie at Jaccard distance 1 from each other, so pivots alone would make every document a boundary
document of every region. Regions are therefore seeded exactly first: sets within the radius differ in at most D
shingles, so of D + 1 + c classes of the shingle universe at least c + 1 hold the same shingles of both; documents that
agree on a class meet. Documents linked by such meetings form a ball, and inside a ball the metric join runs (see
metric_links): regions of pivots, boundary documents replicated, regions joined recursively, every link verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, gram_hashes, mix, pack_arrays, pack_sorted, parts, ranges, release, stored, unpack_arrays, unpack_sorted, words_of
from .components import connected_components
from .packets import Packet, packed
from .spans import bounds

#: A region with no more documents is joined by comparing them all; a larger one gets pivots.
LEAF = 64
#: A shingle is common if at least this share of documents hold it; then it seeds no region (unless nearly all of a
#: document's are common).
COMMON = 0.01


def shingle_sets(packet: Packet, n: int):
    """(hashes, from, to): the distinct n-word shingles of each document, ascending. Fewer words: the sequence itself."""
    h, _, _, first = words_of(packet.data, packet.starts, packet.ends, lower=True)
    lens = np.diff(first)
    grams = gram_hashes(h, n)
    count = np.maximum(lens - n + 1, 0)
    hashes = grams[ranges(first[:-1], count)] if len(grams) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(lens)), count)
    short = np.flatnonzero((lens > 0) & (lens < n))
    if len(short):
        whole = np.array([int(mix(gram_hashes(h[first[i] : first[i] + lens[i]], int(lens[i])) + np.uint64(lens[i]))[0]) for i in short], dtype=np.uint64)
        hashes, doc = np.concatenate([hashes, whole]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    cut = np.searchsorted(doc, np.arange(len(lens) + 1))
    return hashes, cut[:-1], cut[1:]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _summary(n: int):
    """Per document its set's size and 128-bit fingerprint; per packet the shingles common in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, head, data in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "head", "data")), strict=True):
                p = Packet(head, data)
                s, a, b = shingle_sets(p, n)
                f1, f2 = _fingerprints(s, a, b)
                common, df = np.unique(s, return_counts=True)
                often = df >= max(3, COMMON * len(p.ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk]), pa.array([p.ids.tolist()], pa.list_(pa.int64())), pa.array([p.known.tolist()], pa.list_(pa.bool_())),
                        pa.array([(b - a).tolist()], pa.list_(pa.int64())), pa.array([_signed(f1).tolist()], pa.list_(pa.int64())), pa.array([_signed(f2).tolist()], pa.list_(pa.int64())),
                        pa.array([_signed(common[often]).tolist()], pa.list_(pa.int64())), pa.array([df[often].tolist()], pa.list_(pa.int64())),
                    ],
                    names=["chunk_id", "ids", "known", "sizes", "f1", "f2", "common", "df"],
                )

    return run


def _fingerprints(s, a, b):
    c1 = np.concatenate([[np.uint64(0)], np.cumsum(mix(s + np.uint64(1)), dtype=np.uint64)])
    c2 = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(0x5DEECE66D)), dtype=np.uint64)])
    return c1[b] - c1[a], c2[b] - c2[a]


def spare_classes(differ: int, threshold: float) -> int:
    """Classes beyond those that D differences can spoil; a document has seldom more classes with a single shingle.
    A lower threshold needs more classes, so they are smaller, and more of them hold one shingle or none."""
    return 1 + differ // (12 if threshold >= 0.85 else 3)


def levels(threshold: float, most: int) -> list[tuple[int, int, int]]:
    """(least, greatest size, classes) of the smaller set's size levels; the larger may be 1/threshold times as big."""
    out, low = [], 1
    while low <= most:
        high = max(low, int(low / math.sqrt(threshold)))
        differ = int(math.floor(high * (1 - threshold) / threshold + 1e-9))
        out.append((low, high, differ + 1 + spare_classes(differ, threshold) if differ else 0))
        low = high + 1
    return out


def _signatures(n: int, threshold: float, common: np.ndarray, n_buckets: int, most: int):
    """Signatures of the sets that a packet's documents lead, by buckets of their hashes."""
    table = levels(threshold, most)
    highs = np.array([x[1] for x in table], dtype=np.int64)

    def sign(s: np.ndarray, first: np.ndarray, count: np.ndarray, docs: np.ndarray, level: int, salt: int, thin_too: bool):
        """Signatures of the docs' sets at a level: a hash of each class's shingles. Classes with one shingle or none
        would bring unrelated documents together; they sign only where thin_too. -> (hash, doc, docs with more such
        classes than are to spare)"""
        classes = table[level][2]
        differ = int(math.floor(highs[level] * (1 - threshold) / threshold + 1e-9))
        x = s[ranges(first[docs], count[docs])]
        key = np.repeat(np.arange(len(docs)) * classes, count[docs]) + (mix(x + np.uint64(salt + 1)) % np.uint64(classes)).astype(np.int64)
        v = mix(x ^ np.uint64(0xABCDEF12345))
        size = len(docs) * classes
        low = np.bincount(key, weights=(v & np.uint64(0xFFFFFFFF)).astype(float), minlength=size).astype(np.uint64)
        high = np.bincount(key, weights=(v >> np.uint64(32)).astype(float), minlength=size).astype(np.uint64)
        total = low + (high << np.uint64(32))
        thick = np.bincount(key, minlength=size) > 1
        sparse = (classes - thick.reshape(len(docs), classes).sum(axis=1)) > spare_classes(differ, threshold)
        at = np.flatnonzero(thick | thin_too)
        tag = (at % classes).astype(np.uint64) + np.uint64((level << 20) + (salt << 40))
        return mix(total[at] + mix(tag)), docs[at // classes], docs[sparse]

    def run(packets: pa.Table, leaders: pa.Table) -> pa.Table:
        buckets, chunks, payloads = [], [], []
        docs = np.sort(leaders.column("place").to_numpy()) if leaders.num_rows else np.zeros(0, np.int64)
        for row in packets.to_pylist() if len(docs) else ():
            p = Packet(row["head"], row["data"])
            s, a, b = shingle_sets(p, n)
            size = b - a
            rare = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s if len(common) else np.ones(len(s), dtype=bool)
            c = np.concatenate([[0], np.cumsum(rare)])
            some, some_at, some_n = s[rare], c[a], c[b] - c[a]
            out = []
            own = np.searchsorted(highs, size[docs])
            lowest = np.searchsorted(highs, np.ceil(size[docs] * threshold - 1e-9))
            for level in range(len(table)):
                # a document signs its own level, and those below in which a smaller partner may be
                todo = docs[(own >= level) & (lowest <= level)]
                if not table[level][2] or not len(todo):
                    continue
                h, d, todo = sign(some, some_at, some_n, todo, level, 0, False)
                out.append((h, d))
                # partners of which both have too many thin classes meet under another division, over all shingles
                for salt in range(1, 6):
                    if not len(todo):
                        break
                    h, d, todo = sign(s, a, size, todo, level, salt, salt == 5)
                    out.append((h, d))
            if not out:
                continue
            h, d = np.concatenate([x[0] for x in out]) >> np.uint64(16), np.concatenate([x[1] for x in out])
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            cut = np.searchsorted(h, bounds(n_buckets))
            for i in np.flatnonzero(np.diff(cut)):
                buckets.append(i)
                chunks.append(row["chunk_id"])
                place, which = np.unique(d[cut[i] : cut[i + 1]], return_inverse=True)  # only these documents' ids go along
                hashes = pack_sorted(h[cut[i] : cut[i + 1]])
                payloads.append(len(hashes).to_bytes(4, "little") + hashes + pack_arrays(which.astype("<u2" if len(place) <= 1 << 16 else "<u4"), place.astype("<u4"), p.ids[place]))
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "chunk_id": pa.array(chunks, pa.int64()), "payload": pa.array(payloads, pa.binary())})

    return run


def _meetings(table: pa.Table) -> pa.Table:
    """A bucket's documents with equal signatures, as stars round the least id; each row with its star once."""
    hs, ids, places, chunks = [], [], [], []
    for chunk, x in zip(table.column("chunk_id").to_pylist(), table.column("payload"), strict=True):
        raw = x.as_py()
        n = int.from_bytes(raw[:4], "little")
        h = unpack_sorted(raw[4 : 4 + n])
        which, place, own = unpack_arrays(raw[4 + n :])
        hs.append(h)
        ids.append(own[which])
        places.append(place[which].astype(np.int64))
        chunks.append(np.full(len(h), chunk))
    h, ids, place, chunk = map(np.concatenate, (hs, ids, places, chunks))
    order = np.lexsort((place, chunk, ids, h))
    h, ids, place, chunk = h[order], ids[order], place[order], chunk[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    # every row of a signature that two ids have: an id's rows may differ in their texts
    group = np.cumsum(new) - 1
    shared = np.bincount(group, weights=ids != ids[head])[group] > 0 if len(ids) else new
    pair = np.unique(np.column_stack([ids, ids[head], chunk, place])[shared], axis=0)
    return pa.table({"id": pair[:, 0], "star": pair[:, 1], "chunk_id": pair[:, 2], "place": pair[:, 3]})


class Sets:
    """Sorted sets end to end, with the list of rows that hold each shingle, for exact distances from one row to all."""

    def __init__(self, values: np.ndarray, lens: np.ndarray):
        self.lens = lens
        self.first = np.cumsum(lens) - lens
        owner = np.repeat(np.arange(len(lens)), lens)
        _, self.codes, self.freq = np.unique(values, return_inverse=True, return_counts=True)
        self.holders = owner[np.argsort(self.codes, kind="stable")].astype(np.int32)
        self.at = np.cumsum(self.freq) - self.freq

    def shared(self, row: int) -> np.ndarray:
        """Shingles that each row shares with one."""
        c = self.codes[self.first[row] : self.first[row] + self.lens[row]]
        return np.bincount(self.holders[ranges(self.at[c], self.freq[c])], minlength=len(self.lens))


class Parts:
    """Rows by connected part: the smaller of two parts takes the label of the larger."""

    def __init__(self, label: np.ndarray):
        self.label = label
        self.members = {int(k): list(np.flatnonzero(label == k)) for k in np.unique(label)} if len(np.unique(label)) < len(label) else {k: [k] for k in range(len(label))}
        self.links: list[tuple[int, int]] = []

    def join(self, row: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = int(self.label[row]), int(self.label[j])
            if a != b:
                if len(self.members[a]) < len(self.members[b]):
                    a, b = b, a
                moved = self.members.pop(b)
                self.label[moved] = a
                self.members[a] += moved
                self.links.append((row, j))


def metric_links(sets: Sets, percent: int, label: np.ndarray, n_pivots: int = 64, settled: dict | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows, similarities): the links at 100 * both >= percent * union between rows of different labels, some more
    than once. A caller that gives connected rows one label as it goes gets only enough to connect what all links would.
    settled counts rows by what settles them.

    Pivots are taken, and each row goes to the region of its nearest one, unless it is farther than `edge` from all: then
    to the region of far rows, which gets pivots of its own. By the triangle inequality a row x can have links into the
    region of pivot p only if d(x, p) is at most twice the radius more than its least distance and at most the radius
    more than the farthest of p's own rows; and into the far region only if its least distance is above edge - radius.
    Such boundary rows are replicated, and regions join recursively. Where regions don't divide the rows (their distances
    are all alike), those that can be near share one of their rarest shingles, and these are compared. What is
    connected already needs no further comparison, so then a group of near copies costs a pass for each pivot."""
    radius = 1 - percent / 100 + 1e-9
    settled = {} if settled is None else settled

    def against(i: int, others: np.ndarray):
        both = sets.shared(i)[others]
        union = sets.lens[others] + sets.lens[i] - both
        hit = (100 * both >= percent * union) & (others != i) & (label[others] != label[i])
        return (i, others[hit], both[hit] / union[hit]), 1 - both / union

    def among(rows: np.ndarray):
        lens = sets.lens[rows]
        settled["shingles"] = settled.get("shingles", 0) + len(rows)
        owner = np.repeat(np.arange(len(rows)), lens)
        which = sets.codes[ranges(sets.first[rows], lens)]
        freq = np.bincount(which, minlength=len(sets.freq))
        order = np.lexsort((which, freq[which], owner))
        which = which[order]
        place = np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens)
        # two sets within the radius meet in their first |x| - ceil(t |x|) + 1 shingles of any common order
        front = (place < (lens - -(-percent * lens // 100) + 1)[owner]) & (freq[which] > 1)
        owner, which = owner[front], which[front]
        own = np.searchsorted(owner, np.arange(len(rows) + 1))
        held = owner[np.argsort(which, kind="stable")]
        count = np.bincount(which, minlength=len(sets.freq))
        at = np.cumsum(count) - count
        for k in range(len(rows)):
            c = which[own[k] : own[k + 1]]
            met = held[ranges(at[c], count[c])]
            met = np.unique(met[met > k])
            other, i = rows[met], rows[k]
            other = other[(label[other] != label[i]) & (100 * sets.lens[other] >= percent * sets.lens[i]) & (100 * sets.lens[i] >= percent * sets.lens[other])]
            if len(other):
                yield against(int(i), other)[0]

    todo = [np.arange(len(sets.lens))]
    while todo:
        rows = todo.pop()
        if len(rows) < 2 or (label[rows] == label[rows[0]]).all():
            continue
        if len(rows) <= LEAF:
            yield from among(rows)
            continue
        # pivots of different parts, spread over the rows
        heads = rows[np.unique(label[rows], return_index=True)[1]]
        picks = heads[np.unique(np.linspace(0, len(heads) - 1, n_pivots).astype(int))]
        dist = np.empty((len(picks), len(rows)))
        for k, p in enumerate(picks):
            found, dist[k] = against(int(p), rows)
            yield found
        near, least = dist.argmin(axis=0), dist.min(axis=0)
        # the edge with fewest rows on the boundary of the far region
        edges = np.linspace(radius, 1 - 1e-6, 40)
        ordered = np.sort(least)
        edge = edges[np.argmin(np.searchsorted(ordered, edges, "right") - np.searchsorted(ordered, edges - radius, "right"))]
        core = least <= edge
        regions = [rows[least > edge - radius] if (~core).any() else rows[:0]]
        for k in range(len(picks)):
            mine = core & (near == k)
            if mine.any():
                regions.append(rows[core & (dist[k] - least <= 2 * radius) & (dist[k] <= least[mine].max() + radius)])
        if max(map(len, regions)) <= 0.95 * len(rows) and sum(map(len, regions)) <= 1.5 * len(rows):
            settled["regions"] = settled.get("regions", 0) + len(rows)
            todo += regions
        else:
            yield from among(rows)


def nodes(node: np.ndarray) -> np.ndarray:
    """For each row the first row of equal value."""
    _, at, which = np.unique(node, return_index=True, return_inverse=True)
    return at[which]


def metric_join(sets: Sets, percent: int, n_pivots: int = 64, node: np.ndarray | None = None, settled: dict | None = None) -> list[tuple[int, int]]:
    """Links (as rows) that connect exactly what all links connect. node: rows with an equal value are one node,
    connected from the start."""
    parts = Parts(np.arange(len(sets.lens)) if node is None else nodes(node))
    for row, others, _ in metric_links(sets, percent, parts.label, n_pivots, settled=settled):
        parts.join(row, others)
    return parts.links


def _gather(n: int):
    """The sets of the documents asked for, each to its ball."""

    def run(packets: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"ball": [], "id": [], "size": [], "values": []}
        for row in packets.to_pylist():
            if not asked.num_rows:
                break
            p = Packet(row["head"], row["data"])
            s, a, b = shingle_sets(p, n)
            for ball, one, place in zip(*(asked.column(c).to_pylist() for c in ("ball", "id", "place")), strict=True):
                out["ball"].append(ball)
                out["id"].append(one)
                out["size"].append(int(b[place] - a[place]))
                out["values"].append(s[a[place] : b[place]].tobytes())
        return pa.table({"ball": pa.array(out["ball"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "size": pa.array(out["size"], pa.int64()), "values": pa.array(out["values"], pa.binary())})

    return run


def _ball(table: pa.Table) -> tuple[np.ndarray, Sets]:
    table = table.sort_by([("size", "ascending"), ("id", "ascending")])
    values = np.frombuffer(b"".join(x.as_py() for x in table.column("values")), dtype=np.uint64)
    return table.column("id").to_numpy(), Sets(values, table.column("size").to_numpy())


def _join_ball(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids, sets = _ball(table)
        links = metric_join(sets, percent, node=ids)
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in links], pa.int64()), "b": pa.array([int(ids[j]) for _, j in links], pa.int64())})

    return run


def _link_ball(percent: int):
    """All links of a ball, as they are found, so that their number needn't fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets = _ball(pa.Table.from_batches(batches))
        for row, others, alike in metric_links(sets, percent, nodes(ids)):
            if len(others):
                yield pa.RecordBatch.from_pydict({"a": np.minimum(ids[row], ids[others]), "b": np.maximum(ids[row], ids[others]), "similarity": alike})

    return run


def _balls(df: DataFrame, id_col: str, text_col: str, words: int, percent: int):
    """(docs, those that can link, leaders of equal sets, the leaders' sets grouped by ball, tables to discard)."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    threshold = percent / 100
    spark = df.sparkSession
    packets = packed(df, id_col, text_col)
    small = packets.select("chunk_id", "head", "data")
    kinds = "chunk_id long, ids array<long>, known array<boolean>, sizes array<long>, f1 array<long>, f2 array<long>, common array<long>, df array<long>"
    seen = stored(small.mapInArrow(_summary(words), kinds), "summary")
    docs = seen.select("chunk_id", F.posexplode(F.arrays_zip("ids", "known", "sizes", "f1", "f2")).alias("place", "x"))
    docs = docs.select("chunk_id", "place", F.when(F.col("x.known"), F.col("x.ids")).alias("doc_id"), F.col("x.sizes").alias("n_shingles"), "x.f1", "x.f2")
    n_docs, most = docs.agg(F.count("*"), F.max("n_shingles")).first()
    total = packets.agg(F.sum("n_bytes")).first()[0] or 0
    # no more than 1 / COMMON times the mean set size, since each is in COMMON of all documents
    often = seen.select(F.explode(F.arrays_zip("common", "df")).alias("x")).groupBy("x.common").agg(F.sum("x.df").alias("n")).filter(F.col("n") >= max(3.0, COMMON * n_docs))
    common = np.sort(np.array([r[0] for r in often.select("common").collect()], dtype=np.int64).view(np.uint64))
    n = parts(spark, total)
    # of the rows with one set, however many, only the one with the least id signs and joins; the others link to it
    known = docs.filter("doc_id is not null and n_shingles > 0")
    leaders = known.groupBy("n_shingles", "f1", "f2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "chunk_id", "place")).alias("x"))
    leaders = stored(leaders.select("n_shingles", "f1", "f2", "n", F.col("x.doc_id").alias("b"), "x.chunk_id", "x.place"), "leaders")
    by_chunk = small.repartition(n, "chunk_id").groupBy("chunk_id").cogroup(leaders.select("chunk_id", F.col("place").cast("long").alias("place")).repartition(n, "chunk_id").groupBy("chunk_id"))
    signed = by_chunk.applyInArrow(_signatures(words, threshold, common, n, most or 0), "bucket int, chunk_id long, payload binary")
    met = stored(signed.repartitionById(n, F.col("bucket")).groupBy("bucket").applyInArrow(_meetings, "id long, star long, chunk_id long, place long"), "meetings")
    release(spark)
    balls = connected_components(met.select(F.col("id").alias("a"), F.col("star").alias("b")))
    # the places where the sets of a ball are read
    where = met.select("id", "chunk_id", "place").distinct()
    asked = where.join(balls, "id").select(F.col("component_id").alias("ball"), "id", "chunk_id", "place")
    asked = stored(asked, "asked")
    discard(met)
    sets = small.repartition(n, "chunk_id").groupBy("chunk_id").cogroup(asked.repartition(n, "chunk_id").groupBy("chunk_id")).applyInArrow(_gather(words), "ball long, id long, size long, values binary")
    return docs, known, leaders, sets.repartition(n, "ball").groupBy("ball"), (asked, packets, leaders)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id.

    A row's set: its distinct shingles of `words` words (A-Z lower-cased); with fewer words the whole sequence; empty
    without words. Rows link when 100 * intersection >= percent * union; component_id is the smallest id reachable.
    Empty sets and null texts link with nothing. A null id: never linked, null component. Rows that repeat an id are
    one node. Other columns are not read. Empty: empty. Sets are compared by 64-bit shingle hashes.
    """
    spark = df.sparkSession
    docs, known, leaders, sets, scratch = _balls(df, id_col, text_col, words, percent)
    links = sets.applyInArrow(_join_ball(percent), "a long, b long")
    alike = known.join(leaders.filter("n > 1").select("n_shingles", "f1", "f2", "b"), ["n_shingles", "f1", "f2"]).filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    links = stored(links.unionByName(alike), "links")
    for spent in scratch:
        discard(spent)
    release(spark)
    comps = connected_components(links)
    out = docs.join(comps, docs["doc_id"] == comps["id"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(links, members), with sets and links as in jaccard_components.

    Rows of equal sets form a class, whose representative is its smallest id. members: doc_id, representative, one row
    for each id and class; ids without a set are in none. links: a, b, similarity: every link between representatives,
    a < b, once, so all links between different sets; rows of one class link with each other and with all that their
    representative links with. An id that repeats with different texts has a class for each; of several similarities of
    one pair the greatest is given, and its classes are not linked with each other. The recursion is that of
    jaccard_components, without leaving out what is connected already: the cost grows with the number of links.
    """
    spark = df.sparkSession
    _, known, leaders, sets, (asked, packets, _) = _balls(df, id_col, text_col, words, percent)
    found = sets.applyInArrow(_link_ball(percent), "a long, b long, similarity double")
    links = stored(found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "links")
    key = ["n_shingles", "f1", "f2"]
    members = known.join(leaders.select(*key, F.col("b").alias("representative")), key).select("doc_id", "representative").distinct()
    for spent in (asked, packets):
        discard(spent)
    release(spark)
    return links, members
