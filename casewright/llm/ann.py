"""Approximate nearest neighbours: one HNSW graph per shard, stored as flat neighbour arrays; shard results merged."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .hnsw import Graph

#: Bytes of a shard's vectors in double precision, so that a graph fits a task; and fewest shards, for parallel builds.
SHARD_BYTES, MIN_SHARDS = 128 << 20, 6
#: Bytes of the queries that meet a graph in one task.
BLOCK_BYTES = 64 << 20
#: Queries of each task that are answered by brute force as well.
AUDIT = 64
_PIECE = 8 << 20
INDEX = "shard int, part int, seq int, kind string, data binary"


def usable(vec: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def n_shards(n: int, width: int) -> int:
    """Shards for n vectors of `width` components."""
    return max(MIN_SHARDS, -(-n * width * 8 // SHARD_BYTES))


def to_rows(shard: int, arrays: list[np.ndarray]) -> pa.Table:
    """Arrays of one shard as rows of at most 8 MB."""
    out: dict[str, list] = {"shard": [], "part": [], "seq": [], "kind": [], "data": []}
    for part, a in enumerate(arrays):
        raw = np.ascontiguousarray(a).tobytes()
        for seq in range(max(1, -(-len(raw) // _PIECE))):
            for key, x in zip(out, (shard, part, seq, a.dtype.str, raw[seq * _PIECE : (seq + 1) * _PIECE]), strict=True):
                out[key].append(x)
    return pa.table({k: pa.array(v, {"kind": pa.string(), "data": pa.binary()}.get(k, pa.int32())) for k, v in out.items()})


def from_rows(table: pa.Table) -> list[np.ndarray]:
    rows = sorted(table.select(["part", "seq", "kind", "data"]).to_pylist(), key=lambda r: (r["part"], r["seq"]))
    out: list[np.ndarray] = []
    for part in range(rows[-1]["part"] + 1):
        own = [r for r in rows if r["part"] == part]
        out.append(np.frombuffer(b"".join(r["data"] for r in own), own[0]["kind"]))
    return out


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as (n, d) float64."""
    n = len(column)
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def meet(index: DataFrame, queries: DataFrame, shards: int, n_bytes: int, run, schema: str) -> DataFrame:
    """Every query against every shard's graph. queries: id long, embedding, n_bytes of them in double precision.
    run(arrays, ids, vectors) -> pa.Table.

    Graphs go to each block of queries and queries to each shard; a task holds one graph and one block."""
    blocks = max(2, -(-n_bytes // BLOCK_BYTES))
    n = shards * blocks
    key = F.col("shard") * blocks + F.col("block")
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("cell", key.cast("int"))
    right = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("cell", key.cast("int")).select("cell", "id", "embedding")

    def both(graph: pa.Table, rows: pa.Table) -> pa.Table:
        if not graph.num_rows or not rows.num_rows:
            return run(None, np.zeros(0, np.int64), np.zeros((0, 0)))
        return run(from_rows(graph), rows.column("id").to_numpy(), matrix(rows.column("embedding")))

    left, right = left.repartitionById(n, F.col("cell")), right.repartitionById(n, F.col("cell"))
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(both, schema)


def build_index(df: DataFrame, m: int = 12, beam: int = 48) -> tuple[DataFrame, int, int]:
    """df: id long, embedding, copies array<long> (ids with exactly this vector, at most what a search returns).

    Inner-product search: vectors are lengthened by one component to the greatest norm, so that nearest by cosine is
    largest by product; every row is indexed, none sampled. -> (stored index, number of shards, components of a vector)."""
    n, wide, top = df.agg(F.count("*"), F.max(F.size("embedding")), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    shards, top = n_shards(n, wide or 1), math.sqrt(top or 0.0) or 1.0

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        v = matrix(table.column("embedding"))
        ids = table.column("id").to_numpy()
        rest = np.sqrt(np.maximum(top * top - (v * v).sum(axis=1), 0.0))
        graph = Graph.build(np.column_stack([v, rest]) / top, ids, m, beam)
        copies = table.column("copies").combine_chunks()
        lens = np.array([len(x) for x in copies], dtype="<i8")
        own = [ids.astype("<i8"), lens, copies.flatten().to_numpy().astype("<i8"), v.ravel()]
        return to_rows(table.column("shard")[0].as_py(), [*own, *graph.arrays()])

    sharded = df.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    built = sharded.repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(make, INDEX)
    return stored(built, "index"), shards, wide or 1


def nearest(df: DataFrame, queries: DataFrame | None = None, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", width: int = 96, recall: float = 0.93) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k rows of df with the largest inner product, other
    than the query's own id, ties to the smaller id, score in double precision on the vectors as given.

    Each task audits the recall of its shard on some queries (AUDIT or more) by brute force, and widens its beam by
    half from `width`, up to the whole shard, until at least `recall` of their neighbours are found.

    queries: rows with the same columns, by default those of df whose id is divisible by 20. Vectors that are null,
    empty, all zero, or hold null or non-finite components, and rows with a null id, take no part. Vectors must have
    one length. Exact copies share one node, with the k + 1 smallest ids. An id is listed once for a query: rows that
    repeat an id count by their best product, on either side. Empty tables give an empty result.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("embedding")).filter(F.col("id").isNotNull() & usable(F.col("embedding")))
    asked = rows.filter("id % 20 = 0") if queries is None else queries.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("embedding")).filter(F.col("id").isNotNull() & usable(F.col("embedding")))
    # -0.0 and 0.0 give the same products; grouping by the text of the vector would split them, so add zero
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0).cast("float")))
    few = Window.partitionBy("embedding").orderBy("id")
    kept = rows.withColumn("n", F.dense_rank().over(few)).filter(F.col("n") <= k + 1)
    nodes = kept.groupBy("embedding").agg(F.sort_array(F.collect_set("id")).alias("copies")).select(F.element_at("copies", 1).alias("id"), "embedding", "copies")
    index, shards, wide = build_index(stored(nodes, "nodes"))
    asked = stored(asked, "queries")
    types = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(arrays, ids: np.ndarray, v: np.ndarray) -> pa.Table:
        if arrays is None:
            return pa.Table.from_batches([], schema=types)
        own, lens, copies, flat, *rest = arrays
        graph = Graph.from_arrays(rest)
        original = flat.reshape(len(own), -1)
        norm = np.sqrt((v * v).sum(axis=1))
        lifted = np.column_stack([v / norm[:, None], np.zeros(len(v))])
        # some of the queries are answered by brute force too, and the beam grows by half until enough of that is found
        some, beam, near = np.arange(0, len(ids), max(1, len(ids) // AUDIT)), max(width, 2 * k), min(k, len(own))
        best = [np.argpartition(-(original @ v[q]), near - 1)[:near] for q in some]
        while beam < len(own):
            got = graph.search(lifted[some], beam)[0]
            if sum(len(np.intersect1d(a, b)) for a, b in zip(best, got, strict=True)) >= recall * near * len(some):
                break
            beam += beam // 2
        place = graph.search(lifted, beam)[0]
        first = np.cumsum(lens) - lens
        out_q, out_v, out_s = [], [], []
        for q in range(len(ids)):
            p = place[q][place[q] >= 0]
            score = original[p] @ v[q]
            n = lens[p]
            at = np.repeat(first[p], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cand, s = copies[at], np.repeat(score, n)
            s, cand = s[cand != ids[q]], cand[cand != ids[q]]
            top = np.lexsort((cand, -s))
            if len(np.unique(cand)) < len(cand):  # an id with several vectors: its best product
                top = top[np.sort(np.unique(cand[top], return_index=True)[1])]
            top = top[:k]
            out_q.append(np.full(len(top), ids[q]))
            out_v.append(cand[top])
            out_s.append(s[top])
        return pa.table([np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)], schema=types)

    found = meet(index, asked, shards, asked.count() * wide * 8, run, "query_id long, vec_id long, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # one shuffle for both
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
