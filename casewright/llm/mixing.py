"""Mixing sources to target weights by the cube method: balanced sampling of tokens and documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Documents in one flight; what a flight leaves undecided (two at most) flies again with others'.
BUCKET = 1000
EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Moves inclusion probabilities along the null space of (document count, tokens) until at most two lie strictly
    between 0 and 1. Three undecided documents have a direction that keeps both totals; each step ends with one
    decided; noise in (0,1), one per document, picks the sense so that expectations are kept."""
    p = p.astype(float).copy()
    size = size.astype(float)
    held: list[int] = []
    order = np.argsort(-size, kind="stable")  # neighbours in size trade with each other, and the smallest are left
    for i in order:
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = round(p[i])
            continue
        held.append(int(i))
        if len(held) < 3:
            continue
        a, b, c = held
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[k]) / x if x > 0 else -p[k] / x) for k, x in zip(held, u, strict=True) if x)
        down = min((p[k] / x if x > 0 else (p[k] - 1) / x) for k, x in zip(held, u, strict=True) if x)
        move = up if noise[i] * (up + down) < down else -down
        for k, x in zip(held, u, strict=True):
            p[k] = min(1.0, max(0.0, p[k] + move * x))
        held = [k for k in held if EPS < p[k] < 1 - EPS]
    decided = (p <= EPS) | (p >= 1 - EPS)
    p[decided] = np.round(p[decided])
    return p


def _fly(pdf: pd.DataFrame, held: int = 0) -> pd.DataFrame:
    """held: documents that stay on the ground as they are, evenly over the order of ids, for the landing's exchanges."""
    pdf = pdf.sort_values(["id", "size", "tie", "row"], kind="stable", na_position="last")
    p, size, noise = pdf["p"].to_numpy().copy(), pdf["size"].to_numpy(), pdf["noise"].to_numpy()
    flies = np.ones(len(p), dtype=bool)
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if held and len(open_):
        flies[open_[np.unique(np.linspace(0, len(open_) - 1, min(held, len(open_))).astype(int))]] = False
    p[flies] = flight(p[flies], size[flies], noise[flies])
    return pdf.assign(p=p)


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    """At most a few undecided documents of a source: the whole-number choice nearest in tokens, then exchanges of one
    document for another, which keep the number of documents, while they bring the tokens nearer."""
    pdf = pdf.reset_index(drop=True)
    begun = pdf["p"]
    pdf = _fly(pdf)
    begun = begun[pdf.index].to_numpy()
    left = np.flatnonzero((pdf["p"] > EPS) & (pdf["p"] < 1 - EPS))
    p, size = pdf["p"].to_numpy().copy(), pdf["size"].to_numpy().astype(float)
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(size[i] * ((m >> k & 1) - p[i]) for k, i in enumerate(left))), m))
    for k, i in enumerate(left):
        p[i] = best >> k & 1
    open_ = (begun > EPS) & (begun < 1 - EPS)
    for _ in range(len(pdf)):
        over = float((size * (p - begun)).sum())
        ins, outs = np.flatnonzero(open_ & (p == 1)), np.flatnonzero(open_ & (p == 0))
        if not len(ins) or not len(outs):
            break
        outs = outs[np.argsort(size[outs], kind="stable")]
        at = np.searchsorted(size[outs], size[ins] - over)
        a, b = outs[np.maximum(at - 1, 0)], outs[np.minimum(at, len(outs) - 1)]
        gap = np.abs(over - np.stack([size[ins] - size[a], size[ins] - size[b]]))
        k, i = np.unravel_index(gap.argmin(), gap.shape)
        if gap[k, i] > abs(over) - 1e-6:
            break
        p[ins[i]], p[(a, b)[k][i]] = 0.0, 1.0
    return pdf.assign(p=p)


def _step(table: pa.Table) -> pa.Table:
    """A source's only bucket lands; one of several flies, and holds back its part of half a bucket."""
    buckets = table.column("buckets")[0].as_py()
    pdf = table.drop_columns(["id"]).to_pandas()
    pdf["id"] = table.column("id").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)  # a null leaves the others whole numbers
    out = _land(pdf) if buckets <= 1 else _fly(pdf, BUCKET // 2 // buckets)
    return pa.Table.from_pandas(out, schema=table.schema, preserve_index=False)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source, source_size) -> adds weight and target (double). Sources by code point, null last, take the
    weights in turn; targets share `share` of all sizes by weight, none above cap * source_size, the excess reshared."""
    spark = sources.sparkSession
    n = max(1, spark.sparkContext.defaultParallelism)
    s = stored(sources.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = {r[0]: r[1] for r in s.groupBy("part").count().collect()}  # a row per partition
    at, offsets = 0, []
    for part in sorted(counts):
        offsets += [F.lit(part), F.lit(at)]
        at += counts[part]
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    if offsets:
        rank = rank + F.create_map(*offsets)[F.col("part")]
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    s = stored(s.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")), "weights")
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:  # each round fills sources for good, and stops when none is above
        over = F.col("most") <= F.lit(level) * F.col("weight")
        r = s.agg(F.sum(F.when(over, F.col("most")).otherwise(0.0)).alias("m"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("w"), F.count_if(over).alias("n")).first()
        if not r["w"] or r["n"] == full:
            break
        full, level = r["n"], max(level, (total - r["m"]) / r["w"])
    return s.withColumn("target", F.least("most", F.lit(level) * F.col("weight"))).drop("most")


def mix_sources(df: DataFrame, size, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7, keep: list[str] = ()) -> DataFrame:
    """One row per row of df: id, source, size, source_size, target, copies (whole times the mix takes it), then keep.

    size: a Column of whole numbers, not null. Each row of a source is due target / source_size times: the whole part
    always, the rest by the cube method in buckets of a source, so that tokens and documents both balance; a source of
    any size is spread over buckets of about 1000 rows by hash, and what these leave undecided or hold back flies again
    until the source is down to one bucket, which lands, whatever the size of other sources. The landing ends with
    exchanges of one document for another, a departure from the cube method that trades some of the inclusion chances of
    that bucket's documents for tokens nearer to the target. Null sources form one source; null ids and repeated rows
    are rows like others. Where more rows of a source than a bucket holds share (id, size), they are told apart by their
    place in the scan, so no bucket grows with them; reruns agree as long as the table is read in the same splits then,
    and always otherwise. Empty: empty.
    """
    row = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), size.cast("long").alias("size"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep])
    given = base = stored(row.withColumn("row", F.monotonically_increasing_id()), "sizes")
    # (id, size) that a bucket can't hold: none, unless ids are null or repeat
    hot = base.groupBy("source", "id", "size").count().filter(F.col("count") > BUCKET).select("source", "id", "size", F.lit(True).alias("hot"))
    hot = stored(hot, "hot")
    if not hot.isEmpty():
        same = [F.col(f"b.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("source", "id", "size")]
        base = base.alias("b").join(hot.alias("h"), same, "left").select("b.*", F.when(F.col("hot"), F.col("row")).otherwise(0).alias("tie"))
    else:
        base = base.withColumn("tie", F.lit(0).cast("long"))
    sums = given.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sums = stored(sums, "sums")
    targets = source_targets(sums.select("source", "source_size"), weights, share, cap)
    info = targets.alias("t").join(sums.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.source", "t.source_size", "t.target", "s.n_docs")
    info = stored(info, "targets")
    many, most = info.agg(F.count("*"), F.max("n_docs")).first()
    joined = base.alias("b").join(F.broadcast(info.alias("i")) if many <= 100_000 else info.alias("i"), F.col("b.source").eqNullSafe(F.col("i.source")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + F.lit(EPS))
    rows = joined.select("b.*", "i.source_size", "i.target", "i.n_docs", whole.cast("long").alias("whole"), F.greatest(ratio - whole, F.lit(0.0)).alias("p"))
    rows = rows.withColumn("noise", (F.pmod(F.xxhash64("id", "size", "tie", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30))
    lean = ["id", "row", "tie", "source", "size", "source_size", "target", "n_docs", "whole", "p", "noise"]
    schema = "id long, row long, tie long, source string, size long, source_size long, target double, n_docs long, whole long, p double, noise double, bucket long, buckets long"
    live, done, at, level = rows.select(*lean), [], most or 0, 0
    left = F.col("n_docs")
    while True:
        left = F.ceil(left / BUCKET)  # buckets of this flight, by source
        at = -(-at // BUCKET)
        live = live.withColumn("bucket", F.pmod(F.xxhash64("id", "size", "tie", F.lit(seed + 1 + level)), left).cast("long")).withColumn("buckets", left.cast("long"))
        live = live.groupBy("source", "bucket").applyInArrow(_step, schema)
        live = stored(live, "flight")
        if at <= 1:
            done.append(live)
            break
        open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done.append(live.filter(~open_))
        live = live.filter(open_).drop("bucket", "buckets")
        # at most two undecided a bucket, and those held back
        left, at, level = left * 2 + BUCKET // 2, at * 2 + BUCKET // 2, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.select("id", "row", "source", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies"))
    if not keep:
        return out.drop("row")
    back = given.select(F.col("row"), *[f"keep_{c}" for c in keep])
    return out.join(back, "row").select("id", "source", "size", "source_size", "target", "copies", *[F.col(f"keep_{c}").alias(f"kept_{c}") for c in keep])


def mix_report(df: DataFrame, size, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    out = mix_sources(df, size, id_col, source_col, **options)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
