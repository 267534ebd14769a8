"""Shards of the embedding near-dedup: what a task holds is bounded, and many shards in several passes give every link."""

import numpy as np
import pyarrow as pa

from casewright.llm import embedding_dedup, hnsw


def test_marks_of_a_build_are_bounded(monkeypatch):
    v = np.random.default_rng(1).normal(size=(3000, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    whole = hnsw.Graph.build(v, np.arange(len(v))).arrays()
    monkeypatch.setattr(hnsw, "MARKS", 1 << 16)
    most, search = [], hnsw.beam_search
    monkeypatch.setattr(hnsw, "beam_search", lambda vectors, links, queries, *rest: (most.append(len(vectors) * len(queries)), search(vectors, links, queries, *rest))[1])
    graph = hnsw.Graph.build(v, np.arange(len(v)))
    assert all(np.array_equal(a, b) for a, b in zip(graph.arrays(), whole, strict=True))
    graph.search(v[:700], 20)
    assert max(most) <= 1 << 16


def test_vectors_stay_in_their_precision():
    column = pa.chunked_array([pa.array([[1.0, 2.0]], pa.list_(pa.float32())), pa.array([[3.0, 4.0]], pa.list_(pa.float32()))])
    assert embedding_dedup.vectors(column).dtype == np.float32 and embedding_dedup.vectors(column).tolist() == [[1, 2], [3, 4]]


def test_many_shards_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BUILD_BYTES", 150 * (28 * 8 + 600))
    monkeypatch.setattr(embedding_dedup, "PASS_BYTES", 40000)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1500, 8))
    v[100:400] = v[3] + rng.normal(size=(300, 8)) * 0.25 * np.linalg.norm(v[3]) / 8  # many about the link angle
    v[500:520] = v[7]
    v = v.astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    u = v.astype(float) / np.sqrt((v.astype(float) ** 2).sum(axis=1))[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    assert embedding_dedup.n_shards(1500, 8) == 10
    got = embedding_dedup.near_duplicates(df).toPandas().sort_values("vec_id")
    comp = np.arange(len(v))
    for _ in range(60):
        comp = np.minimum(comp, np.where(link, comp[None, :], len(v)).min(axis=1))
    assert got["n_links"].tolist() == link.sum(axis=1).tolist() and got["component_id"].tolist() == comp.tolist()
