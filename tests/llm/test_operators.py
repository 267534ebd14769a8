"""The corpus operators against brute force on small tables with nulls, empty texts, ties, repeats and odd columns."""

import base64
import hashlib
import os
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casewright.llm import chat, mixing, pieces, quality, token_output
from casewright.llm.ann import nearest
from casewright.llm.common import sql_words
from casewright.llm.components import connected_components
from casewright.llm.embedding_dedup import near_duplicates
from casewright.llm.jaccard_join import Sets, jaccard_components, jaccard_links, metric_join, metric_links
from casewright.llm.substring_dedup import remove_repeated_words
from casewright.llm.suffix_dedup import longest_previous_factors, remove_repeated_bytes, smaller_neighbours, without_repeats

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def corpus():
    rng = np.random.default_rng(3)
    some = lambda n: " ".join(rng.choice(WORDS, n))
    shared, long = some(70), some(3000)
    rows = [(i, some(int(rng.integers(1, 160)))) for i in range(30)]
    rows += [(30, shared), (31, some(20) + " " + shared + " " + some(10)), (32, shared + "\n" + shared), (33, rows[3][1]), (34, rows[3][1])]
    rows += [(35, None), (36, ""), (37, "  \t\n"), (38, "one"), (39, "ONE"), (40, long), (41, long[:9000] + " changed " + long[9000:]), (42, "é" * 120), (43, "x" + "é" * 90), (44, "ab" * 400), (45, "ab" * 300)]
    rows += [(46, "Just Three Words"), (47, "just three words"), (34, rows[3][1])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    return df.withColumn("n_bytes", F.lit("clash")).withColumn("component_id", F.lit(None).cast("string")).withColumn("chunk_id", F.lit(1))


def brute_spans(units, join, length=50):
    seen = {}
    for i, t in sorted(corpus(), key=lambda r: r[0]):
        x = units(t or "")
        for p in range(len(x) - length + 1):
            seen.setdefault(x[p : p + length] if isinstance(x, bytes) else tuple(x[p : p + length]), i)
    out = []
    for i, t in corpus():
        x = units(t or "")
        cover = [False] * len(x)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length] if isinstance(x, bytes) else tuple(x[p : p + length])] < i:
                cover[p : p + length] = [True] * length
        runs = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        kept = join([y for y, c in zip(x, cover) if not c])
        out.append((i, len(x), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(docs, spark):
    got = sorted(tuple(r) for r in remove_repeated_bytes(docs).collect())
    assert got == brute_spans(str.encode, bytes)
    assert remove_repeated_bytes(docs.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "z" * 80), (1, "z" * 80)], "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in remove_repeated_bytes(null).collect())


def test_without_repeats_keeps_columns_and_characters(docs):
    out = without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r["doc_id"]: r["text"] for r in out.collect()}[43].startswith("x")


def test_substring_dedup(docs):
    got = sorted(tuple(r) for r in remove_repeated_words(docs).collect())
    want = [(i, n, c, sha) for i, n, c, _, sha in brute_spans(lambda t: t.encode().split(), b" ".join)]
    assert got == want
    assert remove_repeated_words(docs.limit(0)).count() == 0


@pytest.mark.parametrize("length", [5, 8, 16, 21])
def test_longest_previous_factors(length):
    rng = np.random.default_rng(length)
    for alphabet, n in ((1, 40), (2, 300), (3, 300)):
        data = rng.integers(97, 97 + alphabet, n + length).astype(np.uint8)
        text = data.tobytes()
        place, doc = np.arange(n), rng.integers(0, 7, n)
        lpf = longest_previous_factors(data, place, doc, length)
        for i in range(n):
            earlier = [next((m for m in range(length) if text[i + m] != text[j + m]), length) for j in range(n) if doc[j] < doc[i]]
            assert lpf[i] <= max(earlier, default=0) and (lpf[i] == length) == (max(earlier, default=0) == length)
            assert lpf[i] >= max(earlier, default=0) // 8 * 8
    x = rng.integers(0, 9, 200)
    prev, nxt = smaller_neighbours(x)
    for i in range(200):
        assert prev[i] == max([j for j in range(i) if x[j] < x[i]], default=-1)
        assert nxt[i] == min([j for j in range(i + 1, 200) if x[j] < x[i]], default=200)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, n, percent):
    sets = {}
    for i, t in corpus():
        w = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()).split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {tuple(r) for r in jaccard_components(docs, words=n, percent=percent).collect()}
    assert got == {(i, len(sets[i]), comp[i]) for i in sets}
    assert jaccard_components(docs.limit(0)).count() == 0
    if percent == 80:
        links, members = jaccard_links(docs, words=n, percent=percent)
        first = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets if sets[i]}
        assert sorted(map(tuple, members.collect())) == sorted(first.items())
        alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in set(first.values()) for j in set(first.values()) if i < j}
        want = {k: x for k, x in alike.items() if 100 * x >= percent - 1e-9}
        assert want and {(r["a"], r["b"]): pytest.approx(r["similarity"]) for r in links.collect()} == want


def test_metric_join():
    """Regions, far rows and the rarest shingles against all pairs."""
    rng = np.random.default_rng(9)
    ways = Counter()
    for groups, size, edits, percent in ((40, 12, 0.05, 85), (3, 200, 0.12, 80), (600, 1, 0.1, 85), (30, 10, 0.4, 80), (2, 20, 0.1, 60)):
        rows = []
        for g in range(groups):
            base = rng.integers(0, 1 << 62, int(rng.integers(5, 80)))
            for _ in range(size):
                x = base.copy()
                change = rng.random(len(x)) < edits * rng.random() * 2
                x[change] = rng.integers(0, 1 << 62, int(change.sum()))
                rows.append(np.unique(np.concatenate([x, [1, 2] if g % 2 else [3]])).astype(np.uint64))
        lens = np.array([len(x) for x in rows])
        sets = Sets(np.concatenate(rows), lens)
        settled = {}
        part = np.arange(len(rows))
        links = metric_join(sets, percent, settled=settled)
        ways.update(settled)
        assert all(100 * len(np.intersect1d(rows[a], rows[b])) >= percent * len(np.union1d(rows[a], rows[b])) for a, b in links)
        for a, b in links:
            part[part == part[b]] = part[a]
        want = np.arange(len(rows))
        for i in range(len(rows)):
            both = sets.shared(i)
            for j in np.flatnonzero(100 * both >= percent * (lens + lens[i] - both)):
                want[want == want[j]] = want[i]
        every = {(min(i, int(j)), max(i, int(j))) for i, js, _ in metric_links(sets, percent, np.arange(len(rows))) for j in js}
        assert every == {(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(100 * sets.shared(i) >= percent * (lens + lens[i] - sets.shared(i))) if i < j}
        assert len(np.unique(part)) == len(np.unique(want)) == len(np.unique(np.column_stack([part, want]), axis=0))
    assert ways["regions"] > 500 and ways["shingles"] > 100


def varied(text, at):
    w = text.split()
    w[at] = "changed"
    return " ".join(w)


def test_jaccard_beside_null_ids(spark):
    t = " ".join(f"w{k}" for k in range(100))
    rows = [(None, t), (7, t), (9, varied(t, 0)), (None, varied(t, 99)), (12, "apart from all others")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = jaccard_components(df, words=5, percent=80).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (7, 7), (9, 7), (12, 12)]


def test_jaccard_repeated_ids(spark):
    t, u = (" ".join(f"{x}{k}" for k in range(100)) for x in "tu")
    rows = [(1, t), (1, u), (2, varied(t, 0)), (3, varied(u, 0)), (4, "apart from all others"), (5, u), (5, "a b c d e f g")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "text")
        got = jaccard_components(df, words=5, percent=80).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (5, 1)]


def test_pipeline_keeps_one_of_each_group(spark):
    import corpus_pipeline

    t, u = (" ".join(f"{x}{k}" for k in range(100)) for x in "tu")
    rows = [(1, t), (1, t), (1, u), (2, varied(t, 0)), (None, u), (None, "v " * 9), (None, "v " * 9), (None, t), (8, ""), (8, None), (9, "apart from all others")]
    df = spark.createDataFrame([(i, x, "en", "s", k) for k, (i, x) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == sorted([(1, t), (1, u), (0, "v " * 9), (8, ""), (8, ""), (9, "apart from all others")])


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 4), (None, 1), (7, 6), (6, 5)], "a long, b long")
    assert dict(connected_components(e).collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4}
    assert connected_components(e.limit(0)).count() == 0
    # a hub with many more edges than parts, whose id is neither the least nor the greatest, and a chain behind it
    rng = np.random.default_rng(4)
    hub = [(500, int(x)) for x in rng.permutation(np.arange(501, 1400))] + [(int(x), 500) for x in range(300, 500)] + [(k, k + 1) for k in range(1399, 1420)]
    rest = [(int(a), int(b)) for a, b in rng.integers(2000, 2600, (400, 2))]
    root = {k: k for e in hub + rest for k in e}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in hub + rest:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    loops = {a for a, b in rest if a == b} - {k for a, b in hub + rest if a != b for k in (a, b)}
    got = dict(connected_components(spark.createDataFrame(hub + rest, "a long, b long").repartition(5)).collect())
    assert got == {k: top(k) for k in root if k not in loops}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 16)).astype(np.float32)
    v[50:120] = v[7] + rng.normal(size=(70, 16)).astype(np.float32) * 0.03
    v[200:210] = v[8]
    rows = [(i, [float(y) for y in x], "c") for i, x in enumerate(v)] + [(300, None, "c"), (301, [0.0] * 16, "c"), (302, [float("nan")] + [1.0] * 15, "c"), (303, [None] + [1.0] * 15, "c"), (None, [1.0] * 16, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links string")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r for r in near_duplicates(df).collect()}
    assert len(got) == 305 and all(got[i]["n_links"] == link[i].sum() for i in range(300))
    comp = np.arange(300)
    for _ in range(20):
        comp = np.minimum(comp, np.where(link, comp[None, :], 999).min(axis=1))
    assert [got[i]["component_id"] for i in range(300)] == comp.tolist()
    assert got[301]["n_links"] == 0 and got[301]["kept"] and got[None]["kept"] is False
    near = nearest(df, k=20).collect()
    hit = 0
    for q in range(0, 300, 20):
        s = v.astype(float) @ v[q].astype(float)
        want = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        own = sorted((r for r in near if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        hit += len({r["vec_id"] for r in own} & set(want))
    assert hit >= 0.95 * 300
    assert near_duplicates(df.limit(0)).count() == 0 and nearest(df.limit(0)).count() == 0


def test_vectors_with_repeated_ids(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    near = lambda x: [float(y) for y in x + 0.001]
    # repeated rows: listed once
    df = spark.createDataFrame(rows + [rows[20], rows[5]], "vec_id long, embedding array<float>")
    got = nearest(df, k=20).collect()
    s = v.astype(float) @ v.astype(float).T
    for q in (0, 20, 40):
        want = [i for i in np.lexsort((np.arange(60), -s[q])) if i != q][:20]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    # an id with two vectors: the better one counts
    df = spark.createDataFrame(rows + [(3, [10 * x for x in rows[20][1]])], "vec_id long, embedding array<float>")
    own = [r["vec_id"] for r in nearest(df, k=20).collect() if r["query_id"] == 20]
    assert len(own) == len(set(own)) == 20 and 3 in own
    # op1: each vector has its own links and component
    df = spark.createDataFrame([(1, rows[0][1]), (1, rows[1][1]), (7, near(v[0])), (8, near(v[1])), (9, rows[2][1]), (9, rows[2][1])], "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (7, 1, 1), (8, 1, 1), (9, 1, 9), (9, 1, 9)]


def test_mixing(spark):
    rows = [(i, None if i % 11 == 0 else f"s{i % 4 if i % 3 else 0}", i * 37 % 91) for i in range(1500)] + [(5, "s9", 0), (None, "s0", 4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix_report(df, F.col("size")).toPandas()
    assert len(out) == len(rows)
    by = out.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by["taken"] - by["target"]) <= 0.01 * by["target"] + 5).all()
    assert (out["taken"] <= 2 * out["size"]).all()
    again = mixing.mix_report(df, F.col("size")).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, out[key].to_numpy().tolist())) == sorted(map(str, again[key].to_numpy().tolist()))
    assert mixing.mix_report(df.limit(0), F.col("size")).count() == 0
    assert spark.sql("select 'a  b c\td' as t").select(sql_words(F.col("t"))).first()[0] == 3


@pytest.mark.parametrize("n", [3000, 700])
def test_mixing_lands_each_source(spark, n):
    rng = np.random.default_rng(3)
    rows = [(i, "hot", int(x)) for i, x in enumerate(rng.integers(1, 400, n))]
    for s in ("a", "b", "c", None):
        own = [*rng.integers(1, 400, 300).tolist(), 9000]
        rows += [(len(rows) + k, s, int(x)) for k, x in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix_sources(df, F.col("size"), weights=(1,), share=1.45, cap=1.7).toPandas()
    assert sorted(out["id"]) == list(range(len(rows)))
    for _, own in out.groupby("source", dropna=False):
        ratio = own["target"].iloc[0] / own["source_size"].iloc[0]
        assert set(own["copies"]) <= {int(ratio), int(ratio) + 1}
        assert abs(len(own) * ratio - own["copies"].sum()) <= 1
        assert abs((own["size"] * own["copies"]).sum() - own["target"].iloc[0]) <= 2


def test_mixing_keeps_ids_beside_nulls(spark):
    big = (1 << 53) + 1
    rows = [(None, "s", 3), (None, "s", 3), *[(big + k, "s", k % 7) for k in range(50)]]
    out = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, source string, size long"), F.col("size")).collect()
    assert sorted((r["doc_id"] or 0) for r in out) == sorted((i or 0) for i, _, _ in rows)
    # more alike rows than a bucket holds
    rows = [(None, "s", 3)] * 2500 + [(k, "s", 5) for k in range(1500)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long"), F.col("size"), share=0.5).toPandas()
    assert len(out) == 4000 and abs((out["size"] * out["copies"]).sum() - out["target"].iloc[0]) <= 5


def test_mixing_targets(spark):
    """Targets by plain resharing, in turn over sources by code point."""
    rng = np.random.default_rng(8)
    names = ["b", "a", "ä", "Z", None, "z", "aa", "", "0"]
    rows = [(k, names[int(x)], int(y)) for k, (x, y) in enumerate(zip(rng.integers(0, 9, 800) ** 2 // 9, rng.integers(0, 60, 800), strict=True))]
    rows.append((900, "zero", 0))
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix_report(df, F.col("size")).toPandas()
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, full = {}, 1.5 * sum(size.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        per = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if per * weight[s] >= 2 * size[s]]
        if not over:
            break
        for s in over:
            full.add(s)
            target[s] = 2.0 * size[s]
            left -= target[s]
    target |= {s: per * weight[s] for s in order if s not in full}
    source = {k: s for k, s, _ in rows}
    for r in out.itertuples():
        assert r.source_size == size[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
    taken = Counter()
    for r in out.itertuples():
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 3 for s in order)


def test_chats(spark):
    hard = ["<|im_end|>", "\\<|", "<\\|", "\\\\", "<|im_sep|>x", None, "", "plain"]
    rows = [(k % 3, k, ("user", "assistant", "odd\nrole", None)[k // 2 % 4], t) for k, t in enumerate(hard * 3)] + [(None, 1, "user", "x"), (7, None, "user", "y"), (7, 1, "user", "y"), (7, 1, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).select("conv_id", chat.parse_chats(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("m")).collect()
    for r in got:
        own = sorted(((t is not None, t or 0, a or "", b or "") for c, t, a, b in rows if c == r["conv_id"]))
        assert [(t["role"], t["text"]) for t in r["t"]] == [(a, b) for *_, a, b in own]
        assert r["m"] == "".join(b for *_, a, b in own if a == "assistant")
    assert chat.chat_digest(df.limit(0)).count() == 0


def test_pieces(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    m = pieces.load(pieces.DEFAULT_MODEL)
    texts = ["", " ", "  two  ", "日本語 ☃ text", "a" * 500, "no spaces" * 60, "line\n\nline", *[t for _, t in corpus() if t]]
    for t in texts:
        ids = m.encode(t)
        assert ids.tolist() == lib.encode(t) and m.decode(ids) == t
        for size in (1, 3, 1000):  # a text in parts, with nothing remembered
            units = m.normal(t)
            parts = [units[k : k + size] for k in range(0, len(units), size)]
            assert list(m._ids(m.stream(parts))) == lib.encode(t)
    for size in (1, 3, len(texts)):
        for k in range(0, len(texts), size):
            part = [*texts[k : k + size], None, "x▁y  z"]
            assert [None if x is None else x.tolist() for x in m.encode_all(pa.array(part))] == [None if t is None else lib.encode(t) for t in part]
    assert m.encode_all(pa.array([], pa.string())) == []
    m.most_open = 0
    list(m.stream(iter("abcdefgh" * 5000)))
    assert m.most_open < 200  # the window doesn't grow with the text
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x y")], "doc_id long, text string")
    assert [r["n_ids"] for r in pieces.encode_report(df).orderBy("doc_id").collect()] == [2, 0, 0]


def proto(key, value):
    """A field of a model file."""
    if isinstance(value, float):
        return bytes([key << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, int):
        return bytes([key << 3, value])
    return bytes([key << 3 | 2, len(value)]) + value


def test_unigram_pieces():
    import sentencepiece

    scores = {"▁": -2.1, "a": -3.3, "b": -3.7, "ab": -4.9, "ba": -5.3, "▁ab": -4.2, "aba": -7.9, "c": -6.1, "bc": -8.3, "abc": -10.7}
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(t, x, 1) for t, x in scores.items()]]
    tail = proto(2, proto(3, 1)) + proto(3, proto(1, b"identity") + proto(3, 1) + proto(4, 0) + proto(5, 1))
    data = b"".join(proto(1, proto(1, t.encode()) + proto(2, x) + proto(3, k)) for t, x, k in rows) + tail
    lib, m = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Model(data)
    rng = np.random.default_rng(5)
    texts = ["日本", "日本 語x", "a 日", "", "  ab  y ", *["".join(rng.choice(list("ab c日"), int(rng.integers(1, 200)))) for _ in range(100)]]
    assert [m.encode(t).tolist() for t in texts] == [lib.encode(t) for t in texts]
    assert [x.tolist() for x in m.encode_all(pa.array(texts))] == [lib.encode(t) for t in texts]
    m.most_open = 0
    assert list(m._ids(m.stream((m.normal("ab c日" * 3000),)))) == lib.encode("ab c日" * 3000) and m.most_open < 20
    odd = data[: -len(tail)] + proto(1, proto(1, b"zz") + proto(2, 0.0) + proto(3, 4)) + tail
    with pytest.raises(ValueError, match="user-defined"):
        pieces.Model(odd)


def test_training_order_holds_whole_texts(spark, tmp_path):
    texts = [None, "", "one two", "x  y\n\n z's 12", *[t for _, t in corpus()[:12]]]
    rows = [(None if k % 5 == 0 else -1 if k % 5 == 1 else k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = str(tmp_path / "s")
    got = token_output.write_training_order(df, out=out, length=32, shard_slots=4, key=3).toPandas().sort_values("slot")
    with open(token_output.DEFAULT_RANKS, "rb") as f:
        enc = token_output._encoder(f.read())
    n = len(got)
    order = token_output.Permutation(n, 3)
    tokens = token_output.read_slots(out, 0, n)
    line = np.concatenate([tokens[int(order.slot(i)[0])] for i in range(n)]).tolist()
    want = [x for _, t in rows for x in [*enc.encode_ordinary(t or ""), token_output.END_OF_TEXT]]
    assert line[: len(want)] == want and set(line[len(want) :]) <= {token_output.END_OF_TEXT}
    assert got["n_tokens"].sum() == len(want)
    # the documents of each sequence, null ids as null
    owner = [i for i, t in rows for _ in [*enc.encode_ordinary(t or ""), 0]]
    start = [k for k, (_, t) in enumerate(rows) for _ in [*enc.encode_ordinary(t or ""), 0]]
    for i in range(n):
        part = list(dict.fromkeys(start[i * 32 : (i + 1) * 32]))
        docs = got[got["slot"] == int(order.slot(i)[0])]["doc_ids"].iloc[0]
        assert [None if x is None or x != x else int(x) for x in docs] == [rows[k][0] for k in part], (i, owner[:3])


def test_training_order_of_another_corpus_and_vocabulary(spark, tmp_path):
    out = str(tmp_path / "s")
    run = lambda word, **kw: [r["sha256"] for r in token_output.write_training_order(spark.createDataFrame([(k, f"{word} {k}") for k in range(300)], "doc_id long, text string").coalesce(1), out=out, length=16, shard_slots=8, **kw).orderBy("slot").collect()]
    first = run("hello world")
    second = run("goodbye moon")
    assert first != second
    tokens = token_output.read_slots(out, 0, len(second))
    assert [hashlib.sha256(x.tobytes()).hexdigest() for x in tokens] == second
    assert run("hello world") == first
    ranks = tmp_path / "bytes.tiktoken"
    ranks.write_bytes(b"".join(base64.b64encode(bytes([x])) + b" %d\n" % x for x in range(256)))
    run("hello", ranks_path=str(ranks))
    tokens = token_output.read_slots(out, 0, 1000)
    assert {int(x) for x in np.concatenate(tokens)} <= {*range(256), token_output.END_OF_TEXT}
    assert len([f for f in os.listdir(out) if f.endswith(".bin")]) == -(-len(tokens) // 8)  # none of the longer run's


def test_training_order(docs, tmp_path):
    for n in (1, 2, 7, 1000):
        p = token_output.Permutation(n, 9)
        assert sorted(p.slot(np.arange(n))) == list(range(n)) and (p.index(p.slot(np.arange(n))) == np.arange(n)).all()
    out = str(tmp_path / "shards")
    got = token_output.write_training_order(docs, out=out, length=64, shard_slots=16).toPandas()
    n = len(got)
    assert sorted(got["slot"]) == list(range(n))
    tokens = token_output.read_slots(out, 0, n)
    assert [hashlib.sha256(x.tobytes()).hexdigest() for x in tokens] == got.sort_values("slot")["sha256"].tolist()
    with open(token_output.DEFAULT_RANKS, "rb") as f:
        enc = token_output._encoder(f.read())
    assert Counter(np.concatenate(tokens).tolist())[enc.encode_ordinary(" w7")[0]] >= 1
    for t in ("a b", " a\n b ", "x  y   z", "it's 5 o'clock\n\n now"):
        assert token_output.encode_all(enc, pa.array([t, None, t]))[2].tolist() == enc.encode_ordinary(t)
    assert token_output.write_training_order(docs.limit(0), out=str(tmp_path / "none")).count() == 0


def test_quality(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality.quality_report(d).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert (out["keep"] == (out["quality"] == 1)).mean() > 0.95
    assert out[out["quality"] == 1]["keep"].mean() > 0.99
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "Plain words in a sentence."), (2, "")], "doc_id long, text string")
    assert quality.quality_report(odd).count() == 4 and quality.quality_report(odd.limit(0)).count() == 0


def plain_em(votes, rounds):
    """Expectation and maximisation, row by row in plain Python."""
    m = len(votes[0])
    p = [0.2 if 0 in v else 0.95 for v in votes]
    for _ in range(rounds):
        share = min(max(sum(p) / len(p), 1e-3), 1 - 1e-3)
        rate = {}
        for c in (0, 1):
            for j in range(m):
                w = [sum((x if c else 1 - x) for x, v in zip(p, votes, strict=True) if v[j] == k) + 0.5 for k in (0, 1)]
                rate[c, j] = [x / sum(w) for x in w]
        new = []
        for v in votes:
            like = [1 - share, share]
            for c in (0, 1):
                for j in range(m):
                    if v[j] >= 0:
                        like[c] *= rate[c, j][v[j]]
            new.append(like[1] / sum(like))
        if max(abs(a - b) for a, b in zip(p, new, strict=True)) < 1e-9:
            break
        p = new
    return p


def test_labellers_by_plain_em():
    rng = np.random.default_rng(6)
    truth = rng.random(400) < 0.7
    votes = np.where(rng.random((400, 4)) < np.array([0.9, 0.8, 0.7, 0.95]), truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((400, 4)) < 0.3] = -1
    pattern, count = np.unique(votes, axis=0, return_counts=True)
    rates, prior, post = quality.fit_labellers(pattern, count.astype(float), rounds=40)
    by = {tuple(v): x for v, x in zip(votes.tolist(), plain_em(votes.tolist(), 40), strict=True)}
    assert all(abs(x - by[tuple(v)]) < 1e-6 for v, x in zip(pattern.tolist(), post, strict=True))
    assert ((post > 0.5) == (np.array([truth[(votes == v).all(axis=1)].mean() for v in pattern]) > 0.5)).mean() > 0.7


def plain_scores(texts):
    """Scores of the quality classifier fitted on these texts, each text and weight by itself."""
    alone = [quality.Batch([(x or "").encode()]) for x in texts]
    target = plain_em([b.votes()[0].tolist() for b in alone], 100)
    shares = [{f: k / int(b.n[0]) for f, k in Counter(b.features()[1].tolist()).items()} for b in alone]
    n, w, grow, bias, grow_b = len(texts), Counter(), {}, 0.0, 1e-6
    good = lambda x: 1 / (1 + np.exp(-min(max(sum(w[f] * k for f, k in x.items()) + bias, -40), 40)))
    for _ in range(150):
        err = [(good(x) - y) / n for x, y in zip(shares, target, strict=True)]
        slope = {f: 1e-5 * k / n for f, k in w.items()}
        for x, e in zip(shares, err, strict=True):
            for f, k in x.items():
                slope[f] = slope.get(f, 0.0) + e * k
        for f, g in slope.items():
            grow[f] = grow.get(f, 1e-6) + g * g
            w[f] -= 2 * g / grow[f] ** 0.5
        grow_b += sum(err) ** 2
        bias -= 2 * sum(err) / grow_b**0.5
    return [good(x) if (t or "").encode().split() else 0.0 for x, t in zip(shares, texts, strict=True)]


def plain_groups(rows):
    """One row of each group that five-word shingles link at 0.8."""
    sets = []
    for _, t, _ in rows:
        w = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()).split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                part = [part[i] if x == part[j] else x for x in part]
    least = {}
    for k, (i, _, _) in enumerate(rows):
        rank = (i is None, i or 0, k)
        least[part[k]] = min(least.get(part[k], rank), rank)
    return [rows[k] for _, _, k in sorted(least.values())]


def plain_cuts(rows, length=50):
    """Texts without the characters that lie whole in strings of an earlier document; none that is left empty."""
    seen = {}
    for i, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        x = (t or "").encode()
        for p in range(len(x) - length + 1):
            seen.setdefault(x[p : p + length], i)
    out = []
    for i, t, source in rows:
        x = (t or "").encode()
        cover = [False] * len(x)
        for p in range(len(x) - length + 1 if i is not None else 0):
            if seen[x[p : p + length]] < i:
                cover[p : p + length] = [True] * length
        kept, at = "", 0
        for c in t or "":
            n = len(c.encode())
            kept += "" if all(cover[at : at + n]) else c
            at += n
        out += [(i, kept, source)] if kept else []
    return out


def plain_targets(sizes):
    """{source: target}: water filling, one source after the other."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if 2 * sizes[s] <= level * weight[s]]
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= set(over)
        if not over:
            return out | {s: level * weight[s] for s in free}
    return out


def test_pipeline_by_brute_force(spark, tmp_path):
    """run()'s rows from stages in plain Python. Which of the documents of a source the mixture takes once more than the
    others is chance; their whole parts and each source's words are not."""
    import sentencepiece

    import corpus_pipeline

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    given = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 6000")
    first = given.orderBy("doc_id").first()
    again = [tuple(first), tuple(first), (None, first["text"], "en", "s", 1), (None, "Some words of no other text, " * 3 + "and that is the end of it.", "en", None, 1), (10**17 + 1, None, "en", "s", None), (10**17 + 2, "", "en", "s", 0)]
    spark.createDataFrame([*map(tuple, given.collect()), *again], given.schema).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text", "source").collect()]
    scores = plain_scores([t for _, t, _ in rows])
    assert min(abs(x - 0.5) for x in scores) > 1e-4  # no row for rounding to decide
    kept = [r for r, x in zip(rows, scores, strict=True) if x >= 0.5]
    alone = plain_groups(kept)
    cut = plain_cuts(alone)
    assert len(rows) > len(kept) > len(alone) and sum(len(t) for _, t, _ in cut) < sum(len(t or "") for _, t, _ in alone)

    words = [len(t.encode().split()) for _, t, _ in cut]
    sizes = Counter()
    for (_, _, source), n in zip(cut, words, strict=True):
        sizes[source] += n
    targets = plain_targets(dict(sizes))
    ids = lambda t: (tuple(lib.encode(t)), hashlib.sha256(t.encode()).hexdigest())
    got = Counter((r["doc_id"], tuple(r["ids"]), r["n_ids"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    taken, most = Counter(), Counter()
    for (i, t, source), n in zip(cut, words, strict=True):
        x, digest = ids(t)
        copies, ratio = got.pop((i, x, len(x), digest), 0), targets[source] / sizes[source] if sizes[source] else 0
        assert int(ratio + 1e-9) <= copies <= int(np.ceil(ratio - 1e-9)), (i, copies, ratio)
        taken[source] += copies * n
        most[source] = max(most[source], n)
    assert not got  # no row but these
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= most[source] / 2 + 1e-6, source


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert corpus_pipeline.run(spark, SF).count() > 0
