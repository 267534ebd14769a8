"""Quality classifier from weak labels: expectation-maximisation over overlapping heuristic labellers, whose posterior
labels train a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, mix, run_hashes, words_of

#: Most rows that the linear scorer is fitted on: those with the least hash of their ids. Votes of all rows are counted.
FIT_ROWS = 4000
DIMS = 1 << 15
#: Function words of the four languages (fixed values).
STOP = "the of and to in a is that it for on are as with de la le et les des un une est dans que y en los las el del der die das und ist von zu den mit".split()

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 stop, 5 symbol, 6 high byte
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_CLASS[128:] = 6

NAMES = ("case", "symbols", "repeats", "marks", "stops", "shape")


def _counted(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask)])
    return (c[ends] - c[starts]).astype(float)


class Batch:
    """Texts end to end, their words, and what labellers and the scorer see of each text."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens
        self.hash, self.w_start, self.w_end, first = words_of(self.data, self.starts, self.ends)
        self.first, self.last = first[:-1], first[1:]
        self.n = np.maximum(self.last - self.first, 1)
        self.cls = _CLASS[self.data]
        self.doc = np.repeat(np.arange(len(texts)), self.last - self.first)

    def votes(self) -> np.ndarray:
        """(texts, labellers): 1 good, 0 bad, -1 no opinion."""
        cls, s, e = self.cls, self.starts, self.ends
        lower, upper = _counted(cls == 1, s, e), _counted(cls == 2, s, e)
        symbol = _counted(cls == 5, s, e) / np.maximum(e - s, 1)
        again = np.zeros(len(self.hash), dtype=bool)
        again[1:] = (self.hash[1:] == self.hash[:-1]) & (self.doc[1:] == self.doc[:-1])
        repeats = _counted(again, self.first, self.last) / self.n
        tail = cls[self.w_end - 1] == 5 if len(self.w_end) else np.zeros(0, bool)
        marks = _counted(tail, self.first, self.last) / self.n
        stops = _counted(np.isin(self.hash, _STOP_HASHES), self.first, self.last) / self.n
        size = _counted(self.w_end - self.w_start, self.first, self.last) / self.n
        case = upper / np.maximum(upper + lower, 1)
        vote = lambda x, good, bad: np.where(x <= good, 1, np.where(x >= bad, 0, -1))
        out = np.stack(
            [
                vote(case, 0.15, 0.4), vote(symbol, 0.015, 0.05), vote(repeats, 0.03, 0.15), vote(marks, 0.05, 0.25),
                np.where(stops >= 0.08, 1, np.where(stops <= 0.01, 0, -1)), vote(np.abs(size - 6), 3, 8),
            ],
            axis=1,
        )
        few = self.last - self.first < 8
        out[few, 4:] = -1  # too little to go by
        out[self.last == self.first] = 0  # no words at all: every labeller says bad
        return out.astype(np.int8)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, hashed feature) pairs: words, shapes of their ends, repetition. Four to a word."""
        v = byte_values(self.cls)
        a, b = self.w_start, self.w_end
        head = run_hashes(v, a, np.minimum(a + 2, b))
        tail = run_hashes(v, np.maximum(b - 3, a), b)
        again = np.zeros(len(self.hash), dtype=np.uint64)
        again[1:] = (self.hash[1:] == self.hash[:-1]) & (self.doc[1:] == self.doc[:-1])
        kinds = (self.hash, mix(head + np.uint64(1)), mix(tail + np.uint64(2)), mix(again + np.uint64(3)))
        return np.tile(self.doc, 4), np.concatenate([(k % np.uint64(DIMS)).astype(np.int64) for k in kinds])

    def score(self, weights: np.ndarray, bias: float) -> np.ndarray:
        doc, f = self.features()
        total = np.bincount(doc, weights=weights[f], minlength=len(self.starts))
        return 1 / (1 + np.exp(-np.clip(total / self.n + bias, -40, 40)))


def _stop_hashes() -> np.ndarray:
    words = [w.encode() for w in STOP]
    ends = np.cumsum([len(w) for w in words])
    starts = ends - np.array([len(w) for w in words])
    return run_hashes(byte_values(np.frombuffer(b"".join(words), dtype=np.uint8)), starts, ends)


_STOP_HASHES = _stop_hashes()


def fit_labellers(votes: np.ndarray, count: np.ndarray, rounds: int = 100):
    """EM for labellers that are right with their own accuracies, given the true class: P(vote | class), class prior
    and the posterior of each vote pattern. votes: (patterns, labellers) of 1, 0, -1; count: rows of each pattern."""
    m = votes.shape[1]
    post = np.where((votes == 0).any(axis=1), 0.2, 0.95)  # to begin with, good unless some labeller objects
    for _ in range(rounds):
        prior = float((count * post).sum() / count.sum())
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        rates = np.zeros((2, m, 2))  # class, labeller, P(vote good or bad | it votes)
        log = np.stack([np.full(len(votes), np.log(1 - prior)), np.full(len(votes), np.log(prior))])
        for c, w in ((0, count * (1 - post)), (1, count * post)):
            for j in range(m):
                for v in (0, 1):
                    rates[c, j, v] = w[votes[:, j] == v].sum() + 0.5
                rates[c, j] /= rates[c, j].sum()
                given = votes[:, j] >= 0
                log[c, given] += np.log(rates[c, j, votes[given, j]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return rates, prior, post


def fit_scorer(rows: list[np.ndarray], shares: list[np.ndarray], target: np.ndarray, epochs: int = 150, rate: float = 2.0, decay: float = 1e-5):
    """Logistic regression on hashed features' shares, by full-batch steps with per-weight scaling."""
    n = max(1, len(rows))
    doc = np.repeat(np.arange(len(rows)), [len(f) for f in rows])
    f, x = np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0), *shares])
    w, bias = np.zeros(DIMS), 0.0
    grow, grow_b = np.full(DIMS, 1e-6), 1e-6
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights=w[f] * x, minlength=n)[: len(rows)] + bias, -40, 40)))
        err = (p - target) / n
        g = np.bincount(f, weights=err[doc] * x, minlength=DIMS) + decay * w / n
        grow += g * g
        grow_b += err.sum() ** 2
        w -= rate * g / np.sqrt(grow)
        bias -= rate * err.sum() / np.sqrt(grow_b)
    return w, bias


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [t or b"" for t in batch.column(name).to_pylist()]


def fit_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS):
    """(weights, bias, labeller rates). Votes of every row are counted by pattern (at most 3**6), EM runs on the
    counts, and the scorer is fitted on at most fit_rows rows. An empty table gives a scorer that keeps everything."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                v = Batch(_texts(part)).votes() + 1
                yield pa.RecordBatch.from_pydict({"pattern": (v * 3 ** np.arange(len(NAMES))).sum(axis=1).astype(np.int32)})

    text = F.col(f"`{text_col}`").cast("binary").alias("text")
    counts = df.select(text).mapInArrow(vote, "pattern int").groupBy("pattern").count().collect()  # at most 729 rows
    if not counts:
        return np.zeros(DIMS), 20.0, None
    pattern = np.array([r[0] for r in counts])
    votes = pattern[:, None] // 3 ** np.arange(len(NAMES)) % 3 - 1
    rates, _, post = fit_labellers(votes, np.array([r[1] for r in counts], dtype=float))
    posterior = dict(zip(pattern.tolist(), post.tolist(), strict=True))
    # the bounded fit set, by a hash of the row; each row's whole text, as at most DIMS features' shares
    text_of = F.col(f"`{text_col}`").cast("binary")
    hashed = df.select(F.xxhash64(F.col(f"`{id_col}`").cast("long"), text_of).alias("h"), text_of.alias("text"))
    upto = hashed.select("h").orderBy("h").limit(fit_rows).agg(F.max("h")).first()[0]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                b = Batch(_texts(part))
                doc, f = b.features()
                key, n = np.unique(doc * DIMS + f, return_counts=True)
                cut = np.searchsorted(key, np.arange(part.num_rows + 1) * DIMS)
                lists = [pa.array([x[cut[k] : cut[k + 1]] for k in range(part.num_rows)], t) for x, t in ((key % DIMS, pa.list_(pa.int32())), (n / b.n[key // DIMS], pa.list_(pa.float64())))]
                votes_ = b.votes() + 1
                yield pa.RecordBatch.from_arrays([pa.array((votes_ * 3 ** np.arange(len(NAMES))).sum(axis=1).astype(np.int32)), *lists], names=["pattern", "f", "x"])

    sample = hashed.filter(F.col("h") <= upto).select("text").mapInArrow(features, "pattern int, f array<int>, x array<double>").limit(fit_rows).toArrow()
    rows = [np.array(v, dtype=np.int64) for v in sample.column("f").to_pylist()]
    shares = [np.array(v, dtype=float) for v in sample.column("x").to_pylist()]
    w, bias = fit_scorer(rows, shares, np.array([posterior[p] for p in sample.column("pattern").to_pylist()]))
    return w, bias, rates


def score_quality(df: DataFrame, model, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """df with score_col (0 to 1, of the whole text), without a shuffle. Null text: as an empty one, 0. If df has a
    column of that name, it is replaced."""
    weights, bias, _ = model
    shared = df.sparkSession.sparkContext.broadcast((weights.astype(np.float32), float(bias)))  # DIMS numbers
    base = df.drop(score_col)
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*base.schema.fields, StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [t.encode() if isinstance(t, str) else t or b"" for t in part.column(text_col).to_pylist()]
                x = Batch(texts)
                s = x.score(w, b)
                s[x.last == x.first] = 0.0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], names=[*part.schema.names, score_col])

    return base.mapInArrow(run, schema)


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of df: doc_id, quality_score, keep (quality_score >= cut)."""
    model = fit_quality(df, id_col, text_col, fit_rows)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return score_quality(rows, model).select("doc_id", "quality_score", (F.col("quality_score") >= cut).alias("keep"))
