"""Shared helpers: scratch tables in the shared folder, numpy hashing of words and runs, compact encodings."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text whose words are looked up together; a longer text stands alone.
CHUNK = 4 << 20

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset and the master is local (tests), a temporary one is
    set. On a cluster it must be named, since executors don't share the driver's disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="casewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/casewright-scratch/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    release(spark)  # shuffle files of the jobs before, which this one may need the room of
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Deletes a table made by stored() that nothing reads any more."""
    entry = (df.sparkSession, df.scratch)
    if entry in _made:
        _made.remove(entry)
        _delete(*entry)


def release(spark: SparkSession) -> None:
    """Has the driver drop plans that nothing holds any more: Spark then deletes the shuffle files of finished jobs."""
    spark.sparkContext._jvm.System.gc()


def clear_scratch() -> None:
    """Deletes the scratch tables this process has made. Frames that read them can't be used afterwards."""
    while _made:
        try:
            _delete(*_made.pop())
        except Exception:  # noqa: BLE001  the session has gone; its files are the cluster's to expire
            return


atexit.register(clear_scratch)


def parts(spark: SparkSession, n_bytes: int, each: int = 16 << 20) -> int:
    """Number of buckets so that each holds what `each` bytes of text give; no fewer than thrice the cores."""
    return int(max(3 * spark.sparkContext.defaultParallelism, -(-n_bytes // each), 8))


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most CHUNK bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    begun = held = 0
    for k, size in enumerate(sizes):
        if held and held + size > CHUNK:
            yield batch.slice(begun, k - begun)
            begun, held = k, 0
        held += size
    if begun < batch.num_rows:
        yield batch.slice(begun)


def sql_words(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def give_back_memory() -> None:
    """Has this process return freed arrays to the system: workers live long, and share a machine with the JVM."""
    try:
        import ctypes

        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 18)  # arrays from 256 KB on are mapped, and unmapped when freed
        libc.mallopt(-1, 1 << 20)
        pa.set_memory_pool(pa.system_memory_pool())
    except (OSError, AttributeError):
        return  # another C library; it manages by itself


if TaskContext.get() is not None:  # in workers only; the driver's settings are its own
    give_back_memory()

# ---- numpy hashing ------------------------------------------------------------------------------

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_C = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= _C[0]
    x ^= x >> np.uint64(27)
    x *= _C[1]
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _pow(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(16, (n + 1).bit_length()))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[s:e] for many runs at once, from prefix sums of a polynomial. values: uint64."""
    n = len(values)
    acc = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _pow(_BASE, n)[:n], out=acc[1:])
    h = (acc[ends] - acc[starts]) * _pow(_INV, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _C[2])


def block_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """As run_hashes, of bytes or 64-bit values, for runs in ascending order: wide numbers exist for a block at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + block)))
        lo, hi = int(starts[i]), int(ends[i:j].max())
        part = values[lo:hi]
        out[i:j] = run_hashes(byte_values(part) if part.dtype == np.uint8 else part, starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray, lower: bool = False):
    """(word hashes, word starts, word ends, first word of each document and the end) of concatenated documents."""
    if lower:
        data = _LOWER[data]
    solid = ~_BLANK[data]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    full = doc_starts[doc_starts < doc_ends]
    before[full] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    after[full[full > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    first = np.searchsorted(starts, np.append(doc_starts, doc_ends[-1:]))
    return run_hashes(byte_values(data), starts, ends), starts, ends, first


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[p:p+k] for each p; len(values)-k+1 of them."""
    n = max(0, len(values) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= _C[3]
        out += values[j : j + n]
    return mix(out)


def byte_gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings, 8 <= k <= 16, by two overlapping 8-byte loads."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    view = loads(data)
    return mix(view[:n] * _C[2] + mix(view[k - 8 : k - 8 + n] ^ _C[3]))


def loads(data: np.ndarray) -> np.ndarray:
    """Little-endian 8-byte loads at every position of data; 8 zero bytes follow its end."""
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(data) + 8,), strides=(1,))


# ---- compact encodings --------------------------------------------------------------------------


def squeeze(x: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(x)


def expand(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x, max_output_size=1 << 31)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers below 2**48, as differences."""
    d = np.diff(values, prepend=np.uint64(0))
    low, high = (d & np.uint64(0xFFFFFFFF)).astype("<u4"), (d >> np.uint64(32)).astype("<u2")
    return len(values).to_bytes(8, "little") + low.tobytes() + squeeze(high.tobytes())


def unpack_sorted(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    low = np.frombuffer(x, "<u4", n, 8).astype(np.uint64)
    high = np.frombuffer(expand(x[8 + 4 * n :]), "<u2").astype(np.uint64)
    return np.cumsum(low | (high << np.uint64(32)), dtype=np.uint64)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Several arrays as one compressed block."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(4, "little") + head + squeeze(b"".join(a.tobytes() for a in arrays))


def unpack_arrays(x: bytes) -> list[np.ndarray]:
    n = int.from_bytes(x[:4], "little")
    data, at, out = expand(x[4 + n :]), 0, []
    for kind, size in (p.split(",") for p in x[4 : 4 + n].decode().split(";")):
        out.append(np.frombuffer(data, kind, int(size), at))
        at += out[-1].nbytes
    return out


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ..., for each run in turn."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
    return np.arange(total, dtype=np.int64) + shift
