"""Token-id output in training order: a keyed Feistel permutation gives every sequence a slot; shards of fixed stride."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, expand, mix, pack_arrays, ranges, scratch_path, squeeze, stored, unpack_arrays

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting pattern of that vocabulary (a fixed value): contractions, letters, digits, others, blanks.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256
#: Words whose ids a task remembers.
REMEMBER = 450_000
#: Most partitions that write shards, unless there are more cores; each writes the shards of a range of slots.
MOST_RANGES = 50_000


class Permutation:
    """A keyed bijection of 0..n-1: four Feistel rounds on the next even number of bits, walked until below n."""

    def __init__(self, n: int, key: int):
        self.n = n
        bits = max(2, (max(n, 2) - 1).bit_length())
        self.half = np.uint64((bits + 1) // 2)
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & ((1 << 64) - 1)))

    def _round_trip(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (mix(left + k) & self.mask), left
            else:
                left, right = right, left ^ (mix(right + k) & self.mask)
        return (left << self.half) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        out = self._round_trip(np.atleast_1d(np.asarray(x, dtype=np.uint64)), back)
        while (far := out >= self.n).any():
            out[far] = self._round_trip(out[far], back)
        return out.astype(np.int64)

    def slot(self, index) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot) -> np.ndarray:
        return self._walk(slot, True)


@lru_cache(maxsize=1)
def _encoder(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_all(encoding, texts: pa.Array, memory: dict[str, bytes] | None = None) -> list[np.ndarray]:
    """encoding.encode_ordinary of each text, null as empty. memory: ids that this encoding gave words, as little-endian
    16-bit numbers; it fills up to REMEMBER words. Where single spaces stand between words, each word with its
    space is encoded by itself (no piece of the pattern goes over such a space): the distinct words of the texts are
    looked up once, and their ids dealt out to the places of the words."""
    texts = pc.fill_null(texts, "")
    split = pc.split_pattern(texts, " ")
    words = split.flatten().dictionary_encode()
    sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    units = words.dictionary.to_pylist()
    codes = words.indices.to_numpy().astype(np.int64)
    some = sizes > 0
    firsts = [units[c] for c in codes[upto[:-1][some]]]  # the only words without a space before them
    codes[upto[:-1][some]] = len(units) + np.arange(len(firsts))
    memory = {} if memory is None else memory
    get, slow, ids = memory.get, encoding.encode_ordinary, []
    for unit in [" " + u for u in units] + firsts:
        found = get(unit)
        if found is None:
            found = struct.pack(f"<{len(x := slow(unit))}H", *x)
            if len(memory) < REMEMBER and len(unit) <= 64:
                memory[unit] = found
        ids.append(found)
    lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
    flat = np.frombuffer(b"".join(ids), "<u2")
    n = lens[codes]
    ends = np.cumsum(n)
    out = flat[np.repeat((np.cumsum(lens) - lens)[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    at = np.concatenate([[0], ends])[upto]
    wide = pc.match_substring(texts, "  ").to_numpy(zero_copy_only=False)
    return [np.array(slow(texts[k].as_py()), dtype="<u2") if wide[k] else out[at[k] : at[k + 1]] for k in range(len(texts))]


def tokenised(df: DataFrame, id_col: str, text_col: str, length: int, ranks_path: str) -> DataFrame:
    """Stored: part, first (of the part's sequences), n, body: ids, token counts and tokens of the documents that begin
    in these sequences. The stream of a part is its documents, each closed by the end mark, padded at its very end."""
    with open(ranks_path, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, part, at = _encoder(data), TaskContext.get().partitionId(), 0
        memory: dict[str, bytes] = {}  # this task's, so another vocabulary's ids can't be in it
        tokens: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        names: list[int | None] = []  # ids of the documents that owners number
        held = 0

        def cut(last: bool) -> pa.RecordBatch | None:
            nonlocal tokens, owners, names, held, at
            if not held:
                return None
            t, o = np.concatenate(tokens), np.concatenate(owners)
            n = -(-held // length) if last else held // length
            use = min(held, n * length)
            tokens, owners = [t[use:]], [o[use:]]
            out = t[:use]
            lens = np.full(n, length, dtype="<i4")
            if n * length > use:
                lens[-1] -= n * length - use
                out = np.concatenate([out, np.full(n * length - use, END_OF_TEXT, dtype="<u2")])
            held -= use
            # which documents each sequence holds
            seq = np.arange(use) // length
            new = np.ones(use, dtype=bool)
            new[1:] = (o[1:use] != o[: use - 1]) | (seq[1:] != seq[:-1])
            who, per = o[:use][new], np.bincount(seq[new], minlength=n)
            ids = np.array([0 if x is None else x for x in names], dtype=np.int64)[who]
            known = np.array([x is not None for x in names], dtype=np.uint8)[who]
            gone = int(owners[0][0]) if len(owners[0]) else len(names)
            owners, names = [owners[0] - gone], names[gone:]
            row = {"part": [part], "first": [at], "n": [n], "body": [pack_arrays(lens, per.astype("<i4"), ids, known)], "tokens": [squeeze(out.astype("<u2").tobytes(), 9)]}
            at += n
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("body", pa.binary()), ("tokens", pa.binary())]))

        for batch in chain.from_iterable(map(chunks, batches)):
            for one, ids in zip(batch.column(0).to_pylist(), encode_all(encoding, batch.column(1), memory), strict=True):
                ids = np.append(ids, np.uint16(END_OF_TEXT))
                tokens.append(ids)
                # rows are told apart within a part even where ids repeat or are null
                owners.append(np.full(len(ids), len(names), dtype=np.int64))
                names.append(one)
                held += len(ids)
                if held >= 1 << 20:
                    out = cut(False)
                    if out:
                        yield out
        out = cut(True)
        if out:
            yield out

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return stored(rows.mapInArrow(run, "part int, first long, n long, body binary, tokens binary"), "tokens")


def open_store(uri: str):
    """(file system, path) of a folder in the shared store."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")


def write_training_order(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str | None = None, length: int = 1024, key: int = 20240229, shard_slots: int = 8192, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """Writes shards and returns one row per sequence, read back from them: slot, shard, offset (byte in the shard),
    n_tokens (the rest is padding), doc_ids (those with tokens in it, in order; null ids as null), sha256 of its bytes.

    Null text: an empty document. Repeated rows stay. Whole texts are tokenised once. A sequence is `length` tokens of
    the documents of a scan partition end to end, so the order is that of the key and of the table's files and splits:
    the same table read with other split sizes gives other sequences. Slot s is bytes (s % shard_slots) * 2 * length of
    shard s // shard_slots, little-endian uint16, so any slot can be read or resumed at by arithmetic alone.

    The shards of a range of slots are written in one partition, one shard in memory at a time. A shard that is there
    with the same bytes is kept, any other is replaced, and a name appears only when its file is whole. The manifest is
    taken away first, written last, and shards beyond its count are deleted, so it never vouches for another run's
    shards. Empty: no shard, a manifest of no sequences.
    """
    spark = df.sparkSession
    out = out or scratch_path(spark, "shards")
    packed = tokenised(df, id_col, text_col, length, ranks_path)
    totals = {r[0]: r[1] for r in packed.groupBy("part").agg(F.sum("n")).collect()}  # a row per scan partition
    offsets, n = {}, 0
    for part in sorted(totals):
        offsets[part], n = n, n + totals[part]
    order = Permutation(max(n, 1), key)
    stride = 2 * length
    n_shards = -(-n // shard_slots)
    n_ranges = min(n_shards, max(MOST_RANGES, spark.sparkContext.defaultParallelism)) or 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lens, per, ids, known = unpack_arrays(row["body"])
                raw = np.frombuffer(expand(row["tokens"]), dtype="<u2").reshape(-1, length)
                slot = order.slot(offsets[row["part"]] + row["first"] + np.arange(row["n"]))
                first = np.cumsum(per) - per
                by = np.argsort(slot)
                shard = (slot[by] // shard_slots).astype(np.int64)
                for pick in np.split(by, np.flatnonzero(np.diff(shard)) + 1):
                    s = int(slot[pick[0]] // shard_slots)
                    docs = ranges(first[pick], per[pick])
                    body = pack_arrays(slot[pick], lens[pick], per[pick], ids[docs], known[docs])
                    yield pa.RecordBatch.from_pydict({"range": pa.array([s * n_ranges // n_shards], pa.int32()), "shard": pa.array([s], pa.int32()), "body": [body], "tokens": [squeeze(raw[pick].tobytes())]})

    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        slots = min(shard_slots, n - shard * shard_slots)
        full = np.zeros((slots, length), dtype="<u2")
        rows = []
        for body, tokens in zip(table.column("body"), table.column("tokens"), strict=True):
            slot, lens, per, ids, known = unpack_arrays(body.as_py())
            at = slot - shard * shard_slots
            full[at] = np.frombuffer(expand(tokens.as_py()), dtype="<u2").reshape(-1, length)
            first = np.cumsum(per) - per
            names = [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)]
            rows += [(int(a), int(n), names[f : f + k]) for a, n, f, k in zip(at, lens, first, per, strict=True)]
        fs, folder = open_store(out)
        fs.create_dir(folder, recursive=True)
        name, want = f"{folder}/{shard_name(shard)}", full.tobytes()

        def there() -> bytes:
            if fs.get_file_info(name).size != len(want):
                return b""
            with fs.open_input_file(name) as f:
                return f.read()

        data = there()
        if data != want:
            part = f"{name}.{TaskContext.get().taskAttemptId()}.part"
            with fs.open_output_stream(part) as f:
                f.write(want)
            fs.move(part, name)
            data = there()
        rows.sort(key=lambda r: r[0])
        return pa.table(
            {
                "slot": pa.array([shard * shard_slots + a for a, _, _ in rows], pa.int64()),
                "shard": pa.array([shard] * len(rows), pa.int32()),
                "offset": pa.array([a * stride for a, _, _ in rows], pa.int64()),
                "n_tokens": pa.array([k for _, k, _ in rows], pa.int32()),
                "doc_ids": pa.array([d for _, _, d in rows], pa.list_(pa.int64())),
                "sha256": [hashlib.sha256(data[a * stride : (a + 1) * stride]).hexdigest() for a, _, _ in rows],
            }
        )

    fs, folder = open_store(out)
    fs.create_dir(folder, recursive=True)
    manifest = f"{folder}/manifest.json"
    if fs.get_file_info(manifest).type != pafs.FileType.NotFound:
        fs.delete_file(manifest)
    sent = packed.mapInArrow(spread, "range int, shard int, body binary, tokens binary").repartitionById(n_ranges, F.col("range"))
    schema = "slot long, shard int, offset long, n_tokens int, doc_ids array<long>, sha256 string"
    report = stored(sent.groupBy("range", "shard").applyInArrow(write, schema), "slots")
    discard(packed)
    for file in fs.get_file_info(pafs.FileSelector(folder)):
        if file.base_name.endswith(".bin") and file.base_name >= shard_name(n_shards):
            fs.delete_file(file.path)
    with fs.open_output_stream(manifest) as f:
        f.write(json.dumps({"sequences": n, "length": length, "stride": stride, "shard_slots": shard_slots, "key": key, "dtype": "<u2"}).encode())
    return report


def shard_name(shard: int) -> str:
    return f"shard-{shard:09d}.bin"


def read_slots(out: str, start: int, stop: int) -> np.ndarray:
    """Sequences of slots start..stop-1, by arithmetic from the manifest."""
    fs, folder = open_store(out)
    with fs.open_input_file(f"{folder}/manifest.json") as f:
        m = json.loads(f.read())
    rows = []
    for slot in range(start, min(stop, m["sequences"])):
        with fs.open_input_file(f"{folder}/{shard_name(slot // m['shard_slots'])}") as f:
            f.seek(slot % m["shard_slots"] * m["stride"])
            rows.append(np.frombuffer(f.read(m["stride"]), dtype=m["dtype"]))
    return np.array(rows).reshape(-1, m["length"])
