"""Documents packed for numpy work: about 1 MB of texts a row, compressed, with ids, lengths and other columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import expand, pack_arrays, squeeze, stored, unpack_arrays

SCHEMA = "chunk_id long, n_docs long, n_bytes long, head binary, data binary, extra binary"
#: Bytes of text in a packet; a longer text has a packet of its own.
TARGET = 1 << 20


class Packet:
    """ids (int64), known (False where the id was null), the texts' bytes end to end, and where each starts and ends."""

    def __init__(self, head: bytes, data: bytes, extra: bytes | None = None):
        self.ids, lens, known = unpack_arrays(head)
        self.known = known.astype(bool)
        self.data = np.frombuffer(expand(data), dtype=np.uint8) if data else np.zeros(0, np.uint8)
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens
        self._extra = extra

    def extra(self) -> pa.Table:
        return pa.ipc.open_stream(expand(self._extra)).read_all()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, serial = TaskContext.get().partitionId(), 0
    ids: list = []
    texts: list[bytes] = []
    rest: list[pa.RecordBatch] = []
    size = 0

    def row() -> pa.RecordBatch:
        nonlocal ids, texts, rest, size, serial
        known = np.array([x is not None for x in ids], dtype=np.uint8)
        head = pack_arrays(np.array([0 if x is None else x for x in ids], dtype=np.int64), np.array([len(x) for x in texts], dtype=np.int64), known)
        sink = pa.BufferOutputStream()
        extra = b""
        if rest and rest[0].num_columns:
            with pa.ipc.new_stream(sink, rest[0].schema) as w:
                for b in rest:
                    w.write_batch(b)
            extra = squeeze(sink.getvalue().to_pybytes())
        out = pa.RecordBatch.from_pydict(
            {"chunk_id": [(part << 32) | serial], "n_docs": [len(ids)], "n_bytes": [size], "head": [head], "data": [squeeze(b"".join(texts), 5)], "extra": [extra]}
        )
        ids, texts, rest, size, serial = [], [], [], 0, serial + 1
        return out

    for batch in batches:
        others = batch.select([n for n in batch.schema.names if n not in ("__id", "__text")])
        begun = 0
        for i, (one, text) in enumerate(zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist(), strict=True)):
            text = text or b""
            if ids and size + len(text) > TARGET:
                if i > begun:
                    rest.append(others.slice(begun, i - begun))
                begun = i
                yield row()
            ids.append(one)
            texts.append(text)
            size += len(text)
        if begun < batch.num_rows:
            rest.append(others.slice(begun))
    if ids:
        yield row()


def packed(df: DataFrame, id_col: str, text_col: str, keep: list[str] = ()) -> DataFrame:
    """A stored table of packets. keep: other columns of df to carry along, as they are."""
    cols = [F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("binary").alias("__text")]
    return stored(df.select(*cols, *[F.col(f"`{c}`") for c in keep]).mapInArrow(_pack, SCHEMA), "packets")
