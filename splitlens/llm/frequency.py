"""Document frequencies of shingles in a table of fixed size, counted over all documents.

Hashes fall into ``2 ** BITS`` cells. Tasks count their own documents, the counts are added
chunk by chunk in rounds of at most ``FAN_IN`` tables, and the sum is cut to one class byte a
cell: 0 for cells that look like chance, then four classes for each doubling. The table's size
does not depend on the data, so it may be broadcast. It only orders shingles: whatever it says,
the join that uses it finds the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .staging import staged

BITS = 24
CHUNK = 1 << 16
FAN_IN = 64


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _pack(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            for found in W.shingle_sets(batch.column(0), k):
                np.add.at(table, cells(found), 1)
        for c in range(len(table) // CHUNK):
            part = table[c * CHUNK:(c + 1) * CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pydict(
                    {"task": pa.array([TaskContext.get().partitionId()], pa.int64()), "chunk": pa.array([c], pa.int32()),
                     "n": pa.array([int(part.sum())], pa.int64()), "counts": pa.array([_pack(part)], pa.binary())})
    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.uint32)
    for data in pdf["counts"]:
        total += _unpack(data, np.uint32)
    first = pdf.iloc[0]
    return pd.DataFrame({"task": [first["task"] // FAN_IN], "chunk": [first["chunk"]],
                         "n": [pdf["n"].sum()], "counts": [_pack(total)]})


def classes(docs: DataFrame, text: str = "text", k: int = 5) -> bytes:
    """The packed class table of ``docs``; ``unpack`` gives it as an array of bytes."""
    schema = "task long, chunk int, n long, counts binary"
    table = staged(docs.select(text).mapInArrow(_count(k), schema), "df")
    top, total = table.agg(F.max("task"), F.sum("n")).first()
    while top:
        table = staged(table.groupBy("chunk", F.expr(f"task div {FAN_IN}")).applyInPandas(_add, schema), "df")
        top //= FAN_IN
    mean = (total or 0) / (1 << BITS)
    limit = mean + 6 * mean ** 0.5 + 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column("counts").to_pylist():
                n = _unpack(data, np.uint32)
                out.append(_pack(np.where(n > limit, np.minimum(255, 1 + 4 * np.log2(np.maximum(n, 1) / limit)), 0).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.binary())], names=["chunk", "classes"])

    out = np.zeros(1 << BITS, np.uint8)
    for r in table.select("chunk", "counts").mapInArrow(cut, "chunk int, classes binary").toLocalIterator():
        out[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = _unpack(r.classes, np.uint8)
    return _pack(out)


def unpack(data: bytes) -> np.ndarray:
    return _unpack(data, np.uint8)
