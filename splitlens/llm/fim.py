"""Fill-in-middle transformation over seekable compressed frames.

1. *Store.* A text becomes independent zstandard frames of at most ``frame_bytes``, cut at unit
   ends where one is near enough, with the cumulative units, code points and bytes up to each
   frame's end. Units are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``: a word
   with the white space before it, or white space at the text's end.
2. *Selection.* The two cuts and the form come from a digest of the row's id. The cumulative
   units name the frames that hold the cuts; those alone are decompressed.
3. *Output.* A text in prefix-suffix-middle or suffix-prefix-middle order is again a list of
   frames: frames that no cut touches are taken over as they are, pieces of cut frames are
   compressed anew, with the markers before them.
4. *Digests* stream the ordered frames, one in memory at a time. ``restored`` finds the markers
   in the streamed output and brings the parts back into text order.

Every step works on one row at a time: no shuffle, and a lost executor repeats its rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .staging import staged

FRAME_BYTES = 1 << 16
LEVEL = 3
SEED = 42
#: Shares, in per cent, of texts that are changed and, among those, of suffix-prefix-middle.
FIM_RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
STORE = "doc_id long, data array<binary>, units array<long>, chars array<long>, bytes array<long>, marked boolean"
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>"


def _points(data: np.ndarray) -> int:
    """Code points that start in these UTF-8 bytes."""
    return int(((data & 0xC0) != 0x80).sum())


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Byte positions at which the units of a text end."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = W.SPACE[data]
    last = ~space
    last[:-1] &= space[1:]
    last[-1] = True  # the last word's end, or that of the white space after it
    return np.flatnonzero(last) + 1


def frames(data: np.ndarray, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> dict[str, list]:
    """A text's frames with the cumulative counts up to each one's end; none for an empty text.

    A unit longer than a frame is cut between code points; it counts where it ends."""
    pack = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
    ends = unit_ends(data)
    out: dict[str, list] = {"data": [], "units": [], "chars": [], "bytes": []}
    at = chars = 0
    while at < len(data):
        stop = min(len(data), at + frame_bytes)
        if stop < len(data):
            k = int(np.searchsorted(ends, stop, side="right"))
            if k and ends[k - 1] > at:
                stop = int(ends[k - 1])
            else:
                while stop > at + 1 and data[stop] & 0xC0 == 0x80:
                    stop -= 1
                while stop < len(data) and data[stop] & 0xC0 == 0x80:
                    stop += 1  # a frame is smaller than one code point
        part = data[at:stop]
        chars += _points(part)
        out["data"].append(pack(part.tobytes()))
        out["units"].append(int(np.searchsorted(ends, stop, side="right")))
        out["chars"].append(chars)
        out["bytes"].append(stop)
        at = stop
    return out


def unpack(frame: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(frame)


def place(text: dict, unit: int) -> tuple[int, int, int, bytes]:
    """Where the first ``unit`` units end: frame, byte in that frame, code points before it, and
    the frame's bytes. Only that frame is decompressed; before the first unit none is."""
    if unit == 0:
        return 0, 0, 0, b""
    f = bisect_left(text["units"], unit)
    before = text["units"][f - 1] if f else 0
    raw = unpack(text["data"][f])
    data = np.frombuffer(raw, np.uint8)
    byte = int(unit_ends(data)[unit - before - 1])
    return f, byte, (text["chars"][f - 1] if f else 0) + _points(data[:byte]), raw


def cuts(doc_id: int | None, n: int, seed: int = SEED) -> tuple[int, int, int, int]:
    """Units before the first and the second cut, and the two draws that give the form."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return first, second, h3 % 100, h4 % 100


def _piece(text: dict, a: tuple, b: tuple) -> list:
    """The text from place ``a`` to place ``b``: whole frames by number, cut ones as bytes."""
    (f, i, _, head), (g, j, _, tail) = a, b
    if f == g:
        return [(tail or head)[i:j]]
    head = head or (unpack(text["data"][f]) if i else b"")
    first = [head[i:]] if i else [f]
    return [*first, *range(f + 1, g), tail[:j]]


def transform(text: dict, doc_id: int | None, seed: int = SEED) -> dict:
    """n, form, prefix_chars, middle_chars and the output's frames of a stored text."""
    n = text["units"][-1] if text["units"] else 0
    first, second, fim, spm = cuts(doc_id, n, seed)
    plain = {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text["data"]}
    if not text["data"] or text["marked"] or fim >= FIM_RATE:
        return plain
    start = (0, 0, 0, b"")
    end = (len(text["data"]), 0, text["chars"][-1], b"")
    a, b = place(text, first), place(text, second)
    prefix, middle, suffix = _piece(text, start, a), _piece(text, a, b), _piece(text, b, end)
    form = "spm" if spm < SPM_RATE else "psm"
    order = [SUFFIX, *suffix, PREFIX, *prefix, MIDDLE, *middle] if form == "spm" else [PREFIX, *prefix, SUFFIX, *suffix, MIDDLE, *middle]
    pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
    output, held = [], []
    for part in [*order, None]:
        if isinstance(part, bytes):
            held.append(part)
            continue
        if any(held):
            output.append(pack(b"".join(held)))
        held = []
        if part is not None:
            output.append(text["data"][part])
    return {"n": n, "form": form, "prefix_chars": a[2], "middle_chars": b[2] - a[2], "output": output}


def restored(output: list[bytes], form: str) -> Iterator[bytes]:
    """The text, in order, from an output's frames and its form alone."""
    if form == "plain":
        yield from map(unpack, output)
        return
    ends, found, carry, at = [], {}, b"", 0
    for frame in output:  # markers may reach from one frame into the next
        raw = unpack(frame)
        seen = carry + raw
        for mark in (PREFIX, SUFFIX, MIDDLE):
            if mark not in found and (k := seen.find(mark)) >= 0:
                found[mark] = at - len(carry) + k
        at += len(raw)
        ends.append(at)
        carry = seen[-2:]
    stops = dict(zip(sorted(found.values()), [*sorted(found.values())[1:], at]))
    for mark in (PREFIX, MIDDLE, SUFFIX):
        lo, hi = found[mark] + len(mark), stops[found[mark]]
        for f in range(bisect_right(ends, lo), len(output)):
            begin = ends[f - 1] if f else 0
            if begin >= hi:
                break
            yield unpack(output[f])[max(0, lo - begin):hi - begin]


def digest(parts: Iterable[bytes]) -> str:
    h = sha256()
    for part in parts:
        h.update(part)
    return h.hexdigest()


def store(docs: DataFrame, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> DataFrame:
    """doc_id and text of ``docs`` as frames: ``STORE``, a row for each row.

    Texts are stored whole, null as empty (no frames). ``marked`` tells that a marker occurs in
    the text. Repeated rows and null ids stay; other columns are not read; an empty table gives
    no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 3]
        for batch in batches:
            data, offs = W.text_bytes(batch.column("text"))
            for lo, hi in W.chunks(offs):
                texts = [data[offs[i]:offs[i + 1]] for i in range(lo, hi)]
                found = [frames(t, frame_bytes, level) for t in texts]
                raw = [t.tobytes() for t in texts]
                marked = [any(m in r for m in (PREFIX, SUFFIX, MIDDLE)) for r in raw]
                cols = [pa.array([x[c] for x in found], kind) for c, kind in zip(("data", "units", "chars", "bytes"), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *cols, pa.array(marked, pa.bool_())],
                                                 names=["doc_id", "data", "units", "chars", "bytes", "marked"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORE)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of short slices, so that one batch's texts are not all held as objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            yield from batch.slice(lo, 64).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, limit: int = W.CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(map(len, row.get("output", ())))
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_COUNTS = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]


def fill_in_middle(stored: DataFrame, seed: int = SEED) -> DataFrame:
    """``OUTPUT`` for every row of ``store``: the form, the parts' code points (null if plain) and
    the output as frames. A null id draws as an empty one."""
    schema = pa.schema([*_COUNTS, ("output", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(({"doc_id": r["doc_id"], **transform(r, r["doc_id"], seed)} for r in _rows(batches)), schema)

    return stored.mapInArrow(run, OUTPUT)


def texts(outputs: DataFrame) -> DataFrame:
    """doc_id, form and the output's text of every row of ``fill_in_middle``."""
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            text = b"".join(map(unpack, r["output"])).decode()
            yield pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "form": r["form"], "text": text}], schema)

    return outputs.select("doc_id", "form", "output").mapInArrow(run, "doc_id long, form string, text string")


def units_between(stored: DataFrame, first: int, last: int) -> DataFrame:
    """doc_id and the text of units ``first`` to ``last - 1`` of every stored text, as far as it
    has them: the frames that hold the ends and those between are decompressed, no others."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            n = r["units"][-1] if r["units"] else 0
            a, b = place(r, min(first, n)), place(r, min(max(first, last), n))
            parts = _piece(r, a, b) if r["data"] else []
            text = b"".join(p if isinstance(p, bytes) else unpack(r["data"][p]) for p in parts).decode()
            yield pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "text": text}], schema)

    return stored.mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Every document's form and counts, and the digests of its output and of the text restored
    from that; ``n_frames`` and ``stored_bytes`` tell its size in the store, which is a stage
    table."""
    kept = staged(store(docs), "frames")
    schema = pa.schema([*_COUNTS, ("output_sha256", pa.string()), ("restored_sha256", pa.string()), ("n_frames", pa.int64()), ("stored_bytes", pa.int64())])

    def row(r: dict) -> dict:
        out = transform(r, r["doc_id"], seed)
        return {"doc_id": r["doc_id"], **out, "output": (), "output_sha256": digest(map(unpack, out["output"])),
                "restored_sha256": digest(restored(out["output"], out["form"])),
                "n_frames": len(r["data"]), "stored_bytes": sum(map(len, r["data"]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(map(row, _rows(batches)), schema)

    return kept.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
                                "restored_sha256 string, n_frames long, stored_bytes long")
