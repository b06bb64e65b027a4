"""Word and shingle hashes of Arrow text columns, computed with numpy over byte chunks.

All separators used by the operators are ASCII bytes, so words are found on the UTF-8 bytes
without decoding. Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
#: The same where every byte takes several 8-byte numbers of working memory.
HASH_BYTES = 1 << 18
#: ``[^\x20\x09-\x0D]+``
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: after lower-casing, letters, digits and all non-ASCII
ASCII_OTHER = np.zeros(256, bool)
ASCII_OTHER[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` odd pseudorandom 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed)) | np.uint64(1)


_BYTE = stream(256, 11)
_POS = stream(4096, 23)
_SHINGLE = stream(64, 37)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts back to back, and their n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges whose texts together have about ``limit`` bytes, one row at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_starts(data: np.ndarray, offs: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """Byte positions where words start; a text's start ends the word before it."""
    if not len(data):
        return np.zeros(0, np.int64)
    word = ~separator[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = offs[:-1][offs[:-1] < len(data)]
    start[first] = word[first]
    return np.flatnonzero(start)


def word_codes(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SPACE,
               lower: bool = False, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words in order, per text the n+1 offsets into them, and the distinct words
    that the codes name (compared by their bytes, so no two words share a code). ``kinds`` cuts
    words further, where the kinds of two bytes (0: not cut) differ, and between two of kind 1."""
    word = ~separator[data]
    starts = word_starts(data, offs, separator)
    if kinds is not None and len(data):
        k = kinds[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (k[1:] > 0) & (k[:-1] > 0) & ((k[1:] != k[:-1]) | (k[1:] == 1))
        cut[starts] = True
        starts = np.flatnonzero(cut)
    own = data[word]
    own = LOWER[own] if lower else own
    before = np.cumsum(word, dtype=np.int64)
    at = np.append(before[starts] - 1, len(own)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(own)).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), np.searchsorted(starts, offs), found.dictionary


def word_hashes(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SPACE,
                lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and per text the n+1 offsets into the words."""
    data = LOWER[data] if lower else data
    s = word_starts(data, offs, separator)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    table = np.where(separator, np.uint64(0), _BYTE)
    gap = np.diff(np.append(s, len(data)))
    at = np.arange(s[0], len(data), dtype=np.int64) - np.repeat(s, gap)
    longest = int(gap.max())
    place = _POS if longest <= len(_POS) else stream(longest, 23)
    with np.errstate(over="ignore"):
        h = mix(np.add.reduceat(table[data[s[0]:]] * place[at], s - s[0]))
    return h, np.searchsorted(s, offs)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of the ``k`` words from each word on; the last ``k - 1`` values are left out."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += words[j:j + n] * _SHINGLE[j]
        return mix(out)


def short_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole sequence that is shorter than a shingle; other lengths differ."""
    with np.errstate(over="ignore"):
        return mix(np.array([(words * _SHINGLE[:len(words)]).sum(dtype=np.uint64) + _SHINGLE[32 + len(words)]], np.uint64))[0]


def shingle_sets(column: pa.Array, k: int = 5, lower: bool = True):
    """Yield per text the sorted distinct hashes of its ``k``-word shingles.

    A text of 1 to ``k - 1`` words has one element, its whole sequence; an empty or null text
    has none.
    """
    data, offs = text_bytes(column)
    for lo, hi in chunks(offs, HASH_BYTES):
        part = data[offs[lo]:offs[hi]]
        words, at = word_hashes(part, offs[lo:hi + 1] - offs[lo], SPACE, lower)
        grams = shingle_hashes(words, k)
        for i in range(hi - lo):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= k:
                yield np.unique(grams[a:b - k + 1])
            elif b > a:
                yield np.array([short_hash(words[a:b])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
