"""Quality rules: base counts of a text and its fertility under two public vocabularies.

A vocabulary trained on ordinary text splits ordinary text into few, varied pieces. Text far
from it (encoded blobs, mojibake, runs of one symbol, one phrase over and over) shows as few
characters per token, a large share of single-byte fallback tokens, or a low token entropy.
Each script has a band for these measures; a text outside its band is rejected. The first
vocabulary is mostly English: encoded blobs and clean text of other languages in Latin letters
lie at the same 1.1 to 1.3 characters per token. So Latin letters are told apart by a second
vocabulary made for many languages, and languages whose texts were measured have bands of their
own. The rule looks at one row at a time: no shuffle, nothing is collected.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .staging import tokenizer_path, unused

VOCABULARY = "piece_bpe_32k.model"
SECOND = "byte_bpe_multi_50k.tiktoken"
_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Accepted measures: characters per token, byte-fallback share, and token entropy as a
    share of the largest one that so many tokens can have (512 different ones at most); and
    characters per token of the second vocabulary."""

    min_chars: float
    max_chars: float
    max_fallback: float
    min_entropy: float = 0.40
    min_second: float = 0.0


#: Per script. Alphabets share long pieces; ideographs and syllabaries have about a character
#: a token and, with rarer signs, fall back to bytes more often.
BANDS = {
    "latin": Band(1.0, 9.0, 0.50, min_second=1.5),
    "cyrillic": Band(1.0, 9.0, 0.15),
    "greek": Band(0.7, 9.0, 0.30),
    "semitic": Band(0.6, 9.0, 0.40),
    "cjk": Band(0.35, 4.0, 0.75),
    "hangul": Band(0.35, 4.0, 0.80),
    "other": Band(0.25, 9.0, 1.00),
}
#: Per script and language, where ``docs`` tell the language; other languages take their
#: script's band. The second vocabulary's bound is just below the lowest text of 10 words or
#: more in all documents of sf0.1 (en 1.62, de 1.61, es 1.54; fr 1.51 but for one text). Base64,
#: base32, base85 and hex blobs lie at 1.10 to 1.46, random letters at 1.40 to 1.59.
LANGUAGES = {
    ("latin", "en"): Band(1.2, 9.0, 0.15, min_second=1.6),
    ("latin", "de"): Band(1.2, 9.0, 0.15, min_second=1.6),
    ("latin", "es"): Band(1.2, 9.0, 0.15, min_second=1.53),
    ("latin", "fr"): Band(1.2, 9.0, 0.15, min_second=1.5),
}
_SCRIPTS = list(BANDS)
#: Script of each UTF-8 lead byte, -1 for bytes that tell nothing (digits, signs, followers).
_LEAD = np.full(256, -1)
for _script, _spans in {"latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC9)], "greek": [(0xCE, 0xCF)],
                        "cyrillic": [(0xD0, 0xD3)], "semitic": [(0xD6, 0xDB)],
                        "other": [(0xCA, 0xCD), (0xD4, 0xD5), (0xDC, 0xDF), (0xE0, 0xE2), (0xEE, 0xF4)],
                        "cjk": [(0xE3, 0xE9)], "hangul": [(0xEA, 0xED)]}.items():
    for _a, _b in _spans:
        _LEAD[_a:_b + 1] = _SCRIPTS.index(_script)


def script_of(data: np.ndarray) -> str:
    """The script of most letters of a text's UTF-8 bytes; ``other`` without letters."""
    lead = _LEAD[data]
    votes = np.bincount(lead[lead >= 0], minlength=len(_SCRIPTS))
    return _SCRIPTS[int(votes.argmax())] if votes.any() else "other"


def repeated_words(ids: np.ndarray, k: int = 5) -> int:
    """Words that lie in a ``k``-word window found twice or more."""
    if len(ids) <= k:
        return 0
    grams = W.shingle_hashes(W.mix(ids.astype(np.uint64) + W.GOLDEN), k)
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:len(again)] += again
    edge[k:k + len(again)] -= again
    return int((np.cumsum(edge) > 0).sum())


def _entropy(tokens: np.ndarray) -> tuple[float, float]:
    """Bits per token, and their share of what so many tokens could have."""
    n = len(tokens)
    if n < 2:
        return 0.0, 1.0
    p = np.unique(tokens, return_counts=True)[1] / n
    bits = float(-(p * np.log2(p)).sum())
    return bits, bits / float(np.log2(min(n, 512)))


_SCHEMA = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                     ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("script", pa.string()),
                     ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()),
                     ("fallback_share", pa.float64()), ("token_entropy", pa.float64()),
                     ("entropy_share", pa.float64()), ("second_chars_per_token", pa.float64())])
_models: dict = {}


def _model(path: str):
    """The vocabulary, read once per Python worker, and which of its ids are single bytes."""
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        _models[path] = sp, np.array([sp.is_byte(i) or sp.is_unknown(i) for i in range(sp.vocab_size())])
    return _models[path]


def _second(path: str):
    """The second vocabulary, read once per Python worker."""
    if path not in _models:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _models[path] = tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _models[path]


def _measures(column: pa.Array, path: str, second: str) -> dict[str, list]:
    sp, is_byte = _model(path)
    count = _second(second).encode_ordinary
    out: dict[str, list] = {name: [] for name in _SCHEMA.names}
    data, offs = W.text_bytes(column)
    for lo, hi in W.chunks(offs):
        known: dict[bytes, int] = {}
        texts = [data[offs[i]:offs[i + 1]] for i in range(lo, hi)]
        raw = [t.tobytes() for t in texts]
        ids = [np.array([known.setdefault(w, len(known)) for w in r.split()], np.int64) for r in raw]
        words = [w.decode("utf-8", "replace") for w in known]
        pieces = sp.encode(words) if known else []
        others = np.array([len(count(" " + w)) for w in words], np.int64)
        lens = np.array([len(p) for p in pieces], np.int64)
        flat = np.fromiter((t for p in pieces for t in p), np.int64, int(lens.sum()))
        begin = np.cumsum(lens) - lens
        for t, r, w in zip(texts, raw, ids):
            n = lens[w]
            total = int(n.sum())
            ends = np.cumsum(n)
            tokens = flat[np.repeat(begin[w] - ends + n, n) + np.arange(total)]
            lines = [x for x in r.split(b"\n") if x.strip()]
            chars = int(((t & 0xC0) != 0x80).sum()) - int(W.SPACE[t].sum())
            bits, share = _entropy(tokens)
            row = (len(w), chars, len(r) - len(r.translate(None, _SYMBOLS)), len(lines) - len(set(lines)),
                   repeated_words(w), script_of(t), total, chars / total if total else 0.0,
                   float(is_byte[tokens].mean()) if total else 0.0, bits, share,
                   chars / int(others[w].sum()) if total else 0.0)
            for name, value in zip(out, row):
                out[name].append(value)
    return out


def measure(docs: DataFrame, text: str = "text", vocabulary: str | None = None, into: str = "quality") -> DataFrame:
    """``docs`` with one struct column ``into`` of the base counts and token measures.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text counts as one without words: all
    counts 0. Repeated rows are measured each; other columns pass through as they are, so a
    column of ``docs`` named like a measure does not clash. The whole text is measured
    whatever its length. A column of ``docs`` named ``into`` is replaced.
    """
    docs = docs.drop(into)
    path, second = vocabulary or tokenizer_path(VOCABULARY), tokenizer_path(SECOND)
    names = docs.columns
    kinds = {"int64": "long", "string": "string", "double": "double"}
    quality = "struct<" + ", ".join(f"{f.name}: {kinds[str(f.type)]}" for f in _SCHEMA) + ">"
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _measures(batch.column(at), path, second)
            cols = [pa.array(found[f.name], f.type) for f in _SCHEMA]
            struct = pa.StructArray.from_arrays(cols, fields=list(_SCHEMA))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*names, into])

    return docs.mapInArrow(run, f"{fields}, `{into}` {quality}")


def verdict(quality: str = "quality", bands: dict[str, Band] | None = None, lang=None):
    """``(base_failed, in_band)`` as columns over the struct that ``measure`` adds. ``lang``: the
    column of the language; without it, or with own ``bands``, scripts alone decide."""
    q = F.col(quality)
    base = (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])

    def within(b: Band):
        return (q["chars_per_token"].between(b.min_chars, b.max_chars) & (q["fallback_share"] <= b.max_fallback)
                & (q["entropy_share"] >= b.min_entropy) & (q["second_chars_per_token"] >= b.min_second))

    inside = F.lit(False)
    for script, b in (bands or BANDS).items():
        own = within(b)
        for (of, language), band in LANGUAGES.items() if bands is None and lang is not None else ():
            if of == script:
                own = F.when(lang.eqNullSafe(F.lit(language)), within(band)).otherwise(own)
        inside = inside | ((q["script"] == script) & own)
    return base, inside


def _language(docs: DataFrame):
    return F.col("lang") if "lang" in docs.columns else None


def apply_rules(docs: DataFrame, text: str = "text", vocabulary: str | None = None,
                bands: dict[str, Band] | None = None) -> DataFrame:
    """``docs`` with ``quality``, ``base_failed``, ``in_band`` and ``kept``; no row is dropped. A
    column ``lang`` is read if there is one."""
    base, inside = verdict("quality", bands, _language(docs))
    return (measure(docs, text, vocabulary).withColumn("base_failed", base)
            .withColumn("in_band", inside).withColumn("kept", ~F.col("base_failed") & F.col("in_band")))


def keep_good(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs`` alone."""
    into, = unused(docs, "_quality")
    base, inside = verdict(into, lang=_language(docs))
    return measure(docs, text, vocabulary, into).where(~base & inside).drop(into)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """The base counts of one text by plain string work, as a check for tests."""
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows: dict[tuple, list[int]] = {}
    for i in range(len(found) - 4):
        windows.setdefault(tuple(found[i:i + 5]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))
