"""Fill-in-middle over frames against plain string work."""

import re
from hashlib import sha256

import numpy as np
import pytest

from splitlens.llm import fim
from splitlens.llm.staging import prepare

from . import tables

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """n, form, prefix_chars, middle_chars and the output, as the contract words it."""
    units = UNIT.findall(text)
    h = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [t for t in tables.TEXTS if t] + [
    "trailing \n", " é你\U0001f600 " * 40, "x" * 500, "\U0001f600" * 50, "a < <P <M", "tight<S>in word", "  lead", "\x0b\x0c\r mixed \x1f\x85 ends\t"]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000, fim.FRAME_BYTES])
def test_frames_cuts_and_restoring(size):
    forms = set()
    for text in TEXTS:
        raw = text.encode()
        if size < 64 and len(raw) > 5000:
            continue
        f = fim.frames(np.frombuffer(raw, np.uint8), size)
        parts = [fim.unpack(x) for x in f["data"]]
        assert b"".join(parts) == raw and all(p.decode() for p in parts)
        done = 0
        for k, p in enumerate(parts):  # cumulative counts of a text cut at the frame's end
            done += len(p)
            assert f["bytes"][k] == done and f["chars"][k] == len(raw[:done].decode())
            ends = [len(text[:m.end()].encode()) for m in UNIT.finditer(text)] if len(raw) < 5000 else None
            assert ends is None or f["units"][k] == sum(e <= done for e in ends)
        f["marked"] = any(m in text for m in ("<P>", "<S>", "<M>"))
        for doc_id in range(40):
            out = fim.transform(f, doc_id)
            whole = b"".join(map(fim.unpack, out["output"])).decode()
            assert (out["n"], out["form"], out["prefix_chars"], out["middle_chars"], whole) == plain(doc_id, text)
            assert b"".join(fim.restored(out["output"], out["form"])) == raw
            forms.add(out["form"])
    assert forms == {"plain", "psm", "spm"}


def test_only_cut_frames_are_read(monkeypatch):
    text = " ".join(f"word{i}" for i in range(5000))
    f = fim.frames(np.frombuffer(text.encode(), np.uint8), 512) | {"marked": False}
    asked, real = [], fim.unpack
    monkeypatch.setattr(fim, "unpack", lambda x: asked.append(x) or real(x))
    for doc_id in range(60):
        asked.clear()
        out = fim.transform(f, doc_id)
        if out["form"] != "plain":
            assert len(f["data"]) > 50 and len(asked) <= 2
            assert len(set(f["data"]) & set(out["output"])) >= len(f["data"]) - 2


def test_tables(spark):
    prepare(spark)
    df = tables.awkward(spark).unionByName(spark.createDataFrame([(90 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"), allowMissingColumns=True)
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in fim.digests(df).collect())
    want = []
    for r in df.collect():
        n, form, p, m, out = plain(r.doc_id, r.text or "")
        want.append((str(r.doc_id), n, form, p, m, sha256(out.encode()).hexdigest(), sha256((r.text or "").encode()).hexdigest()))
    assert repr(got) == repr(sorted(want))
    assert fim.digests(tables.empty(spark)).count() == 0

    kept = fim.store(df, 256)
    texts = sorted((str(r.doc_id), r.text) for r in fim.texts(fim.fill_in_middle(kept)).collect())
    assert texts == sorted((str(r.doc_id), plain(r.doc_id, r.text or "")[4]) for r in df.collect())
    for a, b in ((0, 3), (2, 2), (5, 40), (3, 10 ** 6)):
        cut = sorted((str(r.doc_id), r.text) for r in fim.units_between(kept, a, b).collect())
        assert cut == sorted((str(r.doc_id), "".join(UNIT.findall(r.text or "")[a:b])) for r in df.collect())
