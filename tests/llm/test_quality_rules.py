"""Quality rules against plain string work, and the token measures against the tokenizer."""

import base64
import random

import numpy as np
import sentencepiece

from splitlens.llm import quality_rules as Q
from splitlens.llm.registry import QUERIES
from splitlens.llm.staging import prepare, tokenizer_path

from . import tables

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op10_quality_rules"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")["text"]
    assert sorted(got.doc_id) == sorted(docs.index)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(Q.VOCABULARY))
    for r in got.itertuples():
        want = Q.base_counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        tokens = [t for w in docs[r.doc_id].encode().split() for t in sp.encode(w.decode())]
        assert r.n_tokens == len(tokens)
        assert not r.kept or not r.base_failed


def test_awkward_rows(spark):
    prepare(spark)
    out = Q.apply_rules(tables.awkward(spark).drop("kept")).toPandas()
    assert len(out) == len(tables.TEXTS) + 4
    for text, q in zip(out.text, out.quality):
        assert tuple(q[c] for c in BASE) == Q.base_counts(text)
    assert out[out.text.isna()].base_failed.all()
    same = out[out.text == tables.TEXTS[6]]
    assert len(same) == 4 and same.kept.nunique() == 1
    kept = Q.keep_good(tables.awkward(spark))
    assert kept.columns == tables.awkward(spark).columns
    assert Q.apply_rules(tables.empty(spark)).count() == 0


def test_bands_reject_blobs_and_keep_prose(spark):
    prepare(spark)
    rng = np.random.default_rng(3)
    blob = " ".join("".join(rng.choice(list("qzxjkvwQZXJKVW0123456789+/"), 60)) for _ in range(40))
    fallback = " ".join("ᚠᚱᛇ" * 3 for _ in range(5)) + " plain words with letters of the latin script here and there"
    flat = " ".join(f"a{'a' * (i % 3)}" for i in range(9)) + " " + "b " * 2
    prose = "It was the first day of the year and everyone in the town had gone down to the river to watch the boats come in."
    got = {r.text: (r.base_failed, r.in_band, r.quality.script) for r in
           Q.apply_rules(spark.createDataFrame([(blob,), (fallback,), (flat,), (prose,)], "text string")).collect()}
    assert got[prose] == (False, True, "latin")
    assert got[blob][:2] == (False, False)
    assert got[fallback][2] == "latin"


def test_scripts():
    for text, want in (("abc", "latin"), ("Жизнь", "cyrillic"), ("你好", "cjk"),
                       ("한국", "hangul"), ("αβ", "greek"), ("123 ...", "other")):
        assert Q.script_of(np.frombuffer(text.encode(), np.uint8)) == want


VIETNAMESE = ("Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hoá "
              "ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình anh em.")
POLISH = ("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem "
          "i powinni postępować wobec innych w duchu braterstwa.")


def test_encoded_blobs_fall_out_and_other_languages_stay(spark):
    prepare(spark)
    rng = random.Random(5)
    lines = lambda s, n: "\n".join(s[i:i + n] for i in range(0, len(s), n))
    blobs = []
    for n in (64, 76):
        blobs += [lines(f(rng.randbytes(1500)).decode(), n) for f in (base64.b64encode, base64.b32encode, base64.b85encode) for _ in range(10)]
        blobs += [lines(base64.b64encode(VIETNAMESE.encode() * 4).decode(), n), lines(rng.randbytes(1000).hex(), n), lines(rng.randbytes(1000).hex().upper(), n)]
    letters = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 60))) for _ in range(100)) for _ in range(10)]
    rows = [(b, lang, False) for b in blobs for lang in (None, "en", "fr", "vi")] + [(t, "en", False) for t in letters]
    rows += [(t, lang, True) for t, lang in ((VIETNAMESE, "vi"), (VIETNAMESE, None), (POLISH, "pl"), (POLISH, None))]
    for r in Q.apply_rules(spark.createDataFrame(rows, "text string, lang string, want boolean")).collect():
        assert (r.kept, r.quality.script) == (r.want, "latin"), (r.lang, r.quality, r.text[:60])
