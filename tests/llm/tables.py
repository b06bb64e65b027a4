"""Small awkward tables shared by the operator tests."""

from __future__ import annotations

import pandas as pd

LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30000))
TEXTS = [
    None, "", " \t\n ", "one", "a b c d e", "A b C d e f g h i j k", "a b c d e f g h i j k",
    "x x x x x x x x x x x x x x x x", "line one two\nline one two\n\nother line here now yes ok",
    "###$$$ <html> %%% & | *", "café naïve 你好 Жизнь \U0001f600 z y",
    LONG, LONG + " more", "no\x00nul \x1c \x85   here ▁ x  y",
]


def awkward(spark, extra: bool = True):
    """Null and empty texts, nulls in every column, repeated rows, clashing extra columns."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", None if t is None else len(t))
            for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[6], (None, "a b c d e f g h i j k", None, None, None), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        rows = [(*r, 1, "x", 2.5) for r in rows]
        schema += ", size int, kept string, score double"
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def pandas(df) -> pd.DataFrame:
    return df.toPandas()
