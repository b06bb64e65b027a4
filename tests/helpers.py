"""Row-multiset comparison shared by the tests (order-insensitive, columns by name)."""

from __future__ import annotations

import math

import pandas as pd


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        v = float(v)
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    return v


def rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(v) for v in rec) for rec in pdf[cols].itertuples(index=False)]
    return cols, sorted(out, key=repr)


def assert_same(a: pd.DataFrame, b: pd.DataFrame):
    ca, ra = rows(a)
    cb, rb = rows(b)
    assert ca == cb
    assert len(ra) == len(rb)
    assert ra == rb
