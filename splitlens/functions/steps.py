"""Funnel step vocabulary and the step -> number map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The funnel steps in order, and their numbers (must equal the reference).
STEPS = ["start", "step_1", "step_2", "step_3", "confirm"]
STEP_ORDER = {"start": 0, "step_1": 1, "step_2": 2, "step_3": 3, "confirm": 4}

ARMS = ["Control", "Test"]
UNASSIGNED_LABEL = "Others"


def step_num(step: Column | str = "process_step") -> Column:
    """Map a step name to 0..4; unknown or null names give null (P10)."""
    step = F.col(step) if isinstance(step, str) else step
    expr = None
    for name, num in STEP_ORDER.items():
        expr = (F.when(step == name, F.lit(num)) if expr is None
                else expr.when(step == name, F.lit(num)))
    return expr.cast("int")


def step_num_sql(col: str = "process_step") -> str:
    """The same map as a SQL CASE expression (used by the oracle)."""
    arms = " ".join(f"WHEN '{name}' THEN {num}" for name, num in STEP_ORDER.items())
    return f"CAST(CASE {col} {arms} END AS INTEGER)"
