"""Schemas of the record types, and the ordered complexity classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complexity classes from the least to the greatest (fixed values).
CLASSES = ("constant", "logn", "linear", "nlogn", "quadratic", "cubic", "exponential")

CODE_SAMPLE = "src string, complexity string, problem string, tags array<string>"
SOLUTION_SAMPLE = "query_code string, query_dataclass_code string, problem_id string, solution_id string, time_complexity_inferred string, space_complexity_inferred string"


def ordinal(label: Column) -> Column:
    """Place of a class in the order, from 0; null for a label outside it."""
    place = F.array_position(F.array(*map(F.lit, CLASSES)), label)
    return F.when(place > 0, (place - 1).cast("int"))

