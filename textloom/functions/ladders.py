"""From metric values to complexity classes: half-open ladders and the structural decision tree."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Ranges hold their lower end but not their upper end, so 5, 10, 20 and 50 (5, 15, 30 and 60 for the
# cognitive one) are in no range.
CYCLOMATIC = ((1, 5, "constant"), (6, 10, "linear"), (11, 20, "quadratic"), (21, 50, "cubic"), (51, math.inf, "exponential"))
COGNITIVE = ((0, 5, "constant"), (6, 15, "linear"), (16, 30, "quadratic"), (31, 60, "cubic"), (61, math.inf, "exponential"))
HALSTEAD = ((0, 5, "constant"), (5, 10, "linear"), (10, 20, "quadratic"), (20, 40, "cubic"), (40, math.inf, "exponential"))
MAINTAINABILITY = ((80, 101, "constant"), (60, 80, "linear"), (40, 60, "quadratic"), (20, 40, "cubic"), (0, 20, "exponential"))
NESTING = ((0, 1, "constant"), (1, 2, "linear"), (2, 3, "quadratic"), (3, 4, "cubic"), (4, math.inf, "exponential"))


def ladder(value: Column, rules) -> Column:
    """The class of the first range that holds ``value``; a value in none is exponential, as is a null."""
    out = F.lit("exponential")
    for low, high, name in reversed(rules):
        inside = (value >= low) if high == math.inf else (value >= low) & (value < high)
        out = F.when(inside, name).otherwise(out)
    return out


def _steps(value: Column, steps, rest: str, above: bool) -> Column:
    out = F.lit(rest)
    for bound, name in reversed(steps):
        out = F.when(value >= bound if above else value < bound, name).otherwise(out)
    return out


def halstead_class(difficulty: Column) -> Column:
    """By difficulty, with no gaps."""
    return _steps(difficulty, ((5, "constant"), (10, "linear"), (20, "quadratic"), (40, "cubic")), "exponential", False)


def maintainability_class(index: Column) -> Column:
    """By maintainability index: the higher, the simpler."""
    return _steps(index, ((80, "constant"), (60, "linear"), (40, "quadratic"), (20, "cubic")), "exponential", True)


def maintainability_rank(index: Column) -> Column:
    """A to F, without E."""
    return _steps(index, ((80, "A"), (60, "B"), (40, "C"), (20, "D")), "F", True)


def nesting_class(depth: Column) -> Column:
    """By depth of nested blocks."""
    return _steps(depth, ((1, "constant"), (2, "linear"), (3, "quadratic"), (4, "cubic")), "exponential", False)


def maintainability_base(index: Column) -> Column:
    """The base metric that stands for a maintainability index in the structural tree."""
    return (F.lit(100) - index) / F.lit(10.0)


def structural_class(depth: Column, loops: Column, recursive: Column, base: Column) -> Column:
    """Class by loop depth, number of loops, recursion and a base metric."""
    single = F.when((loops > 2) & (base > 8), "nlogn").when((loops == 1) & (base > 10), "nlogn").otherwise("linear")
    return (
        F.when(recursive, F.when((depth >= 1) | (base > 5), "exponential").otherwise("nlogn"))
        .when(depth >= 4, "exponential").when(depth == 3, "cubic").when(depth == 2, "quadratic").when(depth == 1, single)
        .when(loops == 0, F.when(base > 10, "logn").otherwise("constant")).otherwise("linear")
    )


def _enhanced(metric: str, default: float) -> Callable[[], Column]:
    return lambda: structural_class(F.col("max_loop_depth"), F.col("total_loops"), F.col("has_recursion"), F.coalesce(F.col(metric).cast("double"), F.lit(float(default))))


#: Each tool's class from the columns of ``code_metrics``, by its metric alone.
BASELINE: dict[str, Callable[[], Column]] = {
    "radon": lambda: ladder(F.coalesce("cyclomatic", F.lit(1)), CYCLOMATIC),
    "lizard": lambda: ladder(F.coalesce("token_cyclomatic", F.lit(1)), CYCLOMATIC),
    "mccabe": lambda: ladder(F.coalesce("path_cyclomatic", F.lit(1)), CYCLOMATIC),
    "complexipy": lambda: ladder(F.coalesce("cognitive", F.lit(0)), COGNITIVE),
    "halstead": lambda: halstead_class(F.coalesce("halstead_difficulty", F.lit(1.0))),
    "mi": lambda: maintainability_class(F.coalesce("maintainability", F.lit(100.0))),
    "nbd": lambda: nesting_class(F.coalesce("nested_block_depth", F.lit(0))),
}
#: The same by the structural tree over loops, recursion and the tool's metric.
ENHANCED: dict[str, Callable[[], Column]] = {
    "radon": _enhanced("cyclomatic", 1),
    "lizard": _enhanced("token_cyclomatic", 1),
    "mccabe": _enhanced("path_cyclomatic", 1),
    "complexipy": _enhanced("cognitive", 0),
    "halstead": _enhanced("halstead_difficulty", 1),
    "mi": lambda: structural_class(F.col("max_loop_depth"), F.col("total_loops"), F.col("has_recursion"), maintainability_base(F.coalesce("maintainability", F.lit(100.0)))),
    "nbd": _enhanced("max_loop_depth", 0),
}
#: Tools that need to run the code are known but not enabled.
TOOLS = {**dict.fromkeys(BASELINE, True), "big_o": False, "trend_profiler": False}


def register(tool: str, baseline: Callable[[], Column], enhanced: Callable[[], Column] | None = None, enabled: bool = True) -> None:
    """Another tool: its class by its metric alone, and by the structural tree (the same, if it isn't given)."""
    if tool in TOOLS:
        raise ValueError(f"tool is known: {tool}")
    BASELINE[tool], ENHANCED[tool], TOOLS[tool] = baseline, enhanced or baseline, enabled


def enabled_tools(names=None) -> list[str]:
    """The enabled ones of ``names`` (all, if None); none at all is an error."""
    found = [x for x in (TOOLS if names is None else names) if TOOLS.get(x)]
    if not found:
        raise ValueError("no enabled tool is named")
    return found
