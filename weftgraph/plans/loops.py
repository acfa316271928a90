"""Driver loops over DataFrames whose lineage stays short."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from weftgraph.plans.lineage import forget, written


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], times: int, every: int = 5, on_step: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """``step`` applied ``times`` times.  Each ``every`` steps, and at the end, the state is
    written to the shared folder, so plans stay small and a lost executor costs few steps."""
    last = None
    for i in range(times):
        state = step(state, i)
        if (i + 1) % every == 0 or i + 1 == times or on_step is not None:
            state = written(state, "state")
            if on_step is not None:
                on_step(state, i)
            if last is not None:
                forget(last)
            last = state
    return state


def fix_point(state: DataFrame, delta: DataFrame, expand: Callable[[DataFrame, DataFrame, int], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], max_iter: int | None = None) -> DataFrame:
    """Semi-naive evaluation: ``expand(state, delta, i)`` gives the rows that improve on the
    state; they are merged and become the next delta, until there are none."""
    old = None
    i = 0
    while max_iter is None or i < max_iter:
        new = written(expand(state, delta, i), "delta")
        if new.isEmpty():
            break
        state = written(merge(state, new), "state")
        if old is not None:
            forget(old)
        old, delta = state, new
        i += 1
    return state
