"""Columns of the caller beside columns an operator needs for itself."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame


def set_apart(df: DataFrame, used: Collection[str], keep: Collection[str] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns of the names ``used`` renamed (``keep`` excepted),
    and a function that gives a result their names back."""
    free = lambda c: next(n for i in range(len(df.columns) + 1) if (n := f"_own{i}_{c}") not in df.columns)
    moved = {c: free(c) for c in df.columns if c in used and c not in keep}
    return df.withColumnsRenamed(moved), lambda done: done.withColumnsRenamed({new: c for c, new in moved.items()})
