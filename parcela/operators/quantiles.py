"""Exact quantiles per group, for one or many columns at once.

Spark's ``percentile`` keeps every distinct value of a group in one buffer.
That is the wrong plan when a group holds billions of prices. ``quantiles``
therefore narrows the search down in a few passes of plain counting, whose
state does not grow with the data, unless the caller asks for another method:

1. count the rows per logarithmic cell of the value (at most 256 cells per
   power of two), and find the cells that hold the wanted ranks;
2. split those cells into 16,384 equal parts and count again, until the cells
   hold few rows; after two splits a cell spans at most 2**16 different
   doubles, however many rows there are;
3. sort the distinct values of the chosen cells and read off the ranks.

Each pass shuffles only counts, so a hot group is reduced before the shuffle. The
first one scans the value columns; rows of the chosen cells are stored if
these have to be split, so later passes read no other rows. The ranks that a cell
or value holds are looked up in a grid and by halving, so a thousand
probabilities cost little more than one. All methods interpolate linearly between the two
neighbouring ranks and give the same result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import looked_at, materialize

CELLS_PER_OCTAVE = 256
SPLIT = 1 << 14
MAX_SPLITS = 2
ROWS_TO_SORT = 50_000

# Smallest exponent of a double is -1074, so the shifted logarithm is positive.
_OCTAVE_SHIFT = 1075
_TOP_OCTAVE = 2100


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    method: str = "cells",
) -> DataFrame:
    """Quantiles of numeric ``columns`` within each group of ``by``.

    Returns the ``by`` columns, ``field``, ``n`` (values counted) and
    ``quantiles`` (array in the order of ``probabilities``). Nulls and NaN are
    not counted; null group keys form their own group; a field without values
    has no row. ``method`` is "cells", "hash" (for groups known to fit one buffer)
    or "approx"; only the last one is inexact. "cells" runs its counting passes when called.
    """
    columns, by, probs = list(columns), list(by), [float(p) for p in probabilities]
    values = df.select(*by, *[_number(c).alias(c) for c in columns])
    if method == "cells":
        return _by_cells(values, columns, probs, by)
    if method not in ("hash", "approx"):
        raise ValueError(f"unknown quantile method {method!r}")

    at = F.expr(_constants(probs))
    pick = F.percentile if method == "hash" else (lambda c, p: F.percentile_approx(c, p, 10_000))
    wide = values.groupBy(*by).agg(
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)],
        *[pick(F.col(c), at).alias(f"q_{i}") for i, c in enumerate(columns)],
    )
    fields = [
        F.struct(F.lit(c).alias("field"), F.col(f"n_{i}").alias("n"), F.col(f"q_{i}").alias("quantiles"))
        for i, c in enumerate(columns)
    ]
    return wide.select(*by, F.inline(F.array(*fields))).filter("n > 0")


def quantile_columns(names: Sequence[str], source: str = "quantiles") -> list[Column]:
    """Spread the quantile array into named columns."""
    return [F.element_at(source, i + 1).alias(name) for i, name in enumerate(names)]


def one_row_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                      method: str = "cells") -> dict[str, list[float]]:
    """Ungrouped quantiles on the driver: one short list per column."""
    rows = quantiles(df, columns, probabilities, method=method).collect()
    return {r["field"]: list(r["quantiles"]) for r in rows}


def _number(c: str) -> Column:
    return F.expr(f"nullif(double(`{c}`), double('NaN'))")


# Order-preserving whole number; equal values share a cell.
_LOG_CELL = f"""bigint(if(v = 0, 0, sign(v) *
    floor((if(abs(v) = double('inf'), {float(_TOP_OCTAVE)}, log2(abs(v)) + {_OCTAVE_SHIFT})) * {CELLS_PER_OCTAVE})))"""


def _constants(probs: list[float]) -> str:
    """The probabilities as one constant array, however many there are."""
    return f"cast(split('{','.join(map(repr, probs))}', ',') AS array<double>)"


def _first_not(low: str, high: str, below: str, most: int) -> str:
    """SQL: the least i in ``low``..``high`` for which ``below``, a test of
    ``s.mid`` that holds up to some i and never after, fails. By halving;
    ``most`` bounds high - low."""
    at = "(s.lo + s.hi) div 2"
    return f"""aggregate(sequence(1, {max(1, most.bit_length())}), named_struct('lo', int({low}), 'hi', int({high})),
        (s, turn) -> if(s.lo < s.hi, if({below.replace('s.mid', at)}, named_struct('lo', int({at}) + 1, 'hi', s.hi),
        named_struct('lo', s.lo, 'hi', int({at}))), s), s -> s.lo)"""


class _Ranks:
    """The zero-based ranks needed for some probabilities. Each probability lies
    between two neighbouring ranks, its low and its high one."""

    def __init__(self, probs: list[float]):
        self.given = probs
        self.probs = sorted(set(probs))
        self.array = _constants(self.probs)
        # How many probabilities lie below each point of an even grid: where to
        # look for one without trying them all.
        self.cells = 1 << (2 * len(self.probs)).bit_length()
        self.starts = [bisect_left(self.probs, j / self.cells) for j in range(self.cells + 1)] + [len(self.probs)]

    def position(self, i: str) -> str:
        return f"((total - 1) * element_at({self.array}, int({i}) + 1))"

    def _look(self, rank: str, below: str) -> str:
        """Halving within the grid cells around a rank; one spare cell on each
        side, so rounding of the cell doesn't matter."""
        starts, last = f"cast(split('{','.join(map(str, self.starts))}', ',') AS array<int>)", self.cells + 1
        cell = f"int(greatest(-1, least({last}, floor(double({rank}) / greatest(total - 1, 1) * {self.cells}))))"
        reach = max(self.starts[min(j + 3, last)] - self.starts[j] for j in range(last))
        return _first_not(f"element_at({starts}, greatest({cell} - 1, 0) + 1)", f"element_at({starts}, least({cell} + 2, {last}) + 1)", below, reach)

    def span(self, before: str, n: str) -> tuple[str, str]:
        """First and end of the probabilities with a rank in [before, before + n)."""
        return (self._look(f"{before} - 1", f"ceil({self.position('s.mid')}) < {before}"),
                self._look(f"{before} + {n}", f"floor({self.position('s.mid')}) < {before} + {n}"))


def _by_cells(values: DataFrame, columns: list[str], probs: list[float], by: list[str]) -> DataFrame:
    pairs = ", ".join(f"named_struct('field', '{c}', 'v', `{c}`)" for c in columns)
    rows = values.select(*by, F.expr(f"inline(array({pairs}))")).filter("v IS NOT NULL").withColumn("cell", F.expr(_LOG_CELL))
    group = [*by, "field"]
    return _from_cells(rows, rows.groupBy(*group, "cell").agg(*_cell_counts()), group, _Ranks(probs))


def _cell_counts() -> list[Column]:
    return [F.expr("count(*) AS n"), F.expr("min(v) AS lo"), F.expr("max(v) AS hi")]


def quantiles_and_cells(df: DataFrame, column: str, probabilities: Sequence[float], by: Sequence[str],
                        sums: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Quantiles of one column, and aggregates ``sums`` of all rows in the same
    scan as the first count.

    The aggregates come back per group and cell of the column's values (rows
    without a value are a cell too), for the caller to add up: a few
    thousand rows per group, stored.
    """
    by = list(by)
    rows = df.withColumns({"field": F.lit(column), "v": _number(column)}).withColumn("cell", F.expr(_LOG_CELL))
    group = [*by, "field"]
    cells = materialize(rows.groupBy(*group, "cell").agg(*_cell_counts(), *sums), "counts")
    known = rows.select(*group, "v", "cell").filter("v IS NOT NULL")
    counted = cells.filter("cell IS NOT NULL").select(*group, "cell", "n", "lo", "hi")
    found = _from_cells(known, counted, group, _Ranks([float(p) for p in probabilities]))
    return found, cells.drop("field", "lo", "hi")


def _from_cells(rows: DataFrame, counted: DataFrame, group: list[str], ranks: _Ranks) -> DataFrame:
    inside = Window.partitionBy(*group)
    in_order = inside.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select("*", F.sum("n").over(inside).alias("total"), F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("before"))
    chosen, crowded = _holding_ranks(counted, ranks)
    rows = _null_safe_join(rows, chosen, [*group, "cell"])

    for _ in range(MAX_SPLITS):
        if not crowded:
            break
        # Only rows of the chosen cells are read from here on.
        rows = materialize(rows, "cells")
        part = f"if(hi > lo, least(floor((v - lo) / (hi - lo) * {SPLIT}), {SPLIT - 1}), 0)"
        rows = rows.withColumn("cell", F.expr(f"cell * {SPLIT} + {part}")).drop("lo", "hi", "n")
        parent = [*group, "total", "before"]
        split = rows.groupBy(*parent, "cell").agg(*_cell_counts())
        in_parent = Window.partitionBy(*parent).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        split = split.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(in_parent), F.lit(0)))
        chosen, crowded = _holding_ranks(split, ranks)
        rows = _null_safe_join(rows.drop("total", "before"), chosen, [*group, "cell"])

    # The chosen cells are small now: rank their distinct values.
    distinct = rows.groupBy(*group, "total", "before", "v").agg(F.expr("count(*) AS n"))
    up_to = Window.partitionBy(*group, "total", "before").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    first, end = ranks.span("at", "n")
    placed = distinct.withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    placed = placed.selectExpr(*_quoted(group), "total", "v", "at", "n", f"{first} AS p0", f"{end} AS p1").filter("p0 < p1")
    # A value's ranks are those of its own few probabilities.
    position = ranks.position("p")
    at_rank = placed.select(*group, "total", "v", F.expr(f"""explode(filter(array_distinct(flatten(transform(sequence(p0, p1 - 1),
        p -> array(floor({position}), ceil({position}))))), k -> k >= at AND k < at + n)) AS rank"""))
    # At most two ranks per probability reach this list.
    found = at_rank.groupBy(*group, "total").agg(F.expr("array_sort(collect_list(named_struct('rank', rank, 'v', v))) AS r"))

    def value(rank: str) -> str:
        return f"element_at(r, {_first_not('0', 'size(r)', f'element_at(r, int(s.mid) + 1).rank < {rank}', 2 * len(ranks.probs))} + 1).v"

    # Equal neighbours are taken as they are: weighting could change the last bit.
    between = f"""transform(transform({_constants(ranks.given)}, p -> (total - 1) * p), x -> transform(
        array(named_struct('a', {value('floor(x)')}, 'b', {value('ceil(x)')})),
        y -> if(y.a = y.b, y.a, (ceil(x) - x) * y.a + (x - floor(x)) * y.b))[0])"""
    return found.selectExpr(*_quoted(group), "total AS n", f"{between} AS quantiles")


def _quoted(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _holding_ranks(counted: DataFrame, ranks: _Ranks) -> tuple[DataFrame, bool]:
    """The cells that hold a wanted rank, and whether one of them should be split."""
    first, end = ranks.span("before", "n")
    holding = counted.filter(F.expr(f"{first} < {end}"))
    big = f"n > {ROWS_TO_SORT} AND hi > lo"
    side, seen = looked_at(holding.withColumn("_big", F.expr(big)))
    crowded = bool(pc.any(seen["_big"]).as_py()) if seen is not None else bool(side.filter("_big").limit(1).count())
    return side.drop("_big"), crowded


def _null_safe_join(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    renamed = side.withColumnsRenamed({k: f"_s_{k}" for k in keys})
    same = " AND ".join(f"`{k}` <=> `_s_{k}`" for k in keys)
    return rows.join(renamed, F.expr(same), "inner").drop(*[f"_s_{k}" for k in keys])
