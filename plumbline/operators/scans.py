"""Running values over the rows of a key, in two levels, so that one huge key is not one task.

A key's rows are cut into pieces of a range of positions.  Running values within a piece
are a window over (key, piece); a piece's totals are aggregated before they are shuffled;
the totals before each piece are a window over one row a piece; and a piece's rows get them
by a join on (key, piece), by which they lie together already.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Positions of a piece: a task holds so many rows of one key at most, where positions count rows.
PIECE = 65_536


def unused(columns: Iterable[str], name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def same(left: DataFrame, right: DataFrame, left_names: list[str], right_names: list[str]) -> Column:
    return reduce(and_, (left[a].eqNullSafe(right[b]) for a, b in zip(left_names, right_names)))


def running(items: DataFrame, keys: list[str], pos: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, piece: int = PIECE) -> DataFrame:
    """items with a column for each of sums (running sum, nulls count nothing) and lasts (last value that is not null), the row itself included.

    Rows go by pos, a whole number; rows of one pos, if there are any, in no fixed order, and rows without one come first.
    Null keys are keys like others. Columns of these names are replaced. No rows give none.
    """
    sums, lasts = sums or {}, lasts or {}
    cut = unused([*items.columns, *sums, *lasts], "piece")
    values = {name: unused([*items.columns, cut, *sums, *lasts], f"of_{name}") for name in [*sums, *lasts]}
    valued = items.withColumns({values[n]: c for n, c in {**sums, **lasts}.items()} | {cut: F.coalesce(F.floor(F.col(pos) / piece), F.lit(-1))})
    within = Window.partitionBy(*keys, cut).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = {n: F.coalesce(F.sum(values[n]).over(within), F.lit(0)) for n in sums} | {n: F.last(values[n], ignorenulls=True).over(within) for n in lasts}
    place = F.struct(F.col(pos).isNotNull(), F.col(pos))
    totals = valued.groupBy(*keys, cut).agg(*(F.sum(values[n]).alias(f"t{k}") for k, n in enumerate(sums)), *(F.max_by(values[n], F.when(F.col(values[n]).isNotNull(), place)).alias(f"v{k}") for k, n in enumerate(lasts)))
    before = Window.partitionBy(*keys).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *(F.col(c).alias(f"k{k}") for k, c in enumerate([*keys, cut])), *(F.coalesce(F.sum(f"t{k}").over(before), F.lit(0)).alias(f"t{k}") for k in range(len(sums))), *(F.last(f"v{k}", ignorenulls=True).over(before).alias(f"v{k}") for k in range(len(lasts)))
    )
    rows = valued.withColumns(local)
    joined = rows.join(offsets, same(rows, offsets, [*keys, cut], [f"k{k}" for k in range(len(keys) + 1)]))  # keys may be none: all rows are one key's
    whole = {n: rows[n] + offsets[f"t{k}"] for k, n in enumerate(sums)} | {n: F.coalesce(rows[n], offsets[f"v{k}"]) for k, n in enumerate(lasts)}
    kept = [c for c in rows.columns if c not in whole and c != cut and c not in values.values()]
    return joined.select(*(rows[c] for c in kept), *(c.alias(n) for n, c in whole.items()))
