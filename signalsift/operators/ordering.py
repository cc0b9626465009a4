"""Order-dependent operators that do not put a whole group into one task.

A plain ``Window.partitionBy("scenario_id")`` sorts all rows of a scenario in
one task. With few scenarios, one of which may hold a third of all rows, that
is the bottleneck of every plan here. The operators of this module cut the
groups that are too large into *slices*: a slice is a range of the sort key,
and which slice a row is in depends only on the values of the row and on a
small list of origins and widths. No sampling, partition number or
materialised copy is involved, so a lost executor changes nothing.

Within a slice an ordinary window function does the work. What a slice needs
to know about earlier slices (rows before it, a running total, the last known
value) comes from one aggregate row per slice, which joins the slice as its
first row.

Row order is ``order``: numeric, date or timestamp columns, ascending, NULL
first, the last of them a tie-breaker.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalsift.session import staged

#: Rows of one group that one task is asked to sort.
ROWS_PER_SLICE = 1_000_000
#: Most entries of one refinement level; the target grows if more were needed.
MAX_HOT_GROUPS = 50_000
_LEAST_SPLIT = 64
_MAX_LEVELS = 24


def _as_number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.col(name).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("long")
    raise TypeError(f"order column {name} must be numeric, date or timestamp, not {kind.simpleString()}")


def _same(keys: Sequence[str], prefix: str) -> Column:
    """Equality of all keys with their prefixed copies, NULL equal to NULL."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join of per-group columns to the rows of the groups.

    The per-group table is staged first: Spark then knows its size and
    broadcasts it if it is below the broadcast threshold. If it is not, the
    join is a merge join, whose hot groups adaptive execution splits.
    """
    renamed = staged(small.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *columns), "groups")
    return df.join(renamed, _same(keys, "__k_"), "left").drop(*[f"__k_{k}" for k in keys])


@dataclass(frozen=True)
class SlicePlan:
    """How to cut the large groups of a table; ``levels`` is empty if none is."""

    by: tuple[str, ...]
    order: tuple[str, ...]
    levels: list[DataFrame] = field(default_factory=list)

    @property
    def slice_columns(self) -> list[str]:
        return [f"__slice{i}" for i in range(len(self.levels))]

    @property
    def keys(self) -> list[str]:
        return [*self.by, *self.slice_columns]

    def apply(self, df: DataFrame) -> DataFrame:
        for depth in range(len(self.levels)):
            df = self._cut(df, depth)
        return df

    def _cut(self, df: DataFrame, depth: int) -> DataFrame:
        """Add one level: rows of a hot key get the number of their range."""
        keys = [*self.by, *[f"__slice{i}" for i in range(depth)]]
        hot = F.broadcast(self.levels[depth])  # at most MAX_HOT_GROUPS rows
        joined = df.join(hot, _same(keys, "__h_"), "left")
        place = F.lit(None).cast("long")
        for i, name in reversed(list(enumerate(self.order))):
            value = _as_number(df, name)
            low = F.col(f"__low{i}")
            # The range of a hash does not fit into a long; in double it is cut less finely.
            apart = F.coalesce(F.try_subtract(value, low).cast("double"), value.cast("double") - low.cast("double"))
            number = F.floor(apart / F.col("__width"))
            place = F.when(F.col("__on") == i, F.coalesce(number, F.lit(-1))).otherwise(place)
        cut = F.when(F.col("__on").isNull(), F.lit(0)).otherwise(place).cast("long")
        return joined.withColumn(f"__slice{depth}", cut).select(*df.columns, f"__slice{depth}")


def _hot_table(df: DataFrame, keys: list[str], order: Sequence[str], rows: list, target: int) -> DataFrame | None:
    """The cut of each hot key: on which order column, from where, how wide."""
    out = []
    for row in rows:
        for i in range(len(order)):
            low, high, missing = row[f"lo{i}"], row[f"hi{i}"], row[f"na{i}"]
            if low is None or (low == high and not missing):
                continue  # constant here, the next order column decides
            parts = max(math.ceil(row["n"] / target), _LEAST_SPLIT)
            width = (high - low) / parts if high > low else 1.0
            lows = [row[f"lo{j}"] if j == i else None for j in range(len(order))]
            out.append((*[row[k] for k in keys], i, float(width), *lows))
            break
    if not out:
        return None
    fields = [T.StructField(f"__h_{k}", df.schema[k].dataType) for k in keys]
    fields += [T.StructField("__on", T.IntegerType()), T.StructField("__width", T.DoubleType())]
    for i, name in enumerate(order):
        kind = df.select(_as_number(df, name).alias("v")).schema["v"].dataType
        fields.append(T.StructField(f"__low{i}", kind))
    return df.sparkSession.createDataFrame(out, T.StructType(fields))


def plan_slices(
    df: DataFrame, by: Sequence[str], order: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE
) -> SlicePlan:
    """Find the groups of ``by`` with more than ``rows_per_slice`` rows and
    ranges of ``order`` that cut them, with one small aggregate for a level."""
    if not by:
        raise ValueError("slices need at least one grouping column")
    by, order = tuple(by), tuple(order)
    thin = df.select(*dict.fromkeys([*by, *order]))
    sizes = thin.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    plan = SlicePlan(by, order, [])
    if not total or largest <= rows_per_slice:
        return plan
    target = max(rows_per_slice, math.ceil(total / MAX_HOT_GROUPS))
    current = thin
    for depth in range(_MAX_LEVELS):
        keys = plan.keys
        ends = []
        for i, name in enumerate(order):
            value = _as_number(thin, name)
            ends += [
                F.min(value).alias(f"lo{i}"),
                F.max(value).alias(f"hi{i}"),
                F.count_if(value.isNull()).alias(f"na{i}"),
            ]
        limit = target if depth == 0 else 2 * target
        rows = (
            current.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), *ends)
            .filter(F.col("n") > limit)  # at most total / target groups
            .collect()
        )
        level = _hot_table(current, keys, order, rows, target) if rows else None
        if level is None:
            break
        # Only rows of hot keys are looked at again.
        plan.levels.append(level)
        hot = level.select(*[F.col(f"__h_{k}") for k in keys])
        current = plan._cut(current.join(F.broadcast(hot), _same(keys, "__h_"), "left_semi"), depth)
    return plan


def _before(plan: SlicePlan) -> WindowSpec:
    """All earlier slices of the group; a window over one row per slice."""
    return (
        Window.partitionBy(*plan.by)
        .orderBy(*plan.slice_columns)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _seeded(sliced: DataFrame, seeds: DataFrame, plan: SlicePlan) -> tuple[DataFrame, WindowSpec]:
    """Put what a slice must know of earlier ones in front of it, as a row.

    A union instead of a join: rows and seeds meet in the one shuffle the
    window needs anyway, whatever the number of slices.
    """
    both = sliced.withColumn("__row", F.lit(1)).unionByName(
        seeds.withColumn("__row", F.lit(0)), allowMissingColumns=True
    )
    inside = (
        Window.partitionBy(*plan.keys)
        .orderBy("__row", *plan.order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return both, inside


def _without_seeds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(F.col("__row") == 1).select(*columns)


def _by(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Grouping columns; the whole table is one group of a constant."""
    return (df, list(by)) if by else (df.withColumn("__all", F.lit(0)), ["__all"])


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    out: str = "rn",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """1-based position of each row in its group."""
    columns = [*df.columns, out]
    df, by = _by(df, by)
    plan = plan_slices(df, by, order, rows_per_slice)
    if not plan.levels:
        inside = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(out, F.row_number().over(inside).cast("long")).select(*columns)
    sizes = plan.apply(df).groupBy(*plan.keys).agg(F.count(F.lit(1)).alias("__n"))
    seeds = sizes.select(*plan.keys, F.coalesce(F.sum("__n").over(_before(plan)), F.lit(0)).alias("__step"))
    both, inside = _seeded(plan.apply(df).withColumn("__step", F.lit(1).cast("long")), seeds, plan)
    return _without_seeds(both.withColumn(out, F.sum("__step").over(inside)), columns)


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: dict[str, str],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Inclusive running totals, ``columns`` maps input to output names."""
    result = [*df.columns, *columns.values()]
    df, by = _by(df, by)
    plan = plan_slices(df, by, order, rows_per_slice)
    if not plan.levels:
        inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({out: F.sum(src).over(inside) for src, out in columns.items()}).select(*result)
    totals = plan.apply(df).groupBy(*plan.keys).agg(*[F.sum(c).alias(f"__t_{c}") for c in columns])
    seeds = totals.select(*plan.keys, *[F.sum(f"__t_{c}").over(_before(plan)).alias(f"__x_{c}") for c in columns])
    steps = plan.apply(df).withColumns({f"__x_{c}": F.col(c) for c in columns})
    both, inside = _seeded(steps, seeds, plan)
    return _without_seeds(
        both.withColumns({out: F.sum(f"__x_{src}").over(inside) for src, out in columns.items()}), result
    )


def carry_forward(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    rows_per_slice: int = ROWS_PER_SLICE,
    known: DataFrame | None = None,
) -> DataFrame:
    """Fill NULL with the last known value of the group.

    ``known`` is a cheaper table to look the slices and last values up in:
    one with the same order keys and values, but for repeated rows.
    """
    result = list(df.columns)
    source, by = _by(df if known is None else known, by)
    df, by = _by(df, by if by != ["__all"] else ())
    plan = plan_slices(source, by, order, rows_per_slice)
    if not plan.levels:
        inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns}).select(*result)
    place = F.struct(*order)
    ends = plan.apply(source).groupBy(*plan.keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__e_{c}") for c in columns]
    )
    seeds = ends.select(
        *plan.keys, *[F.last(f"__e_{c}", ignorenulls=True).over(_before(plan)).alias(c) for c in columns]
    )
    both, inside = _seeded(plan.apply(df), seeds, plan)
    return _without_seeds(
        both.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns}), result
    )


#: Positions handled together by a chunked frame.
CHUNK = 100_000


def over_frame(
    df: DataFrame,
    by: Sequence[str],
    position: str,
    reach: int,
    build,
    chunk: int = CHUNK,
) -> DataFrame:
    """Window functions that look at most ``reach`` rows back.

    ``position`` is the dense number of a row in its group. Each group is cut
    into chunks of equal length, and the last ``reach`` rows of a chunk are
    copied into the next one, so every frame is complete inside its chunk and
    no group needs one task. ``build(window)`` returns the new columns, given
    a window ordered by position; copies are removed at the end.
    """
    home = F.floor(F.col(position) / F.lit(chunk))
    near_end = F.pmod(F.col(position), F.lit(chunk)) >= chunk - reach
    copies = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn("__chunk", F.explode(copies))
    window = Window.partitionBy(*by, "__chunk").orderBy(position)
    return (
        spread.withColumns(build(window))
        .filter(F.col("__chunk") == home)
        .drop("__chunk")
    )
