"""Positions and running totals inside groups, safe for very large groups.

A plain ``row_number().over(Window.partitionBy(place))`` sorts every row of a
place in one task; one place may hold a third of all rows.  ``running_total`` takes
prefix sums in two steps instead, over *ranges* of the order:

1. ``span`` maps a row to its range (a long that never falls along the order, e.g. the
   day of a date order); totals per (group, range) are one partial aggregate;
2. a window over the ranges of a group (a few rows each) gives the total before each
   range, which is joined back;
3. a window inside (group, range) numbers the rows there.  The join and this window
   share one hash partitioning, so the rows are shuffled once.

The plan is the same for every size and lazy: nothing runs while it is built, and
ranges depend on the rows' own values, so a recomputed partition gives the same numbers.

The result equals ``sum(weight) over (partition by group order by order rows
between unbounded preceding and current row)`` (or ``... 1 preceding`` when
``inclusive=False``).  ``order`` must be a total order inside each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_S, _W, _T, _B, _N = "_rt_span", "_rt_w", "_rt_total", "_rt_before", "_rt_all"


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                  out: str, span: Column, weight: str | Column | None = None,
                  inclusive: bool = True, whole: str | None = None) -> DataFrame:
    """Adds ``out``; ``whole`` names a column for the group's whole total."""
    group = list(group)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    w = F.lit(1).cast("long") if weight is None else (
        F.col(weight) if isinstance(weight, str) else weight).cast("long")
    rows = df.withColumn(_S, F.coalesce(span.cast("long"), F.lit(2**62))).withColumn(_W, w)
    keys = [f"_rt_g{i}" for i in range(len(group))]
    ranges = rows.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col(_S).alias(_S + "_r")).agg(F.sum(_W).alias(_T))
    along = Window.partitionBy(*keys).orderBy(_S + "_r")
    before = ranges.select(*keys, _S + "_r", (F.sum(_T).over(along) - F.col(_T)).alias(_B),
                           F.sum(_T).over(Window.partitionBy(*keys)).alias(_N))
    meet = F.col(_S) == F.col(_S + "_r")
    for g, k in zip(group, keys):
        meet = meet & F.col(g).eqNullSafe(F.col(k))
    inside = Window.partitionBy(*group, _S).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col(_B) + F.sum(_W).over(inside)
    if not inclusive:
        total = total - F.col(_W)
    # Never broadcast: compressed, the rows look a fiftieth of their size, and there may be a range for each of them.
    done = rows.join(before.hint("merge"), meet).withColumn(out, total.cast("long"))
    if whole:
        done = done.withColumn(whole, F.col(_N).cast("long"))
    return done.drop(_S, _W, _B, _N, _S + "_r", *keys)


def position(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
             out: str, span: Column, whole: str | None = None) -> DataFrame:
    """1-based dense position (``row_number``) of each row inside its group."""
    return running_total(df, group, order, out, span, whole=whole)
