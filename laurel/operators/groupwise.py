"""Group-wise building blocks that stay distributed when one group is huge.

A window over a group sends the whole group to one task.  The functions here
use three other shapes instead:

* group statistics: partially aggregated ``groupBy`` joined back, so a hot
  group is pre-reduced before the shuffle and the join side is one row per
  group (broadcast by AQE when small, split by its skew join when not);
* running totals and dense positions: totals per (group, cell) are prefix-summed
  over the small cell table and added to a window *inside* each cell;
* top-k and capped ranks: ``row_number() <= k`` filters, which Spark evaluates
  with a per-task group limit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OrderBy = Sequence["str | Column"]


def join_null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str], never_null: bool = False) -> DataFrame:
    """Left join on equal keys in which null equals null: rows with a null key are one group.

    Keeps the columns of ``df``, then those of ``other`` that are no keys.  Where the keys are
    ``never_null`` a plain equality does, which leaves rows in the buckets that a table has of them.
    """
    renamed = other.select(*[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    equal = Column.__eq__ if never_null else Column.eqNullSafe
    matched = [equal(F.col(k), F.col(f"__key_{i}")) for i, k in enumerate(keys)]
    condition = F.lit(True) if not matched else reduce(Column.__and__, matched)
    return df.join(renamed, condition, "left").drop(*[f"__key_{i}" for i in range(len(keys))])


def with_group_stats(
    df: DataFrame, keys: Sequence[str], source: DataFrame | None = None, **stats: Column
) -> DataFrame:
    """Attach aggregates of the row's group to every row.

    The aggregates are taken over ``source`` (default: ``df`` itself).  Passing
    the narrow table a pipeline started from keeps its plan linear.
    """
    table = (df if source is None else source).groupBy(*keys).agg(*[c.alias(name) for name, c in stats.items()])
    return join_null_safe(df, table, list(keys))


def with_running_totals(
    df: DataFrame,
    keys: Sequence[str],
    cell: Sequence[str],
    order: OrderBy,
    measures: dict[str, Column],
    strict: bool = False,
) -> DataFrame:
    """Add, per measure, its sum over all earlier rows of the same group.

    ``cell`` columns lead the row order; ``order`` continues it inside a cell.
    With ``strict`` only earlier cells count, never earlier rows of the own cell.
    """
    keys, cell = list(keys), list(cell)
    base = {name: f"__base_{name}" for name in measures}
    totals = df.groupBy(*keys, *cell).agg(
        *[F.sum(expr).alias(base[name]) for name, expr in measures.items()]
    )
    before = Window.partitionBy(*keys).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys,
        *cell,
        *[F.coalesce(F.sum(b).over(before), F.lit(0)).alias(b) for b in base.values()],
    )
    if strict:
        inner = {name: F.lit(0) for name in measures}
    else:
        within = (
            Window.partitionBy(*keys, *cell)
            .orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        inner = {
            name: F.coalesce(F.sum(expr).over(within), F.lit(0))
            for name, expr in measures.items()
        }
    rows = df.select("*", *[expr.alias(f"__in_{name}") for name, expr in inner.items()])
    joined = join_null_safe(rows, totals, keys + cell)
    return joined.select(
        *df.columns,
        *[
            (F.col(f"__in_{name}") + F.col(base[name])).cast("bigint").alias(name)
            for name in measures
        ],
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    cell: Column,
    order: OrderBy,
    name: str = "pos",
) -> DataFrame:
    """Dense 1-based position of every row in its group.

    ``cell`` must not decrease along ``order``; it splits a large group.
    """
    marked = df.withColumn("__cell", cell)
    counted = with_running_totals(marked, keys, ["__cell"], order, {name: F.lit(1)})
    return counted.select(*df.columns, (F.col(name) + 1).alias(name))


def top_k(df: DataFrame, keys: Sequence[str], order: OrderBy, k: int, name: str = "pos") -> DataFrame:
    """The first ``k`` rows of each group with their 1-based position."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def with_first_rank_capped(
    df: DataFrame,
    keys: Sequence[str],
    order: OrderBy,
    row_key: Sequence[str],
    cap: int,
    name: str,
    source: DataFrame | None = None,
) -> DataFrame:
    """``least(row_number, cap)``: only the first ``cap - 1`` rows need ranking.

    Ranks are taken over ``source`` (default: ``df``), which holds the same rows.
    """
    join_on = list(dict.fromkeys([*keys, *row_key]))
    head = top_k(df if source is None else source, keys, order, cap - 1, name).select(*join_on, name)
    return (
        join_null_safe(df, head, join_on)
        .select(*df.columns, F.coalesce(F.col(name), F.lit(cap)).cast("int").alias(name))
    )


def with_average_rank_capped(
    df: DataFrame, keys: Sequence[str], value: str, cap: int, name: str, never_null: bool = False
) -> DataFrame:
    """``least(average rank of ties, cap)``.

    Rows are first counted per distinct value.  The ``cap``-th distinct value
    already ranks at or beyond the cap, so only ``cap - 1`` values are ranked; a
    group's ranks are one row, which is joined by the group's keys alone
    (``never_null``: see ``join_null_safe``).
    """
    keys = list(keys)
    cells = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    head = top_k(cells, keys, [value], cap - 1, "__i")
    before = Window.partitionBy(*keys).orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("__n").over(before), F.lit(0)) + (F.col("__n") + 1) / F.lit(2.0)
    ranked = head.select(*keys, F.struct(F.col(value).alias("v"), F.least(rank, F.lit(float(cap))).alias("r")).alias("__r"))
    ranks = ranked.groupBy(*keys).agg(F.collect_list("__r").alias("__ranks"))
    own = F.filter("__ranks", lambda x: x["v"].eqNullSafe(F.col(value)))
    return join_null_safe(df, ranks, keys, never_null).select(
        *df.columns, F.coalesce(F.get(own, F.lit(0))["r"], F.lit(float(cap))).alias(name)
    )
