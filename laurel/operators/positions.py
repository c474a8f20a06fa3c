"""Positional effects: where in a sorted contest the winner stands."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from laurel.schema import POSITION_CAP


def collated(df: DataFrame, order: Sequence[str | Column], collation: str | None) -> list[Column]:
    """Sort columns; those that are names of text columns sort by ``collation``, e.g. UNICODE, en or de_CI_AI.

    None keeps the order of bytes.  Expressions are taken as they are.
    """
    text = {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    columns = [(c, F.col(c)) if isinstance(c, str) else (None, c) for c in order]
    return [F.collate(column, collation) if collation and name in text else column for name, column in columns]


def _earlier_than_pick(df: DataFrame, keys: Sequence[str], pick: Column, order: Column, small: bool) -> DataFrame:
    """Per contest: rows, and rows whose ``order`` sorts before ``pick``.

    A position is one more than a count of smaller rows, so nothing is sorted:
    two partial aggregations and a join on the contest.  ``small`` contests take a
    window in place of the join, and rows that stand by contest are not moved.
    """
    keys = list(keys)
    rows = df.select(*keys, order.alias("__o"), "won", *[c for c in ("pos",) if c in df.columns])
    if small:
        known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])  # as in a join, null equals nothing
        picked = rows.withColumn("__pick", F.when(known, pick.over(Window.partitionBy(*keys))))
    else:
        picked = rows.join(rows.groupBy(*keys).agg(pick.alias("__pick")), keys, "left")
    return (
        picked.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.count(F.when(F.col("__o") < F.col("__pick"), 1)).alias("__before"),
            F.max(F.col("__pick").isNotNull()).alias("__has"),
        )
    )


def winner_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    cap: int = POSITION_CAP,
    name: str = "winner_pos",
    drop_no_winner: bool = False,
    collation: str | None = None,
    small: bool = False,
) -> DataFrame:
    """Position of the first winner in the sorted contest, capped; texts sort by ``collation``.

    A contest without winner counts as the cap unless ``drop_no_winner``.  ``small``: every contest
    fits a task, as one order's lines do.
    """
    first_winner = F.min(F.when(F.col("won") == 1, F.col("__o")))
    out = _earlier_than_pick(df, keys, first_winner, F.struct(*collated(df, order, collation)), small)
    if drop_no_winner:
        out = out.filter("__has")
    pos = F.when(F.col("__has"), F.least(F.col("__before") + 1, F.lit(cap))).otherwise(F.lit(cap))
    return out.select(*keys, pos.cast("int").alias(name))


def winner_position_folded(
    df: DataFrame, keys: Sequence[str], value: str, listing: Sequence[str], name: str = "winner_idx",
    collation: str | None = None, fold: bool = True,
) -> DataFrame:
    """0-based index of the first-listed nominee's value among the sorted values.

    Equal values share their first index; texts compare by ``collation``.  In contests of more than five the
    last index folds to 4 and the one before to 3 (unless ``fold`` is off); the others stay.
    """
    keys = list(keys)
    df = df.withColumn("__value", *collated(df, [value], collation))
    value = "__value"
    pick = F.min_by(F.col(value), F.struct(*listing))
    picks = df.groupBy(*keys).agg(pick.alias("__pick"))
    counted = (
        df.select(*keys, value)
        .join(picks, keys, "left")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(F.when(F.col(value) < F.col("__pick"), 1)).alias("i"),
        )
    )
    n, i = F.col("n"), F.col("i")
    folded = (
        F.when((n > 5) & (i == n - 1), 4).when((n > 5) & (i == n - 2), 3).otherwise(i)
    )
    folded = folded if fold else i
    return counted.select(*keys, folded.cast("int").alias(name))
