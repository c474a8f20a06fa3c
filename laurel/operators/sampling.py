"""Reproducible shuffles and splits from hashes of row keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.operators.groupwise import with_position, with_running_totals, with_group_stats


def row_hash(keys: Sequence[str], seed: int | Column) -> Column:
    """Hash of the key columns and a seed, which may be a column (one seed for each repeat)."""
    last = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", *keys, last))


def slot_numbers(
    df: DataFrame, contest: Sequence[str], row_key: Sequence[str], seed: int = 0, ties: Sequence[str] = (), small: bool = False
) -> DataFrame:
    """1..n inside each contest in hash order; the hash prefix splits big contests, ``small`` ones are ranked whole."""
    hashed = df.withColumn("__h", row_hash([*contest, *row_key], seed))
    if small:
        place = F.row_number().over(Window.partitionBy(*contest).orderBy("__h", *row_key, *ties))
        return hashed.withColumn("slot", place.cast("bigint")).drop("__h")
    return with_position(
        hashed, contest, F.substring("__h", 1, 2), ["__h", *row_key, *ties], "slot"
    ).drop("__h")


def hash_fraction(keys: Sequence[str], seed: int) -> Column:
    """Uniform [0, 1) value from the first 8 hex digits of the row hash."""
    return F.conv(F.substring(row_hash(keys, seed), 1, 8), 16, 10).cast("double") / float(16**8)


def holdout_split(df: DataFrame, keys: Sequence[str], repeat: int, fraction: float = 0.75) -> DataFrame:
    """Boolean ``train`` per row: hash fraction below ``fraction``.

    Keeps the label mix in expectation and needs no shuffle.
    """
    return df.withColumn("train", hash_fraction(keys, repeat) < fraction)


def stratified_split(
    df: DataFrame, labels: Sequence[str], keys: Sequence[str], repeat: int | Column, fraction: float = 0.75
) -> DataFrame:
    """Exact split: the first ``fraction`` of each stratum's rows (columns ``labels``) in hash order train.

    The rank is a running count over hash prefixes, so a label with most of the
    rows is still ranked by many tasks.
    """
    hashed = df.withColumn("__h", row_hash(keys, repeat)).withColumn(
        "__p", F.substring("__h", 1, 3)
    )
    ranked = with_running_totals(hashed, labels, ["__p"], ["__h", *keys], {"__i": F.lit(1)})
    sized = with_group_stats(ranked, labels, __n=F.count(F.lit(1)))
    share = F.when(F.col("__n") > 1, F.col("__i") / (F.col("__n") - 1)).otherwise(F.lit(0.0))
    return sized.withColumn("train", share < fraction).drop("__h", "__p", "__i", "__n")
