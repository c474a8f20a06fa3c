"""Win fractions, counts and shares by any grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.operators.groupwise import with_group_stats


def win_fraction(
    df: DataFrame,
    keys: Sequence[str | Column],
    min_n: int = 0,
    measure: str | Column = "won",
    name: str = "win_frac",
) -> DataFrame:
    """Rows and mean of ``measure`` per group, groups below ``min_n`` rows left out.

    Flags and counts are averaged as exact integer sums.
    """
    value = F.col(measure) if isinstance(measure, str) else measure
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.try_divide(F.sum(value), F.count(value)), 6).alias(name),
    )
    return out.filter(F.col("n") >= min_n) if min_n else out


def fraction_true(condition: Column) -> Column:
    """Share of rows where the predicate holds; missing values are skipped."""
    return F.round(F.avg(condition.cast("int")), 6)


def count_by(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def with_share(counts: DataFrame, value: str = "n", name: str = "share") -> DataFrame:
    """Value over its total; meant for the small aggregated table."""
    total = counts.agg(F.sum(value).cast("double")).scalar()
    return counts.withColumn(name, F.round(F.try_divide(F.col(value), total), 6))


def prior_wins_bucket(column: str = "prev_wins") -> Column:
    return F.when(F.col(column) >= 2, "2+").otherwise(F.col(column).cast("string"))


def prior_noms_label() -> Column:
    """No / Yes; won last year / Yes; didn't win last year."""
    return (
        F.when(F.col("prev_noms") == 0, "No")
        .when(F.col("won_last_period"), "Yes; won last year")
        .otherwise("Yes; didn't win last year")
    )


def extremes_vs_winner(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per winner: its value next to the contest's smallest and largest; none without winner."""
    out = with_group_stats(df, keys, min_value=F.min(value), max_value=F.max(value))
    return out.filter(F.col("won") == 1).select(
        *keys, "min_value", "max_value", F.col(value).alias("winner_value")
    )


def two_level_summary(extremes: DataFrame, by: str) -> DataFrame:
    v = F.col("winner_value")
    return extremes.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        fraction_true(v == F.col("min_value")).alias("frac_fewest"),
        fraction_true(v == 0).alias("frac_zero"),
        fraction_true(v == F.col("max_value")).alias("frac_most"),
    )


def dense_spine(spark: SparkSession, last: int, name: str, first: int = 0) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").alias(name))


def spine_of(found: DataFrame, key: str, first: int | None = 0, groups: Sequence[str] = ()) -> DataFrame:
    """Every bin from ``first`` (None: the least found) to the largest found, for each group of ``found``.

    A negative bin below ``first`` is never lost: the spine then begins there.
    """
    least = F.min(key) if first is None else F.least(F.min(key), F.lit(first))
    ends = found.groupBy(*groups).agg(least.alias("__first"), F.max(key).alias("__last")).filter("__last is not null")
    bins = F.sequence(F.col("__first").cast("bigint"), F.greatest("__first", "__last").cast("bigint"))
    return ends.select(*groups, F.explode(bins).alias(key))


def dense_win_fraction(
    df: DataFrame, key: str, first: int | None = 0, won: str | Column = "won"
) -> DataFrame:
    """Wins and totals for every bin from ``first`` to the largest found; an empty bin has no fraction.

    Rows without a bin (null key) are not counted.
    """
    flag = F.col(won) if isinstance(won, str) else won
    found = (
        df.groupBy(F.col(key).cast("bigint").alias(key))
        .agg(F.sum(flag.cast("bigint")).alias("w"), F.count(F.lit(1)).alias("t"))
    )
    spine = spine_of(found, key, first)
    wins, total = F.coalesce("w", F.lit(0)), F.coalesce("t", F.lit(0))
    return spine.join(found, key, "left").select(
        key,
        wins.alias("num_wins"),
        total.alias("num_tot"),
        F.round(F.try_divide(wins, total), 6).alias("win_frac"),
    )


def by_run_point(df: DataFrame, won: str | Column = "won") -> DataFrame:
    """Win fraction by position inside the work's run, rounded to tenths.

    Points beyond 1 are dropped and only points with a loss are reported.
    """
    flag = F.col(won) if isinstance(won, str) else won
    point = (F.col("period") - F.col("start")) / (F.col("end") - F.col("start") + 1)
    rows = df.withColumn("raw_point", point).filter(F.col("raw_point") <= 1)
    out = rows.groupBy(F.round("raw_point", 1).alias("run_point")).agg(
        F.sum(flag.cast("bigint")).alias("num_wins"),
        F.sum(1 - flag.cast("bigint")).alias("num_losses"),
    )
    total = F.col("num_wins") + F.col("num_losses")
    return out.filter(F.col("num_losses") > 0).withColumn(
        "win_frac", F.round(F.col("num_wins") / total, 6)
    )


def zero_filled_keys(left: DataFrame, right: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Union of the keys of two count tables, missing counts as zero."""
    return left.join(right, key, "full").fillna(0, subset=list(values))


def pivot_contest_wide(slotted: DataFrame, keys: Sequence[str], features: Sequence[str], slots: int) -> DataFrame:
    """Nominees in slots 1..n to columns; label = the winning slot."""
    wide = slotted.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("slot") == s, F.col(f))).alias(f"{f}_{s}")
            for f in features
            for s in range(1, slots + 1)
        ],
        F.max(F.when(F.col("won") == 1, F.col("slot"))).alias("winning_slot"),
    )
    return wide


