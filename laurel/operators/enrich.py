"""Lagged joins and contest flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.operators.groupwise import top_k, with_group_stats

CONTEST = ["category", "period"]


def combine_seasons(ratings: DataFrame) -> DataFrame:
    """One row per (work, season_start): first season, episode-weighted means, total episodes."""
    weight = F.sum("num_eps")
    return ratings.groupBy("work", "season_start").agg(
        F.min("season").alias("season"),
        F.bround(F.try_divide(F.sum(F.col("av_rating") * F.col("num_eps")), weight), 2).alias(
            "av_rating"
        ),
        F.bround(F.try_divide(F.sum(F.col("av_num_votes") * F.col("num_eps")), weight), 0).alias(
            "av_num_votes"
        ),
        weight.alias("num_eps"),
    )


def lag_join(
    df: DataFrame, dim: DataFrame, lag: int, columns: Sequence[str], suffix: str = ""
) -> DataFrame:
    """Left join ``dim`` on (work, period - lag = season_start); of several rows of a season the largest counts."""
    unique = dim.groupBy("work", "season_start").agg(F.max(F.struct(*columns)).alias("x"))
    side = unique.select(
        "work",
        (F.col("season_start") + lag).alias("period"),
        *[F.col(f"x.{c}").alias(c + suffix) for c in columns],
    )
    return df.join(side, ["work", "period"], "left")


def two_lags(recent: DataFrame, older: DataFrame | None = None) -> DataFrame:
    """Both lags of the rating table as one dimension keyed by (work, period).

    Stacking the lags first means the fact table is shuffled once, not twice.
    """
    older = recent if older is None else older
    value = F.struct("season", "av_rating", "av_num_votes")
    lag1 = recent.select("work", (F.col("season_start") + 1).alias("period"), F.lit(1).alias("lag"), value.alias("x"))
    lag2 = older.select("work", (F.col("season_start") + 2).alias("period"), F.lit(2).alias("lag"), value.alias("x"))
    stacked = lag1.unionByName(lag2)
    pick = lambda n: F.max(F.when(F.col("lag") == n, F.col("x")))
    return stacked.groupBy("work", "period").agg(pick(1).alias("x1"), pick(2).alias("x2"))


def mean_of_available(x: Column, y: Column) -> Column:
    """Mean of two nullable values; either one alone where the other is missing."""
    return (F.coalesce(x, y) + F.coalesce(y, x)) / 2


def with_lagged_ratings(df: DataFrame, recent: DataFrame, older: DataFrame | None = None) -> DataFrame:
    """Ratings of the two preceding periods, averaged over what is available."""
    joined = df.join(two_lags(recent, older), ["work", "period"], "left")
    x1, x2 = F.col("x1"), F.col("x2")
    return joined.select(
        *df.columns,
        mean_of_available(x1["av_rating"], x2["av_rating"]).alias("av_rating"),
        mean_of_available(x1["av_num_votes"], x2["av_num_votes"]).alias("av_num_votes"),
        F.coalesce(x2["season"], x1["season"]).alias("earlier_season"),
        F.coalesce(x1["season"], x2["season"]).alias("later_season"),
    )


def with_relative(
    df: DataFrame, value: str, name: str, exclude_self: bool = False, source: DataFrame | None = None
) -> DataFrame:
    """Value minus the contest mean (missing values skipped, own value included by default)."""
    out = with_group_stats(df, CONTEST, source, __s=F.sum(value), __n=F.count(value))
    if exclude_self:
        mean = F.try_divide(F.col("__s") - F.col(value), F.col("__n") - 1)
    else:
        mean = F.try_divide(F.col("__s"), F.col("__n"))
    return out.withColumn(name, F.col(value) - mean).drop("__s", "__n")


def with_also_nominated(df: DataFrame, nominees: DataFrame | None = None) -> DataFrame:
    """1/0 whether the person's work competes as a series in the same period; NULL for series.

    Here and below ``nominees`` is the plain nomination table (default: ``df``).
    """
    series = (
        (df if nominees is None else nominees).filter(F.col("cat_group") == "series")
        .select("period", "work")
        .distinct()
        .withColumn("__hit", F.lit(1))
    )
    flag = F.when(F.col("cat_group") == "acting", F.coalesce(F.col("__hit"), F.lit(0)))
    return (
        df.join(series, ["period", "work"], "left")
        .withColumn("also_nominated", flag.cast("int"))
        .drop("__hit")
    )


def with_period_noms(df: DataFrame, nominees: DataFrame | None = None) -> DataFrame:
    """Nominations of the row's work in its period."""
    return with_group_stats(df, ["period", "work"], nominees, total_noms=F.count(F.lit(1)))


def with_won_last_period(df: DataFrame, nominees: DataFrame | None = None) -> DataFrame:
    """Did this candidate win the same category one period earlier?  Never multiplies rows."""
    winners = (
        (df if nominees is None else nominees).filter(F.col("won") == 1)
        .select("category", (F.col("period") + 1).alias("period"), "candidate")
        .distinct()
        .withColumn("__hit", F.lit(True))
    )
    return (
        df.join(winners, ["category", "period", "candidate"], "left")
        .withColumn("won_last_period", F.col("__hit").isNotNull())
        .drop("__hit")
    )


def with_last_winner_rows(df: DataFrame) -> DataFrame:
    """Literal variant: one output row per winner of the previous period, flag by comparison."""
    winners = df.filter(F.col("won") == 1).select(
        "category", (F.col("period") + 1).alias("period"), F.col("candidate").alias("last_winner")
    )
    return df.join(winners, CONTEST, "left").withColumn(
        "won_last_period",
        F.coalesce(F.col("last_winner") == F.col("candidate"), F.lit(False)),
    )


def three_valued_or(left: Column, right: Column) -> Column:
    return F.coalesce(left | right, F.lit(False))


def with_external_win(df: DataFrame, external: DataFrame) -> DataFrame:
    """Did the work or the person win the other award one period earlier? Joint winners count each."""
    side = external.select("category", (F.col("period") + 1).alias("period"), "winner").distinct()

    def winners(column: str) -> DataFrame:
        return side.select(*CONTEST, F.col("winner").alias(column), F.lit(True).alias(f"__{column}"))

    return (
        df.join(winners("work"), [*CONTEST, "work"], "left")
        .join(winners("person"), [*CONTEST, "person"], "left")
        .select(*df.columns, three_valued_or(F.col("__work"), F.col("__person")).alias("won_external"))
    )


def exclude_contests_with(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Drop whole contests that contain a row meeting ``condition``."""
    return df.join(df.filter(condition).select(*keys).distinct(), list(keys), "left_anti")


def membership_flag(df: DataFrame, column: str, members: DataFrame, name: str) -> DataFrame:
    """1/0 whether ``column`` occurs among ``members`` (one column)."""
    side = members.select(F.col(members.columns[0]).alias(column)).distinct().withColumn("__m", F.lit(1))
    return df.join(side, column, "left").withColumn(
        name, F.coalesce(F.col("__m"), F.lit(0))
    ).drop("__m")


def resolve_ids(names: DataFrame, overrides: DataFrame, hits: DataFrame) -> DataFrame:
    """name -> id: the override if there is one, else the best-placed search hit.

    ``overrides`` (name, id); ``hits`` (name, id, place). Of several overrides the smallest id counts.
    """
    best = hits.groupBy("name").agg(F.min_by("id", F.struct("place", "id")).alias("hit_id"))
    fixed = overrides.groupBy("name").agg(F.min("id").alias("fixed_id"))
    return (
        names.join(fixed, "name", "left")
        .join(best, "name", "left")
        .withColumn("id", F.coalesce("fixed_id", "hit_id"))
        .drop("fixed_id", "hit_id")
    )


def apply_corrections(df: DataFrame, corrections: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Overwrite ``column`` for the rows listed in ``corrections`` (keys + column); of several the largest counts."""
    side = corrections.groupBy(*keys).agg(F.max(column).alias("__fix"))
    return (
        df.join(side, list(keys), "left")
        .withColumn(column, F.coalesce(F.col("__fix"), F.col(column)))
        .drop("__fix")
    )


def with_first_in_group_winner(df: DataFrame, keys: Sequence[str], name: str, order: Column) -> DataFrame:
    """The first non-null ``name`` of each group wins; every row bearing it is flagged."""
    first = (
        df.filter(F.col(name).isNotNull())
        .groupBy(*keys)
        .agg(F.min_by(F.col(name), order).alias(name))
        .withColumn("__w", F.lit(1))
    )
    return (
        df.join(first, [*keys, name], "left")
        .withColumn("won_by_order", F.coalesce(F.col("__w"), F.lit(0)))
        .drop("__w")
    )


def with_listed_winners(
    df: DataFrame,
    nominees: DataFrame,
    overrides: DataFrame,
    keys: Sequence[str],
    row_key: Sequence[str],
    order: Sequence[str | Column],
) -> DataFrame:
    """The first k listed nominees win, k from ``overrides`` (keys + k), default 1.

    Only the largest k of the overrides is ever ranked, not whole contests.
    """
    most = overrides.agg(F.max("k")).first()[0] or 1
    head = top_k(nominees, keys, order, max(int(most), 1), "__pos").join(overrides, list(keys), "left")
    winners = head.filter(F.col("__pos") <= F.coalesce(F.col("k"), F.lit(1)))
    on = list(dict.fromkeys([*keys, *row_key]))
    flagged = winners.select(*on, F.lit(1).alias("won_listed"))
    return df.join(flagged, on, "left").fillna(0, subset=["won_listed"])
