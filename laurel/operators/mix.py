"""Run lengths, and the season mix they lead one to expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laurel.operators.cohorts import dense_spine, spine_of


def entity_extent(ratings: DataFrame) -> DataFrame:
    """First start and highest season of each work."""
    return ratings.groupBy("work").agg(
        F.min("season_start").alias("first_start"), F.max("season").cast("bigint").alias("length")
    )


def threshold_counts(lengths: DataFrame, last: int, column: str = "length") -> DataFrame:
    """For i in 1..last the number of rows with length >= i.

    A histogram folded at ``last`` (at most ``last`` rows) is summed from above,
    instead of a theta join of every row with every threshold.
    """
    folded = (
        lengths.filter(F.col(column) >= 1)
        .groupBy(F.least(F.col(column), F.lit(last)).cast("bigint").alias("i"))
        .agg(F.count(F.lit(1)).alias("f"))
    )
    spine = dense_spine(lengths.sparkSession, last, "i", 1)
    above = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(folded, "i", "left").select(
        F.col("i").alias("season"),
        F.sum(F.coalesce("f", F.lit(0))).over(above).alias("num_cases"),
    )


def expected_season_mix(ratings: DataFrame, last: int = 10, started_by: int | None = None) -> DataFrame:
    """Cases per season 1..last if every work ran its length, and their shares."""
    extent = entity_extent(ratings)
    if started_by is not None:
        extent = extent.filter(F.col("first_start") <= started_by)
    counts = threshold_counts(extent, last)
    everything = Window.partitionBy()  # ``last`` rows
    share = F.try_divide(F.col("num_cases"), F.sum("num_cases").over(everything))
    return counts.withColumn("frac_expected", F.round(share, 6))


def expected_wins(run_lengths: DataFrame, total_wins: DataFrame, last: int | None = None) -> DataFrame:
    """Expected wins per season of life, from run lengths (column ``length``).

    weight(s) = sum over lengths L >= s of share(L) / L, normalised over
    seasons 1..last (None: the longest length) and scaled by the total wins
    (one-row table, ``wins``). Shares are of all works, also of those longer
    than ``last``.
    """
    hist = run_lengths.groupBy("length").agg(F.count(F.lit(1)).alias("f"))
    # Histogram rows and one-row totals only below this line.
    everything = Window.partitionBy()
    hist = hist.withColumn("share", F.col("f") / F.sum("f").over(everything))
    hist = hist.filter("length >= 1")
    if last is None:
        spine = spine_of(hist.select(F.col("length").cast("bigint").alias("season")), "season", 1)
    else:
        hist = hist.filter(F.col("length") <= last)
        spine = dense_spine(run_lengths.sparkSession, last, "season", 1)
    above = Window.orderBy(F.col("season").desc()).rowsBetween(Window.unboundedPreceding, 0)
    weights = spine.join(hist, spine["season"] == hist["length"], "left").select(
        "season",
        F.sum(F.coalesce(F.col("share") / F.col("length"), F.lit(0.0))).over(above).alias("w"),
    )
    share = F.try_divide(F.col("w"), F.sum("w").over(everything))
    scaled = weights.select("season", share.alias("frac"))
    wins = total_wins.select("wins").scalar()
    return scaled.select("season", (F.col("frac") * wins).alias("exp_wins"))


def histogram_fixed_width(df: DataFrame, value: str, width: float, facets: list[str]) -> DataFrame:
    """Counts in bins centred on multiples of ``width``."""
    bin_no = F.floor((F.col(value) + width / 2) / width).alias("bin")
    return (
        df.filter(F.col(value).isNotNull()).groupBy(*facets, bin_no).agg(F.count(F.lit(1)).alias("n"))
    )
