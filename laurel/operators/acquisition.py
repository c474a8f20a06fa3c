"""From raw episode and listing records to season and nomination rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPISODES = "work string, seasons map<int, map<int, struct<rating: double, votes: int, year: int>>>"


def flag_quality(episodes: DataFrame, low: float = 1, high: float = 10) -> DataFrame:
    """Mark strange ratings; the rows are kept."""
    return episodes.withColumn("strange", ~F.col("rating").between(low, high))


def explode_episodes(nested: DataFrame) -> DataFrame:
    """Nested season -> episode maps to rows (work, season, episode, rating, votes, year)."""
    seasons = nested.select("work", F.explode("seasons").alias("season", "eps"))
    return seasons.select("work", "season", F.explode("eps").alias("episode", "e")).select(
        "work", "season", "episode", "e.rating", "e.votes", "e.year"
    )


def season_from_episodes(episodes: DataFrame) -> DataFrame:
    """Per (work, season >= 1): start year, rated episodes, mean rating and votes.

    Only episodes with rating, votes and year count.  The start is the first
    episode's year, or the earliest known one where that is missing.
    """
    complete = F.col("rating").isNotNull() & F.col("votes").isNotNull() & F.col("year").isNotNull()
    rated = F.when(complete, F.col("rating"))
    votes = F.when(complete, F.col("votes"))
    first_year = F.min_by("year", "episode")
    return (
        episodes.filter(F.col("season") >= 1)
        .groupBy("work", "season")
        .agg(
            F.coalesce(first_year, F.min("year")).alias("season_start"),
            F.count(rated).alias("num_eps"),
            F.bround(F.avg(rated), 2).alias("av_rating"),
            F.bround(F.avg(votes), 0).alias("av_num_votes"),
        )
        .filter(F.col("num_eps") > 0)
    )
