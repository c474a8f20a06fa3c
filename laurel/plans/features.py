"""The feature table: history, lagged ratings and contest flags in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions.text import name_length, surname
from laurel.models import glm
from laurel.operators import enrich
from laurel.operators.groupwise import with_first_rank_capped
from laurel.operators.history import listing_order, with_history
from laurel.schema import CONTEST, POSITION_CAP
from laurel.sources import tables
from laurel.sources.staging import staged

ROW_KEY = ["period", "category", "person", "work"]


def lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominations with history and the ratings of the two preceding periods."""
    history = with_history(tables.nominations(spark, sf_dir))
    return enrich.with_lagged_ratings(history, tables.seasons(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of all nominees.

    Every flag's dimension is derived from the nomination table itself, not
    from the growing pipeline, so the plan grows linearly with the flags.
    """
    nominees = tables.nominations(spark, sf_dir)
    rated = enrich.with_lagged_ratings(nominees, tables.seasons(spark, sf_dir))
    out = lagged(spark, sf_dir)
    out = enrich.with_relative(out, "av_rating", "rel_rating", source=rated)
    out = enrich.with_also_nominated(out, nominees)
    out = enrich.with_period_noms(out, nominees)
    out = enrich.with_won_last_period(out, nominees)
    return enrich.with_external_win(out, tables.external_winners(nominees))


def with_names(df: DataFrame) -> DataFrame:
    return df.withColumn("surname", surname("person")).withColumn("name_len", name_length("candidate"))


def with_capped_positions(df: DataFrame, nominees: DataFrame | None = None) -> DataFrame:
    """First-rank positions by surname and by name length inside the contest."""
    named = with_names(df if nominees is None else nominees)
    row = ["person", "work"]
    out = df
    for key, name in (("surname", "alph_pos"), ("name_len", "name_length_pos")):
        order = [key, *listing_order()]
        out = with_first_rank_capped(out, CONTEST, order, row, POSITION_CAP, name, source=named)
    return out


def modelling_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-winner contests with positions, indicators and imputed ratings.

    Staged, because fits pass over it once per iteration.
    """

    def build() -> DataFrame:
        nominees = tables.nominations(spark, sf_dir)
        single = glm.single_winner_contests(features(spark, sf_dir), source=nominees)
        return glm.with_indicators(glm.impute(with_capped_positions(single, nominees)))

    return staged(spark, sf_dir, "modelling", tables.SOURCES, build, spread=ROW_KEY)
