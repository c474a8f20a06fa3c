"""Running history of every nominee: earlier nominations, wins and losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.operators.groupwise import with_running_totals
from laurel.schema import DEFAULT_WIN_RATE

ENTITY = ["cat_group", "entity", "scope"]


def listing_order() -> list[Column]:
    """Order of the nominees inside a contest: best score first."""
    return [F.col("score").desc(), F.col("person"), F.col("work")]


def with_entity(df: DataFrame, style: str = "candidate") -> DataFrame:
    """Add the history key.

    ``candidate``: a person across categories, a work inside one category.
    ``pair``: a (person, work) pair, a work across categories.
    The key is built before any grouping, so series rows never share one
    empty-person group.
    """
    series = F.col("cat_group") == "series"
    if style == "candidate":
        scope = F.when(series, F.col("category")).otherwise("")
    elif style == "pair":
        scope = F.when(series, "").otherwise(F.col("work"))
    else:
        raise ValueError(f"unknown entity style {style!r}")
    entity = F.when(series, F.col("work")).otherwise(F.col("person"))
    return df.withColumn("entity", entity).withColumn("scope", scope)


def with_history(
    df: DataFrame,
    style: str = "candidate",
    strict: bool = False,
    order: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Add ``prev_noms``, ``prev_wins`` and ``prev_losses``.

    Rows count in the order (period, category, ``order``), by default the listing order.  With ``strict``
    only earlier periods count.
    """
    keyed = with_entity(df, style)
    cell = ["period"] if strict else ["period", "category"]
    out = with_running_totals(
        keyed,
        ENTITY,
        cell,
        order or listing_order(),
        {"prev_noms": F.lit(1), "prev_wins": F.col("won")},
        strict=strict,
    )
    return with_losses(out.drop("entity", "scope"))


def with_losses(df: DataFrame) -> DataFrame:
    no_win_yet = F.when(F.col("prev_wins") == 0, F.col("prev_noms")).otherwise(F.lit(0))
    return df.withColumn("prev_losses", F.col("prev_noms") - F.col("prev_wins")).withColumn(
        "prev_noms_without_win", no_win_yet.cast("bigint")
    )


def with_win_rate(df: DataFrame, default: float = DEFAULT_WIN_RATE) -> DataFrame:
    rate = F.when(F.col("prev_noms") > 0, F.col("prev_wins") / F.col("prev_noms"))
    return df.withColumn("prev_win_rate", rate.otherwise(F.lit(default)))


def with_seeds(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """Add carry-in counts (category, entity, add_noms, add_wins), summed, to every row of the entity.

    Derived columns are refreshed; a seed win without a seed nomination may
    leave negative losses, which are kept.
    """
    carried = seeds.groupBy("category", F.col("entity").alias("candidate")).agg(
        F.sum("add_noms").alias("add_noms"), F.sum("add_wins").alias("add_wins")
    )
    keyed = df.join(carried, ["category", "candidate"], "left")
    out = keyed.withColumn(
        "prev_noms", F.col("prev_noms") + F.coalesce(F.col("add_noms"), F.lit(0))
    ).withColumn("prev_wins", F.col("prev_wins") + F.coalesce(F.col("add_wins"), F.lit(0)))
    return with_losses(out.drop("add_noms", "add_wins"))


def latest_state(history: DataFrame, entity: str = "candidate") -> DataFrame:
    """Last row per entity, rolled forward over that row's own result."""
    order = F.struct(
        "period", "category", -F.col("score"), "person", "work"
    )
    fields = F.struct("prev_noms", "prev_wins", "prev_losses", "won")
    # Inside a contest later listing means lower score, so the largest order struct is last.
    last = history.groupBy(entity).agg(F.max_by(fields, order).alias("s"))
    noms = F.col("s.prev_noms") + 1
    wins = F.col("s.prev_wins") + F.col("s.won")
    return last.select(
        entity,
        noms.alias("prev_noms"),
        wins.alias("prev_wins"),
        (F.col("s.prev_losses") + 1 - F.col("s.won")).alias("prev_losses"),
        F.when(wins == 0, noms).otherwise(F.lit(0)).cast("bigint").alias("prev_noms_without_win"),
    )


def attach_state(pending: DataFrame, state: DataFrame, entity: str = "candidate") -> DataFrame:
    """New nominees with their last known counts; unknown entities start at zero."""
    counts = [c for c in state.columns if c != entity]
    return pending.join(state, entity, "left").fillna(0, subset=counts)
