"""Driver tables reshaped into contests.

``nominations``    contest = (category, month); nominee = (person, work), won by
                   the highest revenue.  Acting categories name a person.
``shortlists``     contest = one order; nominee = one line of it.  Contests are
                   naturally small (1 to about 13 nominees).
``season_ratings`` per work and month: episodes, mean rating, mean votes.

Money is summed as whole cents (bigint): exact, order-independent and inside
code generation, unlike wide decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laurel.operators.groupwise import with_group_stats, with_position
from laurel.operators.enrich import combine_seasons
from laurel.operators.history import listing_order
from laurel.sources.staging import bucket_count, staged

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_number(date: str) -> Column:
    """Months since the end of 1994, as int."""
    return ((F.year(date) - 1995) * 12 + F.month(date)).cast("int")


def cents(amount: str) -> Column:
    return (F.col(amount) * 100 + 0.5).cast("bigint")


def cat_group(category: str = "category") -> Column:
    return F.when(F.col(category) < "4", "acting").otherwise("series")


def candidate_name() -> Column:
    """The work competes in series contests, the person elsewhere."""
    return F.when(F.col("cat_group") == "series", F.col("work")).otherwise(F.col("person"))


def _contest_buckets(spark: SparkSession, sf_dir: str) -> int:
    return bucket_count(spark, f"{sf_dir}/lineitem.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their part and order, dealt out by order in the end.

    Narrow lines meet their parts first, so that names travel once.  The small side is
    hashed and the order's join has partitions by the input's size: neither sorts much at a time.
    """
    n = _contest_buckets(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        month_number("o_orderdate").alias("period"),
        F.col("o_orderpriority").alias("category"),
    ).repartition(n, "l_orderkey")
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_name", F.col("p_brand").alias("work")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents("l_extendedprice").alias("cents")
    )
    person = F.when(F.col("category") < "4", F.col("p_name")).otherwise("")
    return (
        lines.join(part.hint("shuffle_hash"), "l_partkey")
        .repartition(n, "l_orderkey")
        .join(orders, "l_orderkey")
        .withColumn("person", person)
    )


SOURCES = ["lineitem", "orders", "part"]
NOMINEE_KEY = ["period", "category", "person", "work"]


def nominations(spark: SparkSession, sf_dir: str, tie_width: int | None = None) -> DataFrame:
    """All nominees of all contests; ``tie_width`` (currency) makes near-best nominees tie."""
    base = staged(
        spark, sf_dir, "nominations", SOURCES, lambda: _nominations(spark, sf_dir), spread=NOMINEE_KEY
    )
    if tie_width is None:
        return base.drop("cents")
    level = F.floor(F.col("cents") / (tie_width * 100))
    tied = with_group_stats(base, ["category", "period"], __best=F.max(level))
    return tied.withColumn("won", (level == F.col("__best")).cast("int")).drop("cents", "__best")


def _nominations(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = (
        _lines(spark, sf_dir)
        .groupBy("period", "category", "person", "work")
        .agg(F.sum("cents").alias("cents"))
    )
    base = with_group_stats(base, ["category", "period"], best=F.max("cents"))
    return (
        base.withColumn("cat_group", cat_group())
        .withColumn("candidate", candidate_name())
        .select(
            "period",
            "category",
            "cat_group",
            "person",
            "work",
            "candidate",
            (F.col("cents") / 100.0).alias("score"),
            (F.col("cents") == F.col("best")).cast("int").alias("won"),
            "cents",
        )
    )


def score_band() -> Column:
    """A non-decreasing bucket along descending score, to split big contests."""
    return -F.floor(F.log2("score") * 16)


def with_listing_pos(nominees: DataFrame) -> DataFrame:
    """1-based listing position in the contest, best score first."""
    return with_position(nominees, ["category", "period"], score_band(), listing_order())


def shortlists(spark: SparkSession, sf_dir: str, tie_width: int | None = None) -> DataFrame:
    """One contest per order, its lines as nominees; no aggregation, no cap.

    Staged in buckets of the contest, as position queries read it two to four times each.
    """
    buckets = (_contest_buckets(spark, sf_dir), "contest")
    base = staged(spark, sf_dir, "shortlists", SOURCES, lambda: _shortlists(spark, sf_dir), buckets=buckets)
    level = (lambda c: F.floor(F.col(c) / (tie_width * 100))) if tie_width else F.col  # the best has the highest level
    return (
        base.withColumn("cat_group", cat_group())
        .withColumn("candidate", candidate_name())
        .withColumn("won", (level("cents") == level("best")).cast("int"))
        .withColumn("score", F.col("cents") / 100.0)
        .drop("cents", "best")
    )


def _shortlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines stand together already: the window moves and sorts nothing."""
    lines = _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("contest"),
        "period",
        "category",
        "person",
        "work",
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supp_id"),
        "cents",
    )
    return lines.withColumn("best", F.max("cents").over(Window.partitionBy("contest")))


# Listing order of an order's lines; the price settles repeated line numbers.
LINE_KEY = ["line", "part_id", "supp_id", "score"]


def season_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated seasons, staged: one small row per (work, season, start)."""
    return staged(spark, sf_dir, "ratings", ["lineitem", "part"], lambda: _season_ratings(spark, sf_dir))


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings combined to one row per (work, season_start)."""
    return combine_seasons(season_ratings(spark, sf_dir))


def _season_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated seasons: all lines by brand and ship month, two sub-seasons each."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("work")
    )
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(part, "l_partkey")
        .withColumn("season_start", month_number("l_shipdate"))
        .withColumn(
            "season",
            (F.floor((F.col("season_start") - 1) / 12.0) * 2 + 1 + F.col("l_linenumber") % 2).cast(
                "int"
            ),
        )
    )
    return (
        lines.groupBy("work", "season", "season_start")
        .agg(
            F.count(F.lit(1)).alias("num_eps"),
            F.sum(cents("l_quantity")).alias("q"),
            F.sum(cents("l_extendedprice")).alias("v"),
        )
        .select(
            "work",
            "season",
            "season_start",
            "num_eps",
            (F.col("q") / 100.0 / F.col("num_eps") / 5.07).alias("av_rating"),
            (F.col("v") / 100.0 / F.col("num_eps")).alias("av_num_votes"),
        )
    )


def external_winners(nominees: DataFrame) -> DataFrame:
    """Another award's winner per contest: the best-scoring nominee that lost here."""
    losers = nominees.filter(F.col("won") == 0)
    pick = F.min_by(
        F.col("candidate"), F.struct(-F.col("score"), F.col("person"), F.col("work"))
    )
    return losers.groupBy("category", "period").agg(pick.alias("winner"))


def run_dates(nominees: DataFrame) -> DataFrame:
    """First and last period in which each work was nominated."""
    return nominees.groupBy("work").agg(
        F.min("period").alias("start"), F.max("period").alias("end")
    )
