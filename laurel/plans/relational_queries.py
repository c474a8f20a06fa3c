"""Projections, filters, joins, set operations, sorting and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions import recode as R
from laurel.functions import text
from laurel.operators import acquisition, cohorts, enrich, mix, sampling
from laurel.operators.groupwise import top_k, with_first_rank_capped
from laurel.operators.history import attach_state, latest_state, listing_order, with_history
from laurel.models import glm
from laurel.plans.features import lagged
from laurel.plans.registry import query
from laurel.schema import CONTEST
from laurel.sources import files, tables

# Display labels of the driver's categories.
LABELS = {"4-NOT SPECIFIED": "Series Drama", "5-LOW": "Series Comedy"}

ROW = "period, category, person, work"


def _row(df: DataFrame, *more) -> DataFrame:
    return df.select("period", "category", "person", "work", *more)


@query(
    "recode_values",
    f"""SELECT {ROW}, CASE category WHEN '4-NOT SPECIFIED' THEN 'Series Drama' WHEN '5-LOW' THEN 'Series Comedy'
        ELSE category END AS label FROM t_noms""",
)
def recode_values(spark: SparkSession, d: str) -> DataFrame:
    return _row(tables.nominations(spark, d), R.recode("category", LABELS).alias("label"))


@query(
    "flag_to_label",
    f"SELECT {ROW}, CASE won WHEN 1 THEN 'Won' ELSE 'Lost' END AS result, "
    "CASE WHEN prev_noms = 0 THEN 'Yes' ELSE 'No' END AS first_nom FROM t_hist",
)
def flag_to_label(spark: SparkSession, d: str) -> DataFrame:
    hist = with_history(tables.nominations(spark, d))
    return _row(hist, R.won_label().alias("result"), R.yes_no(F.col("prev_noms") == 0).alias("first_nom"))


@query(
    "group_by_pattern",
    """SELECT o_orderkey AS contest, CASE WHEN o_orderpriority LIKE '4%' OR o_orderpriority LIKE '5%' THEN 'series'
       ELSE 'acting' END AS by_pattern,
       CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'series' ELSE 'acting' END AS by_list FROM orders""",
)
def group_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_orderpriority")
    return tables.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("contest"),
        F.when(c.rlike("^[45]-"), "series").otherwise("acting").alias("by_pattern"),
        F.when(c.isin(*LABELS), "series").otherwise("acting").alias("by_list"),
    )


@query("candidate_name", f"SELECT {ROW}, cat_group, candidate FROM t_noms")
def candidate_name(spark: SparkSession, d: str) -> DataFrame:
    return _row(tables.nominations(spark, d), "cat_group", tables.candidate_name().alias("candidate"))


@query(
    "shift_period",
    """SELECT o_orderkey AS contest, CAST(year(o_orderdate) AS INT) AS year,
              CAST(year(o_orderdate) - 1 AS INT) AS minus1, CAST(year(o_orderdate) - 2 AS INT) AS minus2,
              CAST(year(o_orderdate) + 1 AS INT) AS ceremony FROM orders""",
)
def shift_period(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(F.year("o_orderdate").cast("string"), F.lit("-season"))
    y = F.year("o_orderdate")
    return tables.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("contest"),
        y.alias("year"),
        (y - 1).alias("minus1"),
        (y - 2).alias("minus2"),
        (F.substring(label, 1, 4).cast("int") + 1).alias("ceremony"),
    )


@query(
    "filter_rows",
    f"""SELECT {ROW}, won FROM t_hist WHERE category IN ('1-URGENT', '5-LOW') AND prev_noms BETWEEN 1 AND 20
        AND person IS NOT NULL AND (won = 1 OR prev_wins >= 1)""",
)
def filter_rows(spark: SparkSession, d: str) -> DataFrame:
    hist = with_history(tables.nominations(spark, d))
    return _row(
        hist.filter(
            F.col("category").isin("1-URGENT", "5-LOW")
            & F.col("prev_noms").between(1, 20)
            & F.col("person").isNotNull()
            & ((F.col("won") == 1) | (F.col("prev_wins") >= 1))
        ),
        "won",
    )


@query(
    "apply_corrections",
    f"""SELECT {ROW}, CAST(CASE WHEN r = 2 AND winner_work = work THEN 1 ELSE won END AS INT) AS won FROM (
          SELECT *, row_number() OVER (PARTITION BY period, category ORDER BY score DESC, person, work) AS r,
                 first_value(work) OVER (PARTITION BY period, category ORDER BY score DESC, person, work) AS winner_work
          FROM t_noms)""",
)
def apply_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Joint winners: the runner-up is a winner too when it shares the winner's work."""
    noms = tables.nominations(spark, d)
    first_two = top_k(noms, ["period", "category"], listing_order(), 2, "r")
    second = first_two.filter("r = 2").select("period", "category", "person", "work")
    first = first_two.filter("r = 1").select("period", "category", F.col("work").alias("ww"))
    joint = second.join(first, ["period", "category"]).filter(F.col("ww") == F.col("work"))
    corrections = joint.select("period", "category", "person", "work", F.lit(1).alias("won"))
    keys = ["period", "category", "person", "work"]
    return _row(enrich.apply_corrections(noms, corrections, keys, "won"), "won")


@query(
    "select_rename_drop",
    "SELECT o_orderkey AS contest, o_orderpriority AS category, o_custkey AS voter FROM orders",
)
def select_rename_drop(spark: SparkSession, d: str) -> DataFrame:
    return (
        tables.table(spark, d, "orders")
        .drop("o_totalprice", "o_orderdate", "o_orderstatus")
        .withColumnsRenamed({"o_orderkey": "contest", "o_orderpriority": "category", "o_custkey": "voter"})
        .select("contest", "category", "voter")
    )


@query(
    "impute_constant",
    f"SELECT {ROW}, round(coalesce(av_rating, 7.9), 6) AS av_rating, round(coalesce(av_num_votes, 0), 6) AS av_num_votes FROM t_lagged",
)
def impute_constant(spark: SparkSession, d: str) -> DataFrame:
    out = lagged(spark, d).fillna({"av_rating": 7.9, "av_num_votes": 0.0})
    return _row(out, F.round("av_rating", 6).alias("av_rating"), F.round("av_num_votes", 6).alias("av_num_votes"))


@query(
    "mean_of_available",
    """SELECT coalesce(x.work, y.work) AS work, coalesce(x.season_start + 1, y.season_start + 2) AS period,
       round((coalesce(x.av_rating, y.av_rating) + coalesce(y.av_rating, x.av_rating)) / 2, 6) AS av_rating
       FROM t_seasons x FULL JOIN t_seasons y ON x.work = y.work AND x.season_start + 1 = y.season_start + 2""",
)
def mean_of_available(spark: SparkSession, d: str) -> DataFrame:
    pairs = enrich.two_lags(tables.seasons(spark, d))
    mean = enrich.mean_of_available(F.col("x1.av_rating"), F.col("x2.av_rating"))
    return pairs.select("work", "period", F.round(mean, 6).alias("av_rating"))


@query(
    "prefer_first_available",
    f"SELECT {ROW}, earlier_season, later_season FROM t_lagged",
)
def prefer_first_available(spark: SparkSession, d: str) -> DataFrame:
    return _row(lagged(spark, d), "earlier_season", "later_season")


@query(
    "three_valued_or",
    f"""SELECT n.period, n.category, n.person, n.work, coalesce(e.winner = n.work OR e.winner = n.person, false) AS won_external
        FROM t_noms n LEFT JOIN t_external e ON n.category = e.category AND n.period = e.period + 1""",
)
def three_valued_or(spark: SparkSession, d: str) -> DataFrame:
    noms = tables.nominations(spark, d)
    return _row(enrich.with_external_win(noms, tables.external_winners(noms)), "won_external")


# Coefficients for the scoring examples.
ACTING_COEFS = {"(Intercept)": -1.2, "later_season": -0.08, "prev_wins": 0.1, "prev_noms": -0.02}
SERIES_COEFS = {"(Intercept)": -0.9, "later_season": -0.15, "prev_wins": 0.2, "prev_noms": -0.05}
_SCORE = """1 / (1 + exp(-(CASE WHEN cat_group = 'acting'
    THEN -1.2 - 0.08 * later_season + 0.1 * prev_wins - 0.02 * prev_noms
    ELSE -0.9 - 0.15 * later_season + 0.2 * prev_wins - 0.05 * prev_noms END)))"""


@query("split_model_column", f"SELECT {ROW}, cat_group, round({_SCORE}, 6) AS score_raw FROM t_lagged")
def split_model_column(spark: SparkSession, d: str) -> DataFrame:
    scored = glm.score_by_group(lagged(spark, d), ACTING_COEFS, SERIES_COEFS)
    return _row(scored, "cat_group", F.round("score_raw", 6).alias("score_raw"))


@query(
    "add_reference_lines",
    """SELECT prev_wins, num_wins, num_tot, 0.2::DOUBLE AS avg_line, 0.29::DOUBLE AS upper, 0.12::DOUBLE AS lower,
       CASE WHEN prev_wins = (SELECT min(prev_wins) FROM t_hist) THEN 0.5
            WHEN prev_wins = (SELECT max(prev_wins) FROM t_hist) THEN 7.5 ELSE 1.0 END::DOUBLE AS x2,
       num_wins || '_' || num_tot AS identifier
       FROM (SELECT prev_wins, CAST(sum(won) AS BIGINT) AS num_wins, count(*) AS num_tot FROM t_hist GROUP BY 1)""",
)
def add_reference_lines(spark: SparkSession, d: str) -> DataFrame:
    hist = with_history(tables.nominations(spark, d))
    bars = hist.groupBy("prev_wins").agg(
        F.sum("won").alias("num_wins"), F.count(F.lit(1)).alias("num_tot")
    )
    first, last = bars.agg(F.min("prev_wins")).scalar(), bars.agg(F.max("prev_wins")).scalar()
    x2 = (
        F.when(F.col("prev_wins") == first, 0.5)
        .when(F.col("prev_wins") == last, 7.5)
        .otherwise(1.0)
    )
    return bars.select(
        "prev_wins", "num_wins", "num_tot", F.lit(0.2).alias("avg_line"), F.lit(0.29).alias("upper"),
        F.lit(0.12).alias("lower"), x2.alias("x2"), F.concat_ws("_", "num_wins", "num_tot").alias("identifier"),
    )


@query(
    "logit_relative_effect",
    f"SELECT {ROW}, round(1 / (1 + exp(1.38 - (won - 0.02 * prev_noms))) - 1 / (1 + exp(1.38)), 6) AS effect FROM t_hist",
)
def logit_relative_effect(spark: SparkSession, d: str) -> DataFrame:
    hist = with_history(tables.nominations(spark, d))
    coef = F.col("won") - F.col("prev_noms") * 0.02
    return _row(hist, F.round(R.relative_effect(coef), 6).alias("effect"))


@query(
    "format_display",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN abs(x) >= 0.01 THEN format('{:+.3f}', x) ELSE '~' END AS effect,
       format('{:d}%', CAST(l_discount * 100 + 0.5 - 1e-9 AS INT)) AS pct,
       l_returnflag || ': ' || l_linestatus AS label
       FROM (SELECT *, l_discount - l_tax AS x FROM lineitem)""",
)
def format_display(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        text.signed_or_tilde(F.col("l_discount") - F.col("l_tax")).alias("effect"),
        text.percent(F.col("l_discount")).alias("pct"),
        F.format_string("%s: %s", "l_returnflag", "l_linestatus").alias("label"),
    )


@query(
    "indicator_terms",
    f"""SELECT {ROW}, prev_wins = 1 AS one_prev_win, pos IN (1, 5) AS pos_1or5, pos IN (2, 3, 4) AS pos_234 FROM (
          SELECT *, row_number() OVER (PARTITION BY period, category ORDER BY score DESC, person, work) AS pos FROM t_hist)""",
)
def indicator_terms(spark: SparkSession, d: str) -> DataFrame:
    noms = tables.nominations(spark, d)
    listed = with_first_rank_capped(
        with_history(noms), CONTEST, listing_order(), ["person", "work"], 6, "pos", source=noms
    )
    return _row(
        listed,
        (F.col("prev_wins") == 1).alias("one_prev_win"),
        F.col("pos").isin(1, 5).alias("pos_1or5"),
        F.col("pos").isin(2, 3, 4).alias("pos_234"),
    )


@query(
    "quality_flag",
    "SELECT event_id, value / 10 AS rating, NOT (value / 10 BETWEEN 1 AND 10) AS strange FROM events",
)
def quality_flag(spark: SparkSession, d: str) -> DataFrame:
    episodes = tables.table(spark, d, "events").select("event_id", (F.col("value") / 10).alias("rating"))
    return acquisition.flag_quality(episodes)


# ---- joins ---------------------------------------------------------------


@query(
    "join_lag1_ratings",
    """SELECT n.period, n.category, n.person, n.work, s.season, round(s.av_rating, 6) AS av_rating FROM t_noms n
       LEFT JOIN t_seasons s ON n.work = s.work AND n.period - 1 = s.season_start""",
)
def join_lag1_ratings(spark: SparkSession, d: str) -> DataFrame:
    seasons = tables.seasons(spark, d)
    out = enrich.lag_join(tables.nominations(spark, d), seasons, 1, ["season", "av_rating"])
    return _row(out, "season", F.round("av_rating", 6).alias("av_rating"))


@query(
    "join_two_lags",
    f"""SELECT {ROW}, round(av_rating, 6) AS av_rating, round(av_num_votes, 6) AS av_num_votes,
        earlier_season, later_season FROM t_lagged""",
)
def join_two_lags(spark: SparkSession, d: str) -> DataFrame:
    return _row(
        lagged(spark, d), F.round("av_rating", 6).alias("av_rating"),
        F.round("av_num_votes", 6).alias("av_num_votes"), "earlier_season", "later_season",
    )


@query("also_nominated_flag", f"SELECT {ROW}, also_nominated FROM t_feat")
def also_nominated_flag(spark: SparkSession, d: str) -> DataFrame:
    return _row(enrich.with_also_nominated(tables.nominations(spark, d)), "also_nominated")


_LAST_WINNERS = """LEFT JOIN (SELECT DISTINCT category, period + 1 AS period, candidate FROM t_ties WHERE won = 1) w
 ON n.category = w.category AND n.period = w.period AND n.candidate = w.candidate"""


@query(
    "won_last_period",
    f"SELECT n.period, n.category, n.person, n.work, w.candidate IS NOT NULL AS won_last_period FROM t_ties n {_LAST_WINNERS}",
)
def won_last_period(spark: SparkSession, d: str) -> DataFrame:
    return _row(enrich.with_won_last_period(tables.nominations(spark, d, 50000)), "won_last_period")


@query(
    "won_last_period_fanout",
    """SELECT n.period, n.category, n.person, n.work, w.candidate AS last_winner, coalesce(w.candidate = n.candidate, false) AS won_last_period
       FROM t_noms n LEFT JOIN (SELECT category, period + 1 AS period, candidate FROM t_noms WHERE won = 1) w
       ON n.category = w.category AND n.period = w.period""",
)
def won_last_period_fanout(spark: SparkSession, d: str) -> DataFrame:
    return _row(enrich.with_last_winner_rows(tables.nominations(spark, d)), "last_winner", "won_last_period")


@query(
    "external_prev_winner",
    """SELECT n.period, n.category, n.person, n.work, e.winner FROM t_noms n
       LEFT JOIN t_external e ON n.category = e.category AND n.period - 1 = e.period""",
)
def external_prev_winner(spark: SparkSession, d: str) -> DataFrame:
    noms = tables.nominations(spark, d)
    side = tables.external_winners(noms).withColumn("period", F.col("period") + 1)
    return _row(noms.join(side, ["category", "period"], "left"), "winner")


@query(
    "winner_vs_top_pick",
    """SELECT category, period, candidate AS winner, p AS pred_winner, round(s, 6) AS pred FROM (
         SELECT *, sum(won) OVER c AS n_won, first_value(candidate) OVER o AS p, first_value(prev_wins + 0.5::DOUBLE * prev_noms) OVER o AS s
         FROM t_hist WINDOW c AS (PARTITION BY period, category),
         o AS (PARTITION BY period, category ORDER BY prev_wins + 0.5::DOUBLE * prev_noms DESC, person, work))
       WHERE n_won = 1 AND won = 1""",
)
def winner_vs_top_pick(spark: SparkSession, d: str) -> DataFrame:
    hist = with_history(tables.nominations(spark, d))
    scored = hist.withColumn("s", F.col("prev_wins") + F.col("prev_noms") * 0.5)
    winners = glm.single_winner_contests(hist).filter("won = 1").select(
        "category", "period", F.col("candidate").alias("winner")
    )
    picks = glm.pick_winner(scored, "s").withColumn("pred", F.round("pred", 6))
    return winners.join(picks, ["category", "period"], "left")


@query(
    "coef_table_full_join",
    """SELECT coalesce(a.term, s.term) AS term, a.n AS acting_n, s.n AS series_n FROM
       (SELECT prev_wins AS term, count(*) AS n FROM t_hist WHERE cat_group = 'acting' GROUP BY 1) a
       FULL JOIN (SELECT prev_wins AS term, count(*) AS n FROM t_hist WHERE cat_group = 'series' GROUP BY 1) s
       ON a.term = s.term""",
)
def coef_table_full_join(spark: SparkSession, d: str) -> DataFrame:
    hist = with_history(tables.nominations(spark, d))
    counts = hist.groupBy("cat_group", F.col("prev_wins").alias("term")).agg(
        F.count(F.lit(1)).alias("n")
    )
    one = lambda g: counts.filter(F.col("cat_group") == g).select("term", F.col("n").alias(f"{g}_n"))
    return one("acting").join(one("series"), "term", "full")


_STATE = """SELECT candidate, prev_noms + 1 AS prev_noms, prev_wins + won AS prev_wins, prev_losses + 1 - won AS prev_losses
  FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY period DESC, category DESC, score, person DESC, work DESC) AS r
        FROM t_hist) WHERE r = 1"""


@query(
    "attach_latest_state",
    f"""SELECT p.o_orderkey AS contest, p.candidate, coalesce(s.prev_noms, 0) AS prev_noms, coalesce(s.prev_wins, 0) AS prev_wins,
        coalesce(s.prev_losses, 0) AS prev_losses
        FROM (SELECT o_orderkey, c_mktsegment || ' ' || o_orderpriority AS candidate FROM orders JOIN customer ON o_custkey = c_custkey
              UNION ALL SELECT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) p
        LEFT JOIN ({_STATE}) s ON p.candidate = s.candidate""",
)
def attach_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """Pending nominees: named parts (known people) and customer segments (newcomers)."""
    state = latest_state(with_history(tables.nominations(spark, d))).drop("prev_noms_without_win")
    newcomers = (
        tables.table(spark, d, "orders")
        .join(tables.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("o_orderkey").alias("contest"), F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("candidate"))
    )
    known = (
        tables.table(spark, d, "lineitem")
        .join(tables.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_orderkey").alias("contest"), F.col("p_name").alias("candidate"))
    )
    return attach_state(newcomers.unionByName(known), state)


@query(
    "first_in_group_is_winner",
    """SELECT s.contest, s.line, s.part_id, s.supp_id, s.score, s.work, CAST(CASE WHEN s.work = f.work THEN 1 ELSE 0 END AS INT) AS won_by_order
       FROM t_short s JOIN (SELECT DISTINCT contest, first_value(work) OVER (PARTITION BY contest ORDER BY line, part_id, supp_id, score) AS work
       FROM t_short) f ON s.contest = f.contest""",
)
def first_in_group_is_winner(spark: SparkSession, d: str) -> DataFrame:
    lists = tables.shortlists(spark, d)
    out = enrich.with_first_in_group_winner(lists, ["contest"], "work", F.struct(*tables.LINE_KEY))
    return out.select("contest", *tables.LINE_KEY, "work", "won_by_order")


@query(
    "membership_flag",
    f"""SELECT {ROW}, CAST(CASE WHEN work IN (SELECT work FROM t_noms WHERE cat_group = 'series' AND won = 1) THEN 1 ELSE 0 END AS INT)
        AS in_winners FROM t_noms""",
)
def membership_flag(spark: SparkSession, d: str) -> DataFrame:
    noms = tables.nominations(spark, d)
    winners = noms.filter((F.col("cat_group") == "series") & (F.col("won") == 1)).select("work")
    return _row(enrich.membership_flag(noms, "work", winners, "in_winners"), "in_winners")


@query(
    "exclude_contests_with",
    """SELECT contest, line, part_id, supp_id, score, person FROM t_short WHERE contest NOT IN
       (SELECT contest FROM t_short WHERE person = 'red widget')""",
)
def exclude_contests_with(spark: SparkSession, d: str) -> DataFrame:
    lists = tables.shortlists(spark, d)
    kept = enrich.exclude_contests_with(lists, ["contest"], F.col("person") == "red widget")
    return kept.select("contest", *tables.LINE_KEY, "person")


@query(
    "threshold_counts",
    """SELECT i AS season, CAST(sum(CASE WHEN length >= i THEN 1 ELSE 0 END) AS BIGINT) AS num_cases
       FROM (SELECT l_orderkey, count(*) AS length FROM lineitem GROUP BY 1), range(1, 11) t(i) GROUP BY 1""",
)
def threshold_counts(spark: SparkSession, d: str) -> DataFrame:
    lengths = tables.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("length"))
    return mix.threshold_counts(lengths, 10)


@query(
    "resolve_ids",
    """SELECT name, coalesce(fix, hit) AS id FROM (
         SELECT p_name AS name, CASE WHEN p_name LIKE 'red %' THEN 'fix-' || p_name END AS fix,
                'id-' || first_value(p_partkey) OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS hit FROM part)
       GROUP BY ALL""",
)
def resolve_ids(spark: SparkSession, d: str) -> DataFrame:
    part = tables.table(spark, d, "part")
    names = part.select(F.col("p_name").alias("name")).distinct()
    overrides = names.filter(F.col("name").startswith("red ")).select(
        "name", F.concat(F.lit("fix-"), "name").alias("id")
    )
    hits = part.select(
        F.col("p_name").alias("name"),
        F.concat(F.lit("id-"), F.col("p_partkey").cast("string")).alias("id"),
        F.struct(-F.col("p_size"), F.col("p_partkey")).alias("place"),
    )
    return enrich.resolve_ids(names, overrides, hits)


@query(
    "explode_job_specs",
    """SELECT page_id, 'Actress' AS column_name, 'Actress Drama' AS category, contains(html, '<h1>') AS has_field FROM pages WHERE contains(url, '/en/')
       UNION ALL SELECT page_id, 'Actor', 'Actor Comedy', contains(html, '<nav>') FROM pages WHERE contains(url, '/fr/')
       UNION ALL SELECT page_id, 'Program', 'Show Drama', contains(html, '<table>') FROM pages WHERE contains(url, '/de/')""",
)
def explode_job_specs(spark: SparkSession, d: str) -> DataFrame:
    """Extraction specs are rows joined to the pages; one plan instead of a loop."""
    # Fixed values: (url part, column, category, marker) of each extraction.
    specs = spark.createDataFrame(
        [
            ("en", "Actress", "Actress Drama", "<h1>"),
            ("fr", "Actor", "Actor Comedy", "<nav>"),
            ("de", "Program", "Show Drama", "<table>"),
        ],
        "site string, column_name string, category string, marker string",
    )
    site = F.regexp_extract("url", "/(en|fr|de)/", 1)
    pages = tables.table(spark, d, "pages").withColumn("site", site)
    return pages.join(F.broadcast(specs), "site").select(  # three spec rows
        "page_id", "column_name", "category", F.contains("html", "marker").alias("has_field")
    )


# ---- sorting, set operations ---------------------------------------------


@query(
    "sort_multi",
    "SELECT period, category, candidate, work, score FROM t_noms ORDER BY period, category, score DESC, candidate, work",
)
def sort_multi(spark: SparkSession, d: str) -> DataFrame:
    return tables.nominations(spark, d).select("period", "category", "candidate", "work", "score").orderBy(
        "period", "category", F.col("score").desc(), "candidate", "work"
    )


@query(
    "slice_list",
    """SELECT period FROM (SELECT period, row_number() OVER (ORDER BY period DESC) AS r, count(*) OVER () AS n
       FROM (SELECT DISTINCT period FROM t_noms)) WHERE r > n - 45 AND r < n""",
)
def slice_list(spark: SparkSession, d: str) -> DataFrame:
    """Distinct periods, newest first, from the 45th last to before the last."""
    periods = tables.nominations(spark, d).select("period").distinct()
    oldest = periods.orderBy("period").limit(45)
    return oldest.orderBy("period").offset(1)


@query(
    "between_markers",
    """SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN (
         SELECT conv_id, min(turn) FILTER (WHERE contains(text, 'the')) AS a, min(turn) FILTER (WHERE contains(text, 'tion')) AS b
         FROM conversations GROUP BY 1) m ON c.conv_id = m.conv_id WHERE c.turn >= m.a AND (m.b IS NULL OR c.turn <= greatest(m.b, m.a))""",
)
def between_markers(spark: SparkSession, d: str) -> DataFrame:
    """Rows from the first start marker to the first end marker, inclusive."""
    c = tables.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    first = lambda word: F.min(F.when(F.contains("text", F.lit(word)), F.col("turn")))
    marks = c.groupBy("conv_id").agg(first("the").alias("a"), first("tion").alias("b"))
    stop = F.greatest("b", "a")
    return c.join(marks, "conv_id").filter(
        (F.col("turn") >= F.col("a")) & (F.col("b").isNull() | (F.col("turn") <= stop))
    ).select("conv_id", "turn", "role")


_KEY = "concat_ws('|', period, category, person, work"


@query(
    "shuffle_rows",
    f"SELECT {ROW}, md5({_KEY}, '7')) AS h FROM t_noms ORDER BY h",
)
def shuffle_rows(spark: SparkSession, d: str) -> DataFrame:
    keys = ["period", "category", "person", "work"]
    noms = tables.nominations(spark, d)
    return _row(noms, sampling.row_hash(keys, 7).alias("h")).orderBy("h")


@query(
    "stratified_split",
    f"""SELECT {ROW}, won, rep, percent_rank() OVER (PARTITION BY won, rep ORDER BY h, period, category, person, work) < 0.75 AS train
        FROM (SELECT *, md5({_KEY}, rep)) AS h FROM t_noms, range(1, 11) r(rep))""",
)
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    keys = ["period", "category", "person", "work"]
    repeats = F.sequence(F.lit(1).cast("bigint"), F.lit(10).cast("bigint"))
    noms = tables.nominations(spark, d).withColumn("rep", F.explode(repeats))
    return _row(sampling.stratified_split(noms, ["won", "rep"], keys, F.col("rep")), "won", "rep", "train")


@query(
    "union_by_name",
    f"""SELECT work, season, season_start, av_rating FROM t_seasons
        UNION ALL SELECT 'Manual', 2, 2003, 8.6""",
)
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    seasons = tables.seasons(spark, d)
    manual = spark.createDataFrame(
        [(8.6, "Manual", 2003, 2)], "av_rating double, work string, season_start int, season int"
    )
    return seasons.select("work", "season", "season_start", "av_rating").unionByName(manual)


@query("distinct_rows", "SELECT DISTINCT period, work FROM t_noms WHERE cat_group = 'series'")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables.nominations(spark, d).filter("cat_group = 'series'").select("period", "work").dropDuplicates()


@query(
    "zero_filled_keys",
    """SELECT coalesce(a.prev_noms, b.prev_noms) AS prev_noms, coalesce(a.wins, 0) AS wins, coalesce(b.losses, 0) AS losses FROM
       (SELECT prev_noms, count(*) AS wins FROM t_hist WHERE won = 1 GROUP BY 1) a
       FULL JOIN (SELECT prev_noms, count(*) AS losses FROM t_hist WHERE won = 0 GROUP BY 1) b ON a.prev_noms = b.prev_noms""",
)
def zero_filled_keys(spark: SparkSession, d: str) -> DataFrame:
    hist = with_history(tables.nominations(spark, d))
    side = lambda won, name: hist.filter(F.col("won") == won).groupBy("prev_noms").agg(F.count(F.lit(1)).alias(name))
    return cohorts.zero_filled_keys(side(1, "wins"), side(0, "losses"), "prev_noms", ["wins", "losses"])


@query(
    "dense_spine",
    """SELECT i AS prev_wins, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(CAST(0 AS BIGINT), max(prev_wins))) AS i FROM t_hist) t
       LEFT JOIN (SELECT prev_wins, count(*) AS n FROM t_hist GROUP BY 1) h ON t.i = h.prev_wins""",
)
def dense_spine(spark: SparkSession, d: str) -> DataFrame:
    counts = with_history(tables.nominations(spark, d)).groupBy("prev_wins").agg(F.count(F.lit(1)).alias("n"))
    return cohorts.spine_of(counts, "prev_wins").join(counts, "prev_wins", "left").fillna(0, subset=["n"])


# ---- scalar functions ----------------------------------------------------


@query(
    "str_regex",
    r"""SELECT doc_id, regexp_matches(text, '(tion|ment)[ .,]') AS has_ending, regexp_extract(text, '^([^ ]+) ', 1) AS first_word,
        CAST(len(regexp_extract_all(text, '\. ', 0)) AS INT) AS stops FROM documents""",
)
def str_regex(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return tables.table(spark, d, "documents").select(
        "doc_id",
        t.rlike(r"(tion|ment)[ .,]").alias("has_ending"),
        F.regexp_extract(t, "^([^ ]+) ", 1).alias("first_word"),
        F.size(F.expr(r"regexp_extract_all(text, '\\. ', 0)")).alias("stops"),
    )


@query(
    "surname",
    "SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN '' ELSE split_part(p_name, ' ', -1) END AS surname FROM part",
)
def surname(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_type") == "SMALL", "").otherwise(F.concat("p_name", F.lit(" ")))
    return tables.table(spark, d, "part").select("p_partkey", text.surname(name).alias("surname"))


@query(
    "surname_suffix_aware",
    """SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'Jr.' ELSE split_part(p_name, ' ', -1) END AS surname FROM part""",
)
def surname_suffix_aware(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("p_type")
    name = (
        F.when(kind == "SMALL", "Jr.")
        .when(kind == "ECONOMY", F.concat("p_name", F.lit(" Jr.")))
        .when(kind == "STANDARD", F.concat("p_name", F.lit(" Jr")))
        .otherwise(F.col("p_name"))
    )
    return tables.table(spark, d, "part").select("p_partkey", text.surname_skipping_suffix(name).alias("surname"))


@query("name_length", "SELECT doc_id, CAST(length(text) AS INT) AS name_len FROM documents")
def name_length(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "documents").select("doc_id", text.name_length("text").alias("name_len"))


@query(
    "str_slice",
    """SELECT page_id, substr(url, 1, 4) AS head, CAST(strpos(url, '?') AS INT) AS mark, contains(url, '.net') AS is_net,
       split_part(url, '/', 3) AS host, substr(url, 5) AS tail FROM pages""",
)
def str_slice(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return tables.table(spark, d, "pages").select(
        "page_id", F.substring(u, 1, 4).alias("head"), F.instr(u, "?").alias("mark"),
        u.contains(".net").alias("is_net"), F.split_part(u, F.lit("/"), F.lit(3)).alias("host"),
        F.substr(u, F.lit(5)).alias("tail"),
    )


@query(
    "round_decade",
    """SELECT o_orderkey AS contest, CAST(round_even(m, -1) AS INT) AS decade, round(o_totalprice / 7, 2) AS half_up FROM (
         SELECT *, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS m FROM orders)""",
)
def round_decade(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("contest"),
        F.bround(tables.month_number("o_orderdate"), -1).cast("int").alias("decade"),
        F.round(F.col("o_totalprice") / 7, 2).alias("half_up"),
    )


@query(
    "math_scalars",
    """SELECT o_orderkey AS contest, round(log10(o_totalprice), 6) AS log_price, round(exp(-o_totalprice / 100000), 6) AS decay,
       abs(o_totalprice - 200000) AS dist, least(o_totalprice, 100000.0) AS capped, round(sqrt(o_totalprice), 6) AS root FROM orders""",
)
def math_scalars(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return tables.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("contest"), F.round(F.log10(p), 6).alias("log_price"),
        F.round(F.exp(-p / 100000), 6).alias("decay"), F.abs(p - 200000).alias("dist"),
        F.least(p, F.lit(100000.0)).alias("capped"), F.round(F.sqrt(p), 6).alias("root"),
    )


@query(
    "grid_index",
    """SELECT o_orderkey AS contest, o_orderkey // 7 AS grid_row, o_orderkey % 7 AS grid_col,
       CAST(len(range(1, 1 + month(o_orderdate))) AS INT) AS steps FROM orders""",
)
def grid_index(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("contest"), F.expr("o_orderkey div 7").alias("grid_row"),
        (F.col("o_orderkey") % 7).alias("grid_col"),
        F.size(F.sequence(F.lit(1), F.month("o_orderdate"))).alias("steps"),
    )


@query(
    "array_position",
    """SELECT p_partkey, CAST(list_position(list_sort(string_split(p_name || ' ' || lower(p_type), ' ')), split_part(p_name, ' ', -1)) AS BIGINT) AS idx,
       p_name || '-' || p_type AS zipped FROM part""",
)
def array_position(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.array_sort(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " "))
    zipped = F.arrays_zip(F.array("p_name").alias("a"), F.array("p_type").alias("b"))
    pair = F.transform(zipped, lambda z: F.concat_ws("-", z["a"], z["b"]))
    return tables.table(spark, d, "part").select(
        "p_partkey", F.array_position(tokens, text.surname("p_name")).alias("idx"),
        F.element_at(pair, 1).alias("zipped"),
    )


@query(
    "map_lookup",
    "SELECT event_id, CAST(props->>'k' AS INT) AS k, CAST(props->>'absent' AS INT) AS absent, 'k' AS first_key FROM events",
)
def map_lookup(spark: SparkSession, d: str) -> DataFrame:
    m = F.from_json("props", "map<string,int>")
    return tables.table(spark, d, "events").select(
        "event_id", F.try_element_at(m, F.lit("k")).alias("k"),
        F.try_element_at(m, F.lit("absent")).alias("absent"),
        F.try_element_at(F.map_keys(m), F.lit(1)).alias("first_key"),
    )
