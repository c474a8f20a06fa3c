"""Report catalogue: user-level tables composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions import recode as R
from laurel.functions import stats, text
from laurel.models import glm
from laurel.operators import cohorts, enrich, groupwise, history, mix
from laurel.plans import model_queries as MQ
from laurel.plans.cohort_queries import (
    _AGED, _DENSE, _EXPECTED, _EXTREMES, _LABEL, _RUN_POINT, AVG_RANK_SQL, decade, FEATURES, SURNAME_SQL,
    _corr_sql, acting_lists, aged_series, bounds_oracle, local_trend_sql, observed_vs_expected, position_table, winpos_sql,
)
from laurel.plans.features import features, lagged, modelling_table
from laurel.plans.registry import query
from laurel.schema import CONTEST
from laurel.session import scratch_path
from laurel.sources import files, tables

N_FRAC = "count(*) AS n, round(avg(won), 6) AS win_frac"


def _history(spark: SparkSession, d: str) -> DataFrame:
    return history.with_history(tables.nominations(spark, d))


def _won_last(spark: SparkSession, d: str) -> DataFrame:
    return enrich.with_won_last_period(lagged(spark, d), tables.nominations(spark, d))


@query(
    "rp_01",
    f"SELECT CAST(round_even(period, -1) AS INT) AS decade, count(*) AS n, {', '.join(_corr_sql(f) for f in FEATURES)} FROM t_feat GROUP BY 1",
)
def rp_01(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlation_by(features(spark, d), [decade()], FEATURES, "won")


TREND_PERIODS = 6  # periods on either side of a local trend


def _trend_sql(value: str) -> str:
    rows = f"""SELECT category, CASE won WHEN 1 THEN 'Won' ELSE 'Lost' END AS result, period, {value} AS y
      FROM t_lagged WHERE cat_group = 'series'"""
    return local_trend_sql(rows, ["category", "result"], TREND_PERIODS)


def _series(df: DataFrame) -> DataFrame:
    return df.filter("cat_group = 'series'").withColumn("result", R.won_label())


@query("rp_02", _trend_sql("av_rating"))
def rp_02(spark: SparkSession, d: str) -> DataFrame:
    """Local trend of the ratings of winners and losers."""
    return stats.local_linear(_series(lagged(spark, d)), "av_rating", ["category", "result"], TREND_PERIODS)


@query(
    "rp_03",
    "SELECT category, won, count(*) AS n, round(avg(av_rating), 6) AS mean_rating FROM t_lagged WHERE av_num_votes IS NOT NULL GROUP BY 1, 2",
)
def rp_03(spark: SparkSession, d: str) -> DataFrame:
    rated = lagged(spark, d).filter(F.col("av_num_votes").isNotNull())
    return cohorts.win_fraction(rated, ["category", "won"], measure="av_rating", name="mean_rating")


_REL = "round(rel_rating, 10)"


@query(
    "rp_04",
    f"""SELECT category, CAST(floor(({_REL} + 0.1 / 2) / 0.1) AS BIGINT) AS bin, count(*) AS n FROM t_feat
        WHERE won = 1 AND av_num_votes IS NOT NULL GROUP BY 1, 2""",
)
def rp_04(spark: SparkSession, d: str) -> DataFrame:
    return mix.histogram_fixed_width(winners_relative(spark, d), "rel_rating", 0.1, ["category"])


def winners_relative(spark: SparkSession, d: str) -> DataFrame:
    rated = enrich.with_lagged_ratings(tables.nominations(spark, d), tables.seasons(spark, d))
    relative = enrich.with_relative(rated, "av_rating", "rel_rating")
    rounded = relative.withColumn("rel_rating", F.round("rel_rating", 10))
    return rounded.filter("won = 1 AND av_num_votes IS NOT NULL")


@query(
    "rp_05",
    f"""SELECT category, count(*) AS n, round(avg(CAST({_REL} > 0 AS INT)), 6) AS frac_winner_higher, round(avg({_REL}), 6) + 0.0 AS mean_diff
        FROM t_feat WHERE won = 1 AND av_num_votes IS NOT NULL GROUP BY 1""",
)
def rp_05(spark: SparkSession, d: str) -> DataFrame:
    return winners_relative(spark, d).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        cohorts.fraction_true(F.col("rel_rating") > 0).alias("frac_winner_higher"),
        (F.round(F.avg("rel_rating"), 6) + 0.0).alias("mean_diff"),
    )


@query("rp_06", _trend_sql("log10(av_num_votes)"))
def rp_06(spark: SparkSession, d: str) -> DataFrame:
    """Local trend of the votes, by powers of ten."""
    series = _series(lagged(spark, d)).withColumn("log_votes", F.log10("av_num_votes"))
    return stats.local_linear(series, "log_votes", ["category", "result"], TREND_PERIODS)


@query(
    "rp_07",
    f"""SELECT category, count(*) AS n, round(avg(CAST(winner_value = min_value AS INT)), 6) AS frac_fewest,
        round(avg(CAST(winner_value = 0 AS INT)), 6) AS frac_zero, round(avg(CAST(winner_value = max_value AS INT)), 6) AS frac_most
        FROM ({_EXTREMES.replace('t_hist', 't_hist_pair')}) GROUP BY 1""",
)
def rp_07(spark: SparkSession, d: str) -> DataFrame:
    pairs = history.with_history(tables.nominations(spark, d), style="pair")
    return cohorts.two_level_summary(cohorts.extremes_vs_winner(pairs, CONTEST, "prev_noms"), "category")


@query(
    "rp_08",
    "SELECT cat_group, count(*) AS n, round(avg(CAST(prev_noms = 0 AS INT)), 6) AS frac_zero_prev_noms FROM t_hist GROUP BY 1",
)
def rp_08(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).groupBy("cat_group").agg(
        F.count(F.lit(1)).alias("n"), cohorts.fraction_true(F.col("prev_noms") == 0).alias("frac_zero_prev_noms")
    )


@query("rp_09", f"SELECT cat_group, prev_noms = 0 AS first_nom, {N_FRAC} FROM t_lagged WHERE later_season > 1 GROUP BY 1, 2")
def rp_09(spark: SparkSession, d: str) -> DataFrame:
    later = lagged(spark, d).filter("later_season > 1")
    return cohorts.win_fraction(later, ["cat_group", (F.col("prev_noms") == 0).alias("first_nom")])


@query(
    "rp_10",
    f"SELECT category, CASE WHEN prev_noms = 0 THEN 'Yes' ELSE 'No' END AS first_nom, {N_FRAC} FROM t_lagged WHERE later_season >= 2 GROUP BY 1, 2",
)
def rp_10(spark: SparkSession, d: str) -> DataFrame:
    later = lagged(spark, d).filter("later_season IS NOT NULL AND later_season >= 2")
    return cohorts.win_fraction(later, ["category", R.yes_no(F.col("prev_noms") == 0).alias("first_nom")])


PRIOR_LABELS = ["Yes; didn't win last year", "No", "Yes; won last year"]


@query(
    "rp_11",
    f"""SELECT award_type, max(p) FILTER (WHERE prior = 'Yes; didn''t win last year') AS not_last_year,
        max(p) FILTER (WHERE prior = 'No') AS no_prior, max(p) FILTER (WHERE prior = 'Yes; won last year') AS last_year
        FROM (SELECT CASE cat_group WHEN 'acting' THEN 'Acting' ELSE 'Series' END AS award_type, {_LABEL} AS prior,
              format('{{:.2f}}%', round(round(avg(won), 6) * 100, 2)) AS p FROM t_feat WHERE later_season >= 2 GROUP BY 1, 2 HAVING count(*) > 50) GROUP BY 1""",
)
def rp_11(spark: SparkSession, d: str) -> DataFrame:
    """Win percentages by award type and prior history, groups above 50 rows."""
    later = _won_last(spark, d).filter("later_season >= 2")
    award = F.when(F.col("cat_group") == "acting", "Acting").otherwise("Series").alias("award_type")
    fractions = cohorts.win_fraction(later, [award, cohorts.prior_noms_label().alias("prior")], min_n=51)
    shown = fractions.withColumn("p", F.format_string("%.2f%%", F.round(F.col("win_frac") * 100, 2)))
    wide = shown.groupBy("award_type").pivot("prior", PRIOR_LABELS).agg(F.first("p"))
    return wide.toDF("award_type", "not_last_year", "no_prior", "last_year")


@query("rp_12", f"SELECT category, {_LABEL} AS prior, {N_FRAC} FROM t_feat WHERE later_season >= 2 GROUP BY 1, 2")
def rp_12(spark: SparkSession, d: str) -> DataFrame:
    later = _won_last(spark, d).filter("later_season >= 2")
    return cohorts.win_fraction(later, ["category", cohorts.prior_noms_label().alias("prior")])


def _acting_flagged(spark: SparkSession, d: str) -> DataFrame:
    flagged = enrich.with_also_nominated(tables.nominations(spark, d)).filter("cat_group = 'acting'")
    return flagged.withColumn("also", R.yes_no(F.col("also_nominated") == 1)).withColumn("result", R.won_label())


_ALSO = "CASE also_nominated WHEN 1 THEN 'Yes' ELSE 'No' END AS also"


@query("rp_13", f"SELECT category, {_ALSO}, {N_FRAC} FROM t_feat WHERE cat_group = 'acting' GROUP BY 1, 2")
def rp_13(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.win_fraction(_acting_flagged(spark, d), ["category", "also"])


@query(
    "rp_14",
    f"SELECT category, {_ALSO}, CASE won WHEN 1 THEN 'Won' ELSE 'Lost' END AS result, count(*) AS n FROM t_feat WHERE cat_group = 'acting' GROUP BY 1, 2, 3",
)
def rp_14(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.count_by(_acting_flagged(spark, d), ["category", "also", "result"])


@query(
    "rp_15",
    f"SELECT earlier_season, {N_FRAC} FROM t_lagged WHERE cat_group = 'series' GROUP BY 1 HAVING count(*) >= 8",
)
def rp_15(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.win_fraction(lagged(spark, d).filter("cat_group = 'series'"), ["earlier_season"], min_n=8)


@query(
    "rp_16",
    f"""SELECT later_season, CASE WHEN prev_wins >= 1 THEN 'Yes' ELSE 'No' END AS has_won, {N_FRAC}
        FROM t_lagged WHERE cat_group = 'series' GROUP BY 1, 2 HAVING count(*) >= 8""",
)
def rp_16(spark: SparkSession, d: str) -> DataFrame:
    series = lagged(spark, d).filter("cat_group = 'series'")
    return cohorts.win_fraction(series, ["later_season", R.yes_no(F.col("prev_wins") >= 1).alias("has_won")], min_n=8)


_SEASON_RESULT = "SELECT {k} CAST(later_season AS BIGINT) AS season, CASE won WHEN 1 THEN 'Won' ELSE 'Lost' END AS result, count(*) AS n FROM t_lagged WHERE later_season <= 10 GROUP BY ALL"


@query("rp_17", _SEASON_RESULT.format(k="cat_group,"))
def rp_17(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.count_by(_season_result(spark, d), ["cat_group", "season", "result"])


def _season_result(spark: SparkSession, d: str) -> DataFrame:
    return lagged(spark, d).filter("later_season <= 10").select(
        "cat_group", F.col("later_season").cast("bigint").alias("season"), R.won_label().alias("result")
    )


@query(
    "rp_18",
    """SELECT length, count(*) AS n FROM (SELECT work, CAST(max(season) AS BIGINT) AS length, min(season_start) AS s FROM t_ratings GROUP BY 1)
       WHERE s <= 10 GROUP BY 1""",
)
def rp_18(spark: SparkSession, d: str) -> DataFrame:
    extent = mix.entity_extent(tables.season_ratings(spark, d)).filter("first_start <= 10")
    return cohorts.count_by(extent, ["length"])


_MIX = """SELECT season, num_cases, round(num_cases / sum(num_cases) OVER (), 6) AS frac_expected FROM (
  SELECT i AS season, CAST(sum(CASE WHEN length >= i THEN 1 ELSE 0 END) AS BIGINT) AS num_cases
  FROM (SELECT work, max(season) AS length FROM t_ratings GROUP BY 1), range(1, 11) t(i) GROUP BY 1)"""


@query("rp_19", _MIX)
def rp_19(spark: SparkSession, d: str) -> DataFrame:
    return mix.expected_season_mix(tables.season_ratings(spark, d))


@query(
    "rp_20",
    f"""SELECT o.season, o.result, o.n, m.num_cases AS exp_noms, round(m.num_cases * 0.2::DOUBLE, 6) AS exp_wins
        FROM ({_SEASON_RESULT.format(k='')}) o JOIN ({_MIX}) m ON o.season = m.season""",
)
def rp_20(spark: SparkSession, d: str) -> DataFrame:
    observed = cohorts.count_by(_season_result(spark, d), ["season", "result"])
    expected = mix.expected_season_mix(tables.season_ratings(spark, d))
    return observed.join(expected, "season").select(
        "season", "result", "n", F.col("num_cases").alias("exp_noms"), F.round(F.col("num_cases") * 0.2, 6).alias("exp_wins")
    )


def _acting_fraction(spark: SparkSession, d: str, keys: list, min_n: int) -> DataFrame:
    return cohorts.win_fraction(_history(spark, d).filter("cat_group = 'acting'"), keys, min_n)


def _acting_sql(keys: str, min_n: int) -> str:
    return f"SELECT {keys}, {N_FRAC} FROM t_hist WHERE cat_group = 'acting' GROUP BY ALL HAVING count(*) >= {min_n}"


@query("rp_21", _acting_sql("prev_noms", 8))
def rp_21(spark: SparkSession, d: str) -> DataFrame:
    return _acting_fraction(spark, d, ["prev_noms"], 8)


@query(
    "rp_22",
    f"SELECT prev_noms, later_season, {N_FRAC} FROM t_lagged WHERE cat_group = 'acting' AND later_season BETWEEN 3 AND 6 GROUP BY 1, 2 HAVING count(*) >= 5",
)
def rp_22(spark: SparkSession, d: str) -> DataFrame:
    acting = lagged(spark, d).filter("cat_group = 'acting' AND later_season BETWEEN 3 AND 6")
    return cohorts.win_fraction(acting, ["prev_noms", "later_season"], 5)


@query("rp_23", _acting_sql("prev_wins", 10))
def rp_23(spark: SparkSession, d: str) -> DataFrame:
    return _acting_fraction(spark, d, ["prev_wins"], 10)


@query(
    "rp_24",
    bounds_oracle(
        f"SELECT cat_group, CASE WHEN prev_wins >= 2 THEN '2+' ELSE CAST(prev_wins AS VARCHAR) END AS prev_wins_grp, {N_FRAC} FROM t_hist GROUP BY 1, 2 HAVING count(*) >= 10",
        "cat_group, prev_wins_grp, n, win_frac",
    ),
)
def rp_24(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: win fraction by prior-wins bucket with 5-95 % binomial bounds."""
    keys = ["cat_group", cohorts.prior_wins_bucket().alias("prev_wins_grp")]
    return stats.with_binomial_bounds(cohorts.win_fraction(_history(spark, d), keys, 10))


@query("rp_25", _acting_sql("prev_losses", 5))
def rp_25(spark: SparkSession, d: str) -> DataFrame:
    return _acting_fraction(spark, d, ["prev_losses"], 5)


@query("rp_26", _acting_sql("prev_losses, prev_wins > 0 AS has_won", 7))
def rp_26(spark: SparkSession, d: str) -> DataFrame:
    return _acting_fraction(spark, d, ["prev_losses", (F.col("prev_wins") > 0).alias("has_won")], 7)


def _per_category(sql: str) -> str:
    return f"SELECT category, winner_pos, count(*) AS n FROM ({sql}) GROUP BY 1, 2"


@query("rp_27", _per_category(winpos_sql("work", "series")))
def rp_27(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.count_by(position_table(spark, d, ["work"], "series"), ["category", "winner_pos"])


@query("rp_28", _per_category(winpos_sql("person")))
def rp_28(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.count_by(position_table(spark, d, ["person"]), ["category", "winner_pos"])


@query("rp_29", _per_category(winpos_sql(SURNAME_SQL)))
def rp_29(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.count_by(position_table(spark, d, ["surname"]), ["category", "winner_pos"])


@query(
    "rp_30",
    bounds_oracle(
        f"""SELECT winner_pos, wins, CAST(sum(wins) OVER () AS BIGINT) AS n FROM (
              SELECT winner_pos, count(*) AS wins FROM ({winpos_sql(SURNAME_SQL)}) GROUP BY 1)""",
        "winner_pos, wins, n, round(wins / n, 6) AS share, n * 0.2::DOUBLE AS expected",
    ),
)
def rp_30(spark: SparkSession, d: str) -> DataFrame:
    counts = cohorts.count_by(position_table(spark, d, ["surname"]), ["winner_pos"])
    table = observed_vs_expected(counts).select(
        "winner_pos", F.col("n").alias("wins"), F.col("total").alias("n"), "share", "expected"
    )
    return stats.with_binomial_bounds(table)


@query("rp_31", MQ.nested(MQ.single_factor_sql(AVG_RANK_SQL)))
def rp_31(spark: SparkSession, d: str) -> DataFrame:
    return MQ.glm_single_factor(spark, d)


_WITHOUT = AVG_RANK_SQL.replace(
    "FROM t_short WHERE cat_group = 'acting'",
    "FROM t_short WHERE cat_group = 'acting' AND contest NOT IN (SELECT contest FROM t_short WHERE person = 'blue anvil')",
)


@query("rp_32", MQ.nested(MQ.single_factor_sql(_WITHOUT)))
def rp_32(spark: SparkSession, d: str) -> DataFrame:
    lists = enrich.exclude_contests_with(acting_lists(spark, d), ["contest"], F.col("person") == "blue anvil")
    ranked = groupwise.with_average_rank_capped(lists, ["contest"], "surname", 5, "alph_pos", never_null=True)
    return glm.single_factor_logit(ranked, "alph_pos")


@query(
    "rp_33",
    f"""SELECT category, winner_pos, count(*) AS n, (SELECT count(DISTINCT period) * 4 / 5 FROM t_short WHERE cat_group = 'acting') AS exp_wins
        FROM ({winpos_sql(SURNAME_SQL)}) GROUP BY 1, 2""",
)
def rp_33(spark: SparkSession, d: str) -> DataFrame:
    counts = cohorts.count_by(position_table(spark, d, ["surname"]), ["category", "winner_pos"])
    orders = tables.table(spark, d, "orders").join(
        tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi"
    )
    expected = orders.filter(F.col("o_orderpriority") < "4").agg(
        F.countDistinct(tables.month_number("o_orderdate")) * 4 / 5
    )
    return counts.withColumn("exp_wins", expected.scalar())


@query("rp_34", f"SELECT category, winner_pos, count(*) AS n FROM ({winpos_sql('length(person), length(work)')}) GROUP BY CUBE (category), winner_pos")
def rp_34(spark: SparkSession, d: str) -> DataFrame:
    """Per category and overall (NULL category)."""
    order = [text.name_length("person").alias("a"), text.name_length("work").alias("b")]
    table = position_table(spark, d, order)
    per = cohorts.count_by(table, ["category", "winner_pos"])
    overall = per.groupBy("winner_pos").agg(F.sum("n").alias("n")).withColumn("category", F.lit(None).cast("string"))
    return per.unionByName(overall)


@query("rp_35")
def rp_35(spark: SparkSession, d: str) -> DataFrame:
    return MQ.glm_mixed(spark, d)


_MODEL_COLUMNS = """period, category, person, work, won, later_season, prev_wins, prev_noms, one_prev_win, alph_pos, alph_pos_1or5,
 name_length_pos, name_length_pos_234, name_length_pos_1or5, round(av_rating, 6) AS av_rating, round(av_num_votes, 6) AS av_num_votes,
 also_nominated, total_noms, won_last_period, won_external"""


@query("rp_36", f"SELECT {_MODEL_COLUMNS} FROM t_model")
def rp_36(spark: SparkSession, d: str) -> DataFrame:
    return modelling_table(spark, d).select(
        "period", "category", "person", "work", "won", "later_season", "prev_wins", "prev_noms", "one_prev_win",
        "alph_pos", "alph_pos_1or5", "name_length_pos", "name_length_pos_234", "name_length_pos_1or5",
        F.round("av_rating", 6).alias("av_rating"), F.round("av_num_votes", 6).alias("av_num_votes"),
        "also_nominated", "total_noms", "won_last_period", "won_external",
    )


@query("rp_37")
def rp_37(spark: SparkSession, d: str) -> DataFrame:
    """Train and mean hold-out RMSE of both models."""
    out = None
    for group, terms in (("series", glm.SERIES_TERMS), ("acting", glm.ACTING_TERMS)):
        data = modelling_table(spark, d).filter(F.col("cat_group") == group)
        probability = glm.predict(glm.fit_glm(data, terms).coefficients)
        train = data.agg(F.lit(group).alias("model"), F.round(glm.rmse(F.col("won"), probability), 6).alias("train_rmse"))
        test = glm.repeated_holdout(data, terms, MQ.ROW_KEY).agg(F.round(F.avg("rmse"), 6))
        part = train.withColumn("test_rmse", test.scalar())
        out = part if out is None else out.unionByName(part)
    return out


@query("rp_38")
def rp_38(spark: SparkSession, d: str) -> DataFrame:
    """Normalised scores of both models and the accuracy of the top pick."""
    data = modelling_table(spark, d)
    acting = MQ.group_model(spark, d, "acting").coefficients
    series = MQ.group_model(spark, d, "series").coefficients
    scored = glm.score_by_group(data, acting, series)
    scored = glm.normalise_in_contest(scored, "score_raw")
    winners = glm.single_winner_contests(tables.nominations(spark, d)).filter("won = 1")
    winners = winners.select(*CONTEST, F.col("candidate").alias("winner"))
    return glm.pick_accuracy(winners, glm.pick_winner(scored, "pred"))


@query("rp_39")
def rp_39(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of both models as formatted probability effects."""
    effects = MQ.coefficient_effects(
        glm.tidy(spark, MQ.group_model(spark, d, "series")).select("term", "estimate"),
        glm.tidy(spark, MQ.group_model(spark, d, "acting")).select("term", "estimate"),
    )
    return effects.select(
        "term",
        text.signed_or_tilde(F.col("series_effect")).alias("series_effect"),
        text.signed_or_tilde(F.col("acting_effect")).alias("acting_effect"),
    )


@query("rp_40")
def rp_40(spark: SparkSession, d: str) -> DataFrame:
    """Pending contests as ranked text, best score first, in pages of 50.

    Scores of a contest sum to one, so cells by multiples of the mean score, finer in larger contests, stay small.
    """
    scored = groupwise.with_group_stats(MQ.pending_scores(spark, d), CONTEST, n=F.count(F.lit(1)))
    cell = -F.floor(F.col("pred") * F.col("n") * F.greatest(F.col("n") / 64, F.lit(16)))
    listed = groupwise.with_position(scored, CONTEST, cell, [F.col("pred").desc(), "person", "work"])
    return MQ.paged_ranking(listed, F.format_string("%.6f", "pred"))


_LISTED = """(SELECT *, CAST(pos <= CASE WHEN n > 60 THEN 3 WHEN n > 24 THEN 2 ELSE 1 END AS INT) AS won_listed FROM (
  SELECT h.*, p.pos, count(*) OVER (PARTITION BY h.period, h.category) AS n FROM t_hist_pair h JOIN t_pos p
  ON h.period = p.period AND h.category = p.category AND h.person = p.person AND h.work = p.work) WHERE n >= 5)"""


@query(
    "rp_41",
    " UNION ALL ".join(
        f"SELECT '{m}' AS measure, k AS bin, num_wins, num_tot, win_frac FROM ({_DENSE.format(key='k', first=0, expr=m, won='won_listed', src=_LISTED)})"
        for m in ("prev_noms", "prev_wins", "prev_losses")
    ),
)
def rp_41(spark: SparkSession, d: str) -> DataFrame:
    """Dense win fractions by prior noms, wins and losses of (person, work) pairs, listed winners."""
    noms = tables.nominations(spark, d)
    sizes = cohorts.count_by(noms, CONTEST)
    overrides = sizes.filter("n > 24").select(*CONTEST, F.when(F.col("n") > 60, 3).otherwise(2).alias("k"))
    past = history.with_history(noms, style="pair")
    sized = past.join(sizes.filter("n >= 5").select(*CONTEST), CONTEST, "left_semi")
    listed = enrich.with_listed_winners(
        sized, noms, overrides, CONTEST, ["person", "work"], history.listing_order()
    )
    # One pass over the rows: each row counts once under each of the three measures.
    measures = F.explode(
        F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("bin")) for m in ("prev_noms", "prev_wins", "prev_losses")])
    )
    found = listed.select("won_listed", measures.alias("m")).groupBy("m.measure", "m.bin").agg(
        F.sum("won_listed").alias("w"), F.count(F.lit(1)).alias("t")
    )
    spine = cohorts.spine_of(found, "bin", 0, ["measure"])
    wins, total = F.coalesce("w", F.lit(0)), F.coalesce("t", F.lit(0))
    return spine.join(found, ["measure", "bin"], "left").select(
        "measure", "bin", wins.alias("num_wins"), total.alias("num_tot"), F.round(F.try_divide(wins, total), 6).alias("win_frac")
    )


@query("rp_42", _DENSE.format(key="age", first="lo", expr="age", won="listed_first", src=_AGED.replace("t_ties_pos", "t_pos")))
def rp_42(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.dense_win_fraction(aged_series(spark, d), "age", None, "listed_first")


@query("rp_43", _RUN_POINT.replace("t_ties_pos", "t_pos"))
def rp_43(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.by_run_point(aged_series(spark, d), "listed_first")


_RATED_RUNS = "SELECT work, CAST(max(season) AS BIGINT) AS length FROM t_ratings GROUP BY 1"


@query("rp_44", _EXPECTED.format(runs=_RATED_RUNS))
def rp_44(spark: SparkSession, d: str) -> DataFrame:
    wins = tables.nominations(spark, d).agg(F.sum("won").alias("wins"))
    out = mix.expected_wins(mix.entity_extent(tables.season_ratings(spark, d)), wins)
    return out.select("season", F.round("exp_wins", 6).alias("exp_wins"))


@query(
    "rp_45",
    """SELECT period, person, work, CAST(length(person) AS INT) AS name_len, CASE WHEN pos = 1 THEN 'W' ELSE 'L' END AS win_or_lose
       FROM t_pos WHERE cat_group = 'acting'""",
)
def rp_45(spark: SparkSession, d: str) -> DataFrame:
    """Name-length listing, written as a sorted table and read back."""
    acting = tables.nominations(spark, d).filter("cat_group = 'acting'")
    listed = groupwise.with_first_rank_capped(acting, CONTEST, history.listing_order(), ["person", "work"], 2, "pos")
    rows = listed.select(
        "period", "person", "work", text.name_length("person").alias("name_len"),
        F.when(F.col("pos") == 1, "W").otherwise("L").alias("win_or_lose"),
    )
    path = scratch_path(spark, "name-lengths")
    files.write_sorted_table(rows, path, ["period", "person", "work", "win_or_lose"])
    return files.read_header_csv(spark, path, rows.schema)


@query(
    "rp_46",
    """SELECT k AS prev_wins, num_wins, num_tot, coalesce(win_frac, 0) * 100 AS win_pct, 0.2::DOUBLE AS avg_line,
       num_wins || '_' || num_tot AS identifier FROM ("""
    + _DENSE.format(key="k", first=0, expr="prev_wins", won="won", src="t_hist")
    + ")",
)
def rp_46(spark: SparkSession, d: str) -> DataFrame:
    """Chart-ready bars: text columns cast back, empty bins as zero, percent, reference line."""
    bars = cohorts.dense_win_fraction(_history(spark, d), "prev_wins")
    shown = bars.withColumn("frac", F.coalesce(F.col("win_frac").cast("string"), F.lit("nan")))
    return shown.select(
        "prev_wins", "num_wins", "num_tot", (files.clean_number("frac") * 100).alias("win_pct"),
        F.lit(0.2).alias("avg_line"), F.concat_ws("_", "num_wins", "num_tot").alias("identifier"),
    )


@query("rp_47", "SELECT period, CAST(sum(won) AS BIGINT) AS winners FROM t_noms GROUP BY 1")
def rp_47(spark: SparkSession, d: str) -> DataFrame:
    return tables.nominations(spark, d).groupBy("period").agg(F.sum("won").alias("winners"))
