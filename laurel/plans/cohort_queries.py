"""Aggregations, group-wise history and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions import stats, text
from laurel.models import glm
from laurel.operators import acquisition, cohorts, enrich, groupwise, history, mix, positions, sampling
from laurel.plans.features import features, lagged, with_capped_positions
from laurel.plans.registry import query
from laurel.schema import CONTEST
from laurel.sources import tables

ROW = "period, category, person, work"

def decade() -> Column:
    """Period rounded half-even to tens."""
    return F.bround("period", -1).cast("int").alias("decade")


def _row(df: DataFrame, *more) -> DataFrame:
    return df.select("period", "category", "person", "work", *more)


def _history(spark: SparkSession, d: str, **kw) -> DataFrame:
    return history.with_history(tables.nominations(spark, d), **kw)


# ---- aggregations --------------------------------------------------------


@query("season_weighted_mean", "SELECT * FROM t_seasons")
def season_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return tables.seasons(spark, d)


@query("win_fraction_by", "SELECT category, count(*) AS n, round(avg(won), 6) AS win_frac FROM t_noms GROUP BY 1")
def win_fraction_by(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.win_fraction(tables.nominations(spark, d), ["category"])


@query(
    "having_min_count",
    "SELECT prev_noms, count(*) AS n, round(avg(won), 6) AS win_frac FROM t_hist GROUP BY 1 HAVING count(*) >= 50",
)
def having_min_count(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.win_fraction(_history(spark, d), ["prev_noms"], min_n=50)


@query(
    "fraction_true",
    """SELECT cat_group, count(*) AS n, round(avg(CAST(prev_noms = 0 AS INT)), 6) AS frac_first,
       round(avg(CAST(later_season >= 10 AS INT)), 6) AS frac_late FROM t_lagged GROUP BY 1""",
)
def fraction_true(spark: SparkSession, d: str) -> DataFrame:
    return lagged(spark, d).groupBy("cat_group").agg(
        F.count(F.lit(1)).alias("n"),
        cohorts.fraction_true(F.col("prev_noms") == 0).alias("frac_first"),
        cohorts.fraction_true(F.col("later_season") >= 10).alias("frac_late"),
    )


_EXTREMES = """SELECT category, period, lo AS min_value, hi AS max_value, prev_noms AS winner_value FROM (
  SELECT *, min(prev_noms) OVER c AS lo, max(prev_noms) OVER c AS hi FROM t_hist WINDOW c AS (PARTITION BY period, category))
  WHERE won = 1"""


@query("contest_extremes_vs_winner", _EXTREMES)
def contest_extremes_vs_winner(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.extremes_vs_winner(_history(spark, d), CONTEST, "prev_noms")


@query(
    "two_level_summary",
    f"""SELECT category, count(*) AS n, round(avg(CAST(winner_value = min_value AS INT)), 6) AS frac_fewest,
        round(avg(CAST(winner_value = 0 AS INT)), 6) AS frac_zero, round(avg(CAST(winner_value = max_value AS INT)), 6) AS frac_most
        FROM ({_EXTREMES}) GROUP BY 1""",
)
def two_level_summary(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.two_level_summary(
        cohorts.extremes_vs_winner(_history(spark, d), CONTEST, "prev_noms"), "category"
    )


@query("count_by", "SELECT category, work, won, count(*) AS n FROM t_noms GROUP BY 1, 2, 3")
def count_by(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.count_by(tables.nominations(spark, d), ["category", "work", "won"])


@query(
    "share_of_total",
    "SELECT work, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT work, count(*) AS n FROM t_noms GROUP BY 1)",
)
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.with_share(cohorts.count_by(tables.nominations(spark, d), ["work"]))


FEATURES = ["av_rating", "av_num_votes", "total_noms", "won_last_period", "won_external", "later_season", "prev_noms"]


def _corr_sql(f: str, won: str = "won") -> str:
    x = f"CAST({f} AS DOUBLE)"
    both = f"FILTER (WHERE {f} IS NOT NULL AND {won} IS NOT NULL)"
    return (
        f"round(CASE WHEN stddev_pop({x}) {both} * stddev_pop({won}) {both} > 1e-12 "
        f"THEN corr({x}, {won}) END, 6) AS {f}_corr"
    )


@query(
    "correlation_by_bucket",
    f"SELECT CAST(round_even(period, -1) AS INT) AS decade, count(*) AS n, {_corr_sql('prev_noms')}, {_corr_sql('prev_wins')} FROM t_hist GROUP BY 1",
)
def correlation_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlation_by(_history(spark, d), [decade()], ["prev_noms", "prev_wins"], "won")


@query(
    "distinct_count",
    """SELECT cat_group, count(DISTINCT period) AS periods, count(DISTINCT work) AS works,
       count(DISTINCT period) * 4 / 5 AS exp_wins FROM t_noms GROUP BY 1""",
)
def distinct_count(spark: SparkSession, d: str) -> DataFrame:
    return tables.nominations(spark, d).groupBy("cat_group").agg(
        F.countDistinct("period").alias("periods"),
        F.countDistinct("work").alias("works"),
        (F.countDistinct("period") * 4 / 5).alias("exp_wins"),
    )


@query(
    "histogram_fixed_width",
    "SELECT returnflag, CAST(floor((x + 0.05 / 2) / 0.05) AS BIGINT) AS bin, count(*) AS n FROM "
    "(SELECT l_returnflag AS returnflag, l_quantity / 7 AS x FROM lineitem) GROUP BY 1, 2",
)
def histogram_fixed_width(spark: SparkSession, d: str) -> DataFrame:
    lines = tables.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("returnflag"), (F.col("l_quantity") / 7).alias("x")
    )
    return mix.histogram_fixed_width(lines, "x", 0.05, ["returnflag"])


@query(
    "histogram_discrete",
    """SELECT later_season, CASE won WHEN 1 THEN 'Won' ELSE 'Lost' END AS result, count(*) AS n
       FROM t_lagged GROUP BY 1, 2""",
)
def histogram_discrete(spark: SparkSession, d: str) -> DataFrame:
    result = F.when(F.col("won") == 1, "Won").otherwise("Lost").alias("result")
    return cohorts.count_by(lagged(spark, d), ["later_season", result])


@query(
    "entity_extent",
    "SELECT work, min(season_start) AS first_start, CAST(max(season) AS BIGINT) AS length FROM t_ratings GROUP BY 1",
)
def entity_extent(spark: SparkSession, d: str) -> DataFrame:
    return mix.entity_extent(tables.season_ratings(spark, d))


def order_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a 'work': it starts in its month and runs for its number of lines."""
    return tables.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("length"))


_ORDER_RUNS = "SELECT l_orderkey, count(*) AS length FROM lineitem GROUP BY 1"


@query(
    "expected_season_mix",
    """SELECT season, num_cases, round(num_cases / sum(num_cases) OVER (), 6) AS frac_expected FROM (
         SELECT i AS season, CAST(sum(CASE WHEN length >= i THEN 1 ELSE 0 END) AS BIGINT) AS num_cases
         FROM (SELECT work, min(season_start) AS s, max(season) AS length FROM t_ratings GROUP BY 1 HAVING min(season_start) <= 10),
              range(1, 11) t(i) GROUP BY 1)""",
)
def expected_season_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.expected_season_mix(tables.season_ratings(spark, d), 10, started_by=10)


_EXPECTED = """SELECT season, round(w / sum(w) OVER () * (SELECT sum(won) FROM t_noms), 6) AS exp_wins FROM (
  SELECT s AS season, coalesce(sum(f / total / length) FILTER (WHERE length >= s), 0) AS w
  FROM (SELECT unnest(generate_series(CAST(1 AS BIGINT), CAST(max(length) AS BIGINT))) AS s FROM ({runs})) t,
    (SELECT length, count(*) AS f, sum(count(*)) OVER () AS total FROM ({runs}) GROUP BY 1)
  WHERE length >= 1 GROUP BY 1)"""


@query("expected_wins_by_season", _EXPECTED.format(runs=_ORDER_RUNS))
def expected_wins_by_season(spark: SparkSession, d: str) -> DataFrame:
    wins = tables.nominations(spark, d).agg(F.sum("won").alias("wins"))
    out = mix.expected_wins(order_runs(spark, d), wins)
    return out.select("season", F.round("exp_wins", 6).alias("exp_wins"))


_DENSE = """SELECT i AS {key}, coalesce(w, 0) AS num_wins, coalesce(n, 0) AS num_tot, round(w / n, 6) AS win_frac
  FROM (SELECT unnest(generate_series(CAST({first} AS BIGINT), CAST(hi AS BIGINT))) AS i
        FROM (SELECT min({expr}) AS lo, max({expr}) AS hi FROM {src})) t LEFT JOIN (SELECT {expr} AS k, CAST(sum({won}) AS BIGINT) AS w, count(*) AS n FROM {src} GROUP BY 1) g ON t.i = g.k"""


@query(
    "win_fraction_dense",
    _DENSE.format(key="prev_losses", first=0, expr="prev_losses", won="won", src="t_hist"),
)
def win_fraction_dense(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.dense_win_fraction(_history(spark, d), "prev_losses")


def aged_series(spark: SparkSession, d: str, tie_width: int | None = None) -> DataFrame:
    """Series nominees with run dates and age, and whether they are listed first; only first rows are ranked."""
    series = tables.nominations(spark, d, tie_width).filter("cat_group = 'series'")
    runs = tables.run_dates(tables.nominations(spark, d))
    listed = groupwise.with_first_rank_capped(series, CONTEST, history.listing_order(), ["person", "work"], 2, "pos")
    out = listed.join(runs, "work")
    return out.withColumn("age", F.col("period") - F.col("start")).withColumn(
        "listed_first", (F.col("pos") == 1).cast("int")
    )


_AGED = """(SELECT n.*, n.period - r.s AS age, r.s, r.e, CAST(n.pos = 1 AS INT) AS listed_first
  FROM t_ties_pos n JOIN t_runs r ON n.work = r.work WHERE cat_group = 'series')"""


@query(
    "win_fraction_by_age",
    _DENSE.format(key="age", first="lo", expr="age", won="listed_first", src=_AGED),
)
def win_fraction_by_age(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.dense_win_fraction(aged_series(spark, d, 50000), "age", None, "listed_first")


_RUN_POINT = f"""SELECT round(p, 1) AS run_point, CAST(sum(listed_first) AS BIGINT) AS num_wins,
  CAST(sum(1 - listed_first) AS BIGINT) AS num_losses, round(avg(listed_first), 6) AS win_frac
  FROM (SELECT *, (period - s) / (e - s + 1) AS p FROM {_AGED}) WHERE p <= 1 GROUP BY 1 HAVING sum(1 - listed_first) > 0"""


@query("win_fraction_by_run_point", _RUN_POINT)
def win_fraction_by_run_point(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.by_run_point(aged_series(spark, d, 50000), "listed_first")


def nested_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Lines as episodes: brand = work, ship year = season; unshipped lines lack a rating."""
    part = tables.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"), "p_brand")
    lines = tables.table(spark, d, "lineitem").join(part, "l_partkey")
    rating = F.when(F.col("l_linestatus") == "F", F.col("l_quantity") / 4)
    episode = F.struct(
        rating.alias("rating"), F.col("l_quantity").cast("int").alias("votes"), F.year("l_shipdate").alias("year")
    )
    # One small map per line, as a stored episode record would hold it.
    return lines.select(
        F.col("p_brand").alias("work"),
        F.create_map(
            (F.year("l_shipdate") - 1995).alias("s"),
            F.create_map((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int"), episode),
        ).alias("seasons"),
    )


@query(
    "season_from_episodes",
    """SELECT work, season, CAST(1995 + season AS INT) AS season_start, count(*) FILTER (WHERE ok) AS num_eps,
       round_even(avg(rating) FILTER (WHERE ok), 2) AS av_rating, round_even(avg(votes) FILTER (WHERE ok), 0) AS av_num_votes
       FROM (SELECT p_brand AS work, CAST(year(l_shipdate) - 1995 AS INT) AS season, l_quantity / 4 AS rating, l_quantity AS votes,
             l_linestatus = 'F' AS ok FROM lineitem JOIN part ON l_partkey = p_partkey)
       WHERE season >= 1 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE ok) > 0""",
)
def season_from_episodes(spark: SparkSession, d: str) -> DataFrame:
    return acquisition.season_from_episodes(acquisition.explode_episodes(nested_episodes(spark, d)))


@query(
    "first_non_null_in_group",
    """SELECT contest, arg_min(CASE WHEN person = '' THEN NULL ELSE person END, {'a': line, 'b': part_id, 'c': supp_id, 'd': score})
       FILTER (WHERE person <> '') AS first_person FROM t_short GROUP BY 1""",
)
def first_non_null_in_group(spark: SparkSession, d: str) -> DataFrame:
    person = F.nullif(F.col("person"), F.lit(""))
    order = F.when(person.isNotNull(), F.struct(*tables.LINE_KEY))
    return tables.shortlists(spark, d).groupBy("contest").agg(F.min_by(person, order).alias("first_person"))


@query(
    "sum_check_by_period",
    """SELECT period, CAST(sum(won) AS BIGINT) AS winners, count(DISTINCT category) AS contests,
       sum(won) >= count(DISTINCT category) AS complete FROM t_ties GROUP BY 1""",
)
def sum_check_by_period(spark: SparkSession, d: str) -> DataFrame:
    out = tables.nominations(spark, d, 50000).groupBy("period").agg(
        F.sum("won").alias("winners"), F.countDistinct("category").alias("contests")
    )
    return out.withColumn("complete", F.col("winners") >= F.col("contests"))


PAGE = 50


@query(
    "ranked_text_by_group",
    f"""SELECT category, period, (pos - 1) // {PAGE} AS page,
        category || ': ' || string_agg(candidate || ': ' || CAST(CAST(score AS BIGINT) AS VARCHAR), ': ' ORDER BY pos) AS ranking
        FROM t_pos GROUP BY 1, 2, 3""",
)
def ranked_text_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Ranking as text, paged so that no string grows with the contest."""
    listed = tables.with_listing_pos(tables.nominations(spark, d))
    return paged_ranking(listed, F.bround("score").cast("bigint").cast("string"))


def paged_ranking(listed: DataFrame, shown) -> DataFrame:
    item = F.concat_ws(": ", F.col("candidate"), shown)
    # At most PAGE entries reach one list: positions are dense.
    page = F.expr(f"(pos - 1) div {PAGE}").alias("page")
    entries = listed.groupBy("category", "period", page).agg(
        F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))).alias("e")
    )
    text_ = F.array_join(F.transform("e", lambda x: x["item"]), ": ")
    return entries.select("category", "period", "page", F.concat_ws(": ", "category", text_).alias("ranking"))


@query(
    "pivot_wide",
    """SELECT work, CAST(sum(won) FILTER (WHERE cat_group = 'acting') AS BIGINT) AS acting,
       CAST(sum(won) FILTER (WHERE cat_group = 'series') AS BIGINT) AS series FROM t_noms GROUP BY 1""",
)
def pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    return tables.nominations(spark, d).groupBy("work").pivot("cat_group", ["acting", "series"]).agg(F.sum("won"))


def _slotted(spark: SparkSession, d: str) -> DataFrame:
    return sampling.slot_numbers(
        tables.shortlists(spark, d), ["contest"], tables.LINE_KEY[:3], 3, ties=tables.LINE_KEY[3:], small=True
    )


_SLOTS = """(SELECT *, row_number() OVER (PARTITION BY contest ORDER BY md5(concat_ws('|', contest, line, part_id, supp_id, '3')), line, part_id, supp_id, score) AS slot
  FROM t_short)"""


def _wide_sql(f: str) -> str:
    return ", ".join(f"max({f}) FILTER (WHERE slot = {s}) AS {f}_{s}" for s in range(1, 6))


@query(
    "pivot_contest_wide",
    f"""SELECT contest, {_wide_sql('candidate')}, {_wide_sql('score')}, max(slot) FILTER (WHERE won = 1) AS winning_slot
        FROM {_SLOTS} GROUP BY 1 HAVING count(*) = 5 AND sum(won) = 1""",
)
def pivot_contest_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide_contests(spark, d, ["candidate", "score"])


def wide_contests(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """Five-nominee, single-winner contests, one row each."""
    slotted = _slotted(spark, d)
    fit = slotted.groupBy("contest").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("w"))
    fitting = slotted.join(fit.filter("n = 5 AND w = 1").select("contest"), "contest", "left_semi")
    if not set(columns) <= set(slotted.columns):  # features of the season rated before
        fitting = enrich.with_lagged_ratings(fitting, tables.seasons(spark, d))
    return cohorts.pivot_contest_wide(fitting, ["contest"], columns, 5)


@query(
    "slot_number",
    f"SELECT contest, line, part_id, supp_id, score, slot FROM {_SLOTS}",
)
def slot_number(spark: SparkSession, d: str) -> DataFrame:
    return _slotted(spark, d).select("contest", *tables.LINE_KEY, "slot")


_RAW = "(1 / (1 + exp(-(-1.4 + 0.1 * prev_wins - 0.02 * prev_noms))))"
FIXED = {"(Intercept)": -1.4, "prev_wins": 0.1, "prev_noms": -0.02}


@query(
    "rmse",
    f"SELECT cat_group, count(*) AS n, round(sqrt(avg(pow(won - {_RAW}, 2))), 6) AS rmse FROM t_hist GROUP BY 1",
)
def rmse(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).groupBy("cat_group").agg(
        F.count(F.lit(1)).alias("n"), F.round(glm.rmse(F.col("won"), glm.predict(FIXED)), 6).alias("rmse")
    )


_PICKED = f"""(SELECT *, first_value(candidate) OVER o AS pick, first_value(pred) OVER o AS pick_pred FROM (
  SELECT *, raw / sum(raw) OVER c AS pred, sum(won) OVER c AS n_won FROM (SELECT *, {_RAW} AS raw FROM t_hist)
  WINDOW c AS (PARTITION BY period, category))
  WINDOW o AS (PARTITION BY period, category ORDER BY round(pred, 9) DESC, person, work))"""


@query(
    "pick_accuracy",
    f"""SELECT category, count(*) AS n_contests, round(avg(pick_pred), 6) AS mean_pred,
        round(avg(CAST(candidate = pick AS INT)), 6) AS accuracy FROM {_PICKED} WHERE n_won = 1 AND won = 1 GROUP BY 1""",
)
def pick_accuracy(spark: SparkSession, d: str) -> DataFrame:
    hist = glm.single_winner_contests(_history(spark, d))
    scored = glm.normalise_in_contest(hist.withColumn("raw", glm.predict(FIXED)), "raw")
    winners = hist.filter("won = 1").select(*CONTEST, F.col("candidate").alias("winner"))
    picks = glm.pick_winner(scored.withColumn("pred", F.round("pred", 9)), "pred")
    return glm.pick_accuracy(winners, picks)


@query("crosstab", "SELECT cat_group, also_nominated, count(*) AS n FROM t_feat GROUP BY 1, 2")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    flagged = enrich.with_also_nominated(tables.nominations(spark, d))
    return cohorts.count_by(flagged, ["cat_group", "also_nominated"])


def bounds_oracle(sizes: str, columns: str) -> str:
    from laurel.plans.oracle_tables import TABLES
    from laurel.plans.registry import with_ctes

    inner = with_ctes(sizes)
    head = f"{inner[: inner.rindex(sizes.strip())].rstrip()}," if inner.startswith("WITH") else "WITH"
    return (
        f"{head}\nt_sizes AS ({sizes.strip()}),\nt_bounds AS ({TABLES['t_bounds']})\n"
        f"SELECT {columns}, round(q05 / n, 6) AS conf_low, round(q95 / n, 6) AS conf_high "
        "FROM t_sizes JOIN t_bounds USING (n)"
    )


@query("binomial_bounds", bounds_oracle("SELECT category, prev_wins, count(*) AS n FROM t_hist GROUP BY 1, 2", "category, prev_wins, n"))
def binomial_bounds(spark: SparkSession, d: str) -> DataFrame:
    counts = cohorts.count_by(_history(spark, d), ["category", "prev_wins"])
    return stats.with_binomial_bounds(counts)


_LABEL = """CASE WHEN prev_noms = 0 THEN 'No' WHEN won_last_period THEN 'Yes; won last year' ELSE 'Yes; didn''t win last year' END"""


@query(
    "prior_group_label",
    f"SELECT cat_group, {_LABEL} AS prior, count(*) AS n, round(avg(won), 6) AS win_frac FROM t_feat GROUP BY 1, 2",
)
def prior_group_label(spark: SparkSession, d: str) -> DataFrame:
    flagged = enrich.with_won_last_period(_history(spark, d), tables.nominations(spark, d))
    return cohorts.win_fraction(flagged, ["cat_group", cohorts.prior_noms_label().alias("prior")])


_WINPOS = """SELECT contest, {keep} CAST(least(coalesce(min(CASE WHEN won = 1 THEN r END), 5), 5) AS INT) AS winner_pos
  FROM (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY {order}, line, part_id, supp_id, score) AS r FROM {src} WHERE {where})
  GROUP BY ALL"""
SMALL = "abcdefghijklmnopqrstuvwxyz"
SURNAME_SQL = "split_part(person, ' ', -1)"


def acting_lists(spark: SparkSession, d: str, tie_width: int | None = None) -> DataFrame:
    lists = tables.shortlists(spark, d, tie_width).filter("cat_group = 'acting'")
    return lists.withColumn("surname", text.surname("person"))


def position_table(
    spark: SparkSession, d: str, order: list, group: str = "acting", tie_width: int | None = None, collation: str | None = None
) -> DataFrame:
    lists = tables.shortlists(spark, d, tie_width).filter(F.col("cat_group") == group)
    lists = lists.withColumn("surname", text.surname("person"))
    return positions.winner_position(lists, ["contest", "category"], [*order, *tables.LINE_KEY], collation=collation, small=True)


def winpos_sql(order: str, group: str = "acting", src: str = "t_short") -> str:
    return _WINPOS.format(keep="category,", order=order, src=src, where=f"cat_group = '{group}'")


@query(
    "observed_vs_expected_wins",
    f"""SELECT winner_pos, n, total, total * 0.2::DOUBLE AS expected, round(n / total, 6) AS share FROM (
          SELECT winner_pos, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM ({winpos_sql(SURNAME_SQL)}) GROUP BY 1)""",
)
def observed_vs_expected_wins(spark: SparkSession, d: str) -> DataFrame:
    counts = cohorts.count_by(position_table(spark, d, ["surname"]), ["winner_pos"])
    return observed_vs_expected(counts)


def observed_vs_expected(counts: DataFrame) -> DataFrame:
    out = counts.withColumn("total", counts.agg(F.sum("n")).scalar())
    return out.select(
        "winner_pos", "n", "total", (F.col("total") * 0.2).alias("expected"),
        F.round(F.col("n") / F.col("total"), 6).alias("share"),
    )


# ---- running history -----------------------------------------------------


@query("prior_appearances", f"SELECT {ROW}, prev_noms FROM t_hist")
def prior_appearances(spark: SparkSession, d: str) -> DataFrame:
    return _row(_history(spark, d), "prev_noms")


@query("prior_wins", f"SELECT {ROW}, prev_wins FROM t_hist_pair")
def prior_wins(spark: SparkSession, d: str) -> DataFrame:
    return _row(_history(spark, d, style="pair"), "prev_wins")


@query(
    "prior_win_rate",
    f"SELECT {ROW}, round(CASE WHEN prev_noms > 0 THEN prev_wins / prev_noms ELSE 0.2 END, 6) AS prev_win_rate FROM t_hist",
)
def prior_win_rate(spark: SparkSession, d: str) -> DataFrame:
    out = history.with_win_rate(_history(spark, d))
    return _row(out, F.round("prev_win_rate", 6).alias("prev_win_rate"))


@query(
    "prior_history_strict",
    f"""SELECT {ROW}, CAST(coalesce(count(*) OVER w, 0) AS BIGINT) AS prev_noms, CAST(coalesce(sum(won) OVER w, 0) AS BIGINT) AS prev_wins
        FROM t_noms WINDOW w AS (PARTITION BY cat_group, candidate, CASE WHEN cat_group = 'series' THEN category ELSE '' END
        ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def prior_history_strict(spark: SparkSession, d: str) -> DataFrame:
    return _row(_history(spark, d, strict=True), "prev_noms", "prev_wins")


def carry_in_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Carry-in counts from large orders' categories: works and people of economy parts."""
    part = tables.table(spark, d, "part").filter("p_type = 'ECONOMY'")
    by = lambda c: part.groupBy(F.col(c).alias("entity")).agg(
        F.count(F.lit(1)).alias("add_noms"), F.count(F.when(F.col("p_size") > 25, 1)).alias("add_wins")
    )
    people = by("p_name").withColumn("category", F.lit("1-URGENT"))
    works = by("p_brand").withColumn("category", F.lit("5-LOW"))
    return people.unionByName(works)


@query(
    "seeded_history",
    """SELECT h.period, h.category, h.person, h.work, prev_noms + coalesce(add_noms, 0) AS prev_noms,
       prev_wins + coalesce(add_wins, 0) AS prev_wins,
       prev_noms + coalesce(add_noms, 0) - prev_wins - coalesce(add_wins, 0) AS prev_losses
       FROM t_hist h LEFT JOIN (
         SELECT '1-URGENT' AS category, p_name AS entity, count(*) AS add_noms, count(*) FILTER (WHERE p_size > 25) AS add_wins
         FROM part WHERE p_type = 'ECONOMY' GROUP BY 2
         UNION ALL SELECT '5-LOW', p_brand, count(*), count(*) FILTER (WHERE p_size > 25) FROM part WHERE p_type = 'ECONOMY' GROUP BY 2) s
       ON h.category = s.category AND h.candidate = s.entity""",
)
def seeded_history(spark: SparkSession, d: str) -> DataFrame:
    out = history.with_seeds(_history(spark, d), carry_in_seeds(spark, d))
    return _row(out, "prev_noms", "prev_wins", "prev_losses")


@query("prior_losses", f"SELECT {ROW}, prev_losses, prev_noms_without_win FROM t_hist")
def prior_losses(spark: SparkSession, d: str) -> DataFrame:
    return _row(_history(spark, d), "prev_losses", "prev_noms_without_win")


@query("relative_to_contest", f"SELECT {ROW}, round(rel_rating, 10) + 0.0 AS rel_rating FROM t_feat")
def relative_to_contest(spark: SparkSession, d: str) -> DataFrame:
    rated = enrich.with_lagged_ratings(tables.nominations(spark, d), tables.seasons(spark, d))
    out = enrich.with_relative(rated, "av_rating", "rel_rating")
    return _row(out, (F.round("rel_rating", 10) + 0.0).alias("rel_rating"))


@query("nominations_in_period", f"SELECT {ROW}, total_noms FROM t_feat")
def nominations_in_period(spark: SparkSession, d: str) -> DataFrame:
    return _row(enrich.with_period_noms(tables.nominations(spark, d)), "total_noms")


@query(
    "single_winner_contests",
    f"SELECT {ROW}, won FROM (SELECT *, sum(won) OVER (PARTITION BY period, category) AS w FROM t_ties) WHERE w = 1",
)
def single_winner_contests(spark: SparkSession, d: str) -> DataFrame:
    return _row(glm.single_winner_contests(tables.nominations(spark, d, 50000)), "won")


AVG_RANK_SQL = f"""(SELECT *, least(rank() OVER (PARTITION BY contest ORDER BY {SURNAME_SQL})
  + (count(*) OVER (PARTITION BY contest, {SURNAME_SQL}) - 1) / 2.0, 5.0)::DOUBLE AS alph_pos FROM t_short WHERE cat_group = 'acting')"""


def average_ranked(spark: SparkSession, d: str) -> DataFrame:
    return groupwise.with_average_rank_capped(acting_lists(spark, d), ["contest"], "surname", 5, "alph_pos", never_null=True)


@query("average_rank_capped", f"SELECT contest, line, part_id, supp_id, score, alph_pos FROM {AVG_RANK_SQL}")
def average_rank_capped(spark: SparkSession, d: str) -> DataFrame:
    return average_ranked(spark, d).select("contest", *tables.LINE_KEY, "alph_pos")


@query(
    "first_rank_capped",
    f"""SELECT {ROW}, CAST(least(row_number() OVER (PARTITION BY period, category ORDER BY split_part(person, ' ', -1), score DESC, person, work), 5) AS INT) AS alph_pos,
        CAST(least(row_number() OVER (PARTITION BY period, category ORDER BY length(candidate), score DESC, person, work), 5) AS INT) AS name_length_pos
        FROM t_noms""",
)
def first_rank_capped(spark: SparkSession, d: str) -> DataFrame:
    return _row(with_capped_positions(tables.nominations(spark, d)), "alph_pos", "name_length_pos")


@query("winner_position", winpos_sql(SURNAME_SQL, src="t_short_ties"))
def winner_position(spark: SparkSession, d: str) -> DataFrame:
    return position_table(spark, d, ["surname"], tie_width=20000).select("contest", "category", "winner_pos")


# Letters sort without regard to case; where they are equal, the small one stands first.
_CASED = "CASE WHEN line % 2 = 0 THEN upper({0}) ELSE {0} END"
_SWAPPED = f"translate(x, '{SMALL}{SMALL.upper()}', '{SMALL.upper()}{SMALL}')"


@query(
    "winner_position_collated",
    f"""SELECT contest, CAST(least(coalesce(min(place) FILTER (won = 1), 5), 5) AS INT) AS winner_pos,
               CAST(max(i) AS INT) AS first_idx FROM (
          SELECT *, row_number() OVER (PARTITION BY contest ORDER BY folded, swapped, line, part_id, supp_id, score) AS place,
                 count(*) FILTER (WHERE (folded, swapped) < pick) OVER (PARTITION BY contest) AS i FROM (
            SELECT *, first_value((folded, swapped)) OVER (PARTITION BY contest ORDER BY line, part_id, supp_id, score) AS pick FROM (
              SELECT *, lower(x) AS folded, {_SWAPPED} AS swapped FROM (
                SELECT *, {_CASED.format(SURNAME_SQL)} AS x FROM t_short_ties WHERE cat_group = 'acting')))) GROUP BY 1""",
)
def winner_position_collated(spark: SparkSession, d: str) -> DataFrame:
    """Positions by surname in the order of a locale, where every other surname is in capitals."""
    lists = acting_lists(spark, d, tie_width=20000)
    cased = lists.withColumn("surname", F.when(F.col("line") % 2 == 0, F.upper("surname")).otherwise(F.col("surname")))
    first = positions.winner_position_folded(cased, ["contest"], "surname", tables.LINE_KEY, "first_idx", collation="en", fold=False)
    place = positions.winner_position(cased, ["contest"], ["surname", *tables.LINE_KEY], collation="en", small=True)
    return place.join(first, "contest").select("contest", "winner_pos", "first_idx")


_FOLDED = """SELECT contest, CAST(CASE WHEN n > 5 AND i = n - 1 THEN 4 WHEN n > 5 AND i = n - 2 THEN 3 ELSE i END AS INT) AS {name} FROM (
  SELECT contest, count(*) AS n, count(*) FILTER (WHERE x < pick) AS i FROM (
    SELECT *, first_value(x) OVER (PARTITION BY contest ORDER BY line, part_id, supp_id, score) AS pick
    FROM (SELECT *, {x} AS x FROM t_short WHERE cat_group = 'acting')) GROUP BY 1)"""


@query(
    "winner_position_folded",
    f"""SELECT a.contest, a.by_surname, b.by_length FROM ({_FOLDED.format(name='by_surname', x=SURNAME_SQL)}) a
        JOIN ({_FOLDED.format(name='by_length', x='length(person)')}) b ON a.contest = b.contest""",
)
def winner_position_folded(spark: SparkSession, d: str) -> DataFrame:
    lists = acting_lists(spark, d).withColumn("len", text.name_length("person"))
    by = lambda v, n: positions.winner_position_folded(lists, ["contest"], v, tables.LINE_KEY, n)
    return by("surname", "by_surname").join(by("len", "by_length"), "contest")


@query(
    "top1_per_contest",
    "SELECT category, period, candidate, score FROM t_pos WHERE pos = 1",
)
def top1_per_contest(spark: SparkSession, d: str) -> DataFrame:
    best = groupwise.top_k(tables.nominations(spark, d), CONTEST, history.listing_order(), 1)
    return best.select(*CONTEST, "candidate", "score")


@query(
    "latest_state",
    """SELECT candidate, prev_noms + 1 AS prev_noms, prev_wins + won AS prev_wins, prev_losses + 1 - won AS prev_losses,
       CAST(CASE WHEN prev_wins + won = 0 THEN prev_noms + 1 ELSE 0 END AS BIGINT) AS prev_noms_without_win
       FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY period DESC, category DESC, score, person DESC, work DESC) AS r
             FROM t_hist) WHERE r = 1""",
)
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return history.latest_state(_history(spark, d))


@query(
    "normalise_in_contest",
    f"SELECT {ROW}, round({_RAW} / sum({_RAW}) OVER (PARTITION BY period, category), 9) AS pred FROM t_hist",
)
def normalise_in_contest(spark: SparkSession, d: str) -> DataFrame:
    scored = _history(spark, d).withColumn("raw", glm.predict(FIXED))
    return _row(glm.normalise_in_contest(scored, "raw"), F.round("pred", 9).alias("pred"))


@query(
    "k_listed_winners",
    f"""SELECT {ROW}, CAST(CASE WHEN pos <= CASE WHEN n > 60 THEN 3 WHEN n > 24 THEN 2 ELSE 1 END THEN 1 ELSE 0 END AS INT) AS won_listed
        FROM (SELECT *, count(*) OVER (PARTITION BY period, category) AS n FROM t_pos)""",
)
def k_listed_winners(spark: SparkSession, d: str) -> DataFrame:
    """Contests of more than 24 (60) nominees have two (three) joint winners."""
    noms = tables.nominations(spark, d)
    sizes = cohorts.count_by(noms, CONTEST)
    overrides = sizes.filter("n > 24").select(*CONTEST, F.when(F.col("n") > 60, 3).otherwise(2).alias("k"))
    out = enrich.with_listed_winners(
        noms, noms, overrides, CONTEST, ["person", "work"], history.listing_order()
    )
    return _row(out, "won_listed")


def local_trend_sql(rows: str, groups: list[str], bandwidth: int) -> str:
    """Weighted least squares with tricube weights around every period; ``rows`` has the groups, period and y."""
    by, same = ", ".join(f"a.{g}" for g in groups), " AND ".join(f"a.{g} = b.{g}" for g in groups)
    return f"""SELECT {", ".join(groups)}, period,
      round(CASE WHEN sw * sxx - sx * sx > 1e-9 THEN (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) ELSE sy / sw END, 6) AS trend
      FROM (SELECT {by}, a.period, sum(w) AS sw, sum(w * dx) AS sx, sum(w * dx * dx) AS sxx, sum(w * b.y) AS sy, sum(w * dx * b.y) AS sxy
        FROM (SELECT DISTINCT {", ".join(groups)}, period FROM ({rows}) WHERE y IS NOT NULL) a
        JOIN (SELECT * FROM ({rows}) WHERE y IS NOT NULL) b ON {same} AND abs(a.period - b.period) < {bandwidth},
        LATERAL (SELECT CAST(b.period - a.period AS DOUBLE) AS dx, pow(1 - pow(abs(b.period - a.period) / {bandwidth}.0, 3), 3) AS w)
        GROUP BY {by}, a.period)"""


@query(
    "group_trend",
    local_trend_sql("SELECT cat_group, won, period, later_season AS y FROM t_lagged", ["cat_group", "won"], 4),
)
def group_trend(spark: SparkSession, d: str) -> DataFrame:
    """Locally weighted linear trend of the season per outcome."""
    return stats.local_linear(lagged(spark, d), "later_season", ["cat_group", "won"], 4)


@query(
    "group_trend_mean",
    """SELECT cat_group, won, period, round(sum(s) OVER w / sum(c) OVER w, 6) AS trend FROM (
         SELECT cat_group, won, period, sum(later_season) AS s, count(later_season) AS c FROM t_lagged WHERE later_season IS NOT NULL GROUP BY 1, 2, 3)
       WINDOW w AS (PARTITION BY cat_group, won ORDER BY period RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
)
def group_trend_mean(spark: SparkSession, d: str) -> DataFrame:
    return stats.moving_mean(lagged(spark, d), "later_season", ["cat_group", "won"], 3)


@query(
    "group_trend_local",
    """SELECT cat_group, period, round((sxx * sy - sx * sxy) / (sw * sxx - sx * sx), 6) AS trend FROM (
         SELECT a.cat_group, a.period, sum(w) AS sw, sum(w * dx) AS sx, sum(w * dx * dx) AS sxx, sum(w * b.y) AS sy, sum(w * dx * b.y) AS sxy
         FROM (SELECT DISTINCT cat_group, period FROM t_noms) a
         JOIN (SELECT cat_group, period AS p, CAST(won AS DOUBLE) * 100 AS y FROM t_noms) b ON a.cat_group = b.cat_group AND abs(a.period - b.p) < 8,
         LATERAL (SELECT CAST(b.p - a.period AS DOUBLE) AS dx, pow(1 - pow(abs(b.p - a.period) / 8.0, 3), 3) AS w) GROUP BY 1, 2)""",
)
def group_trend_local(spark: SparkSession, d: str) -> DataFrame:
    """Locally weighted linear trend of the win percentage."""
    noms = tables.nominations(spark, d).withColumn("y", F.col("won") * 100)
    return stats.local_linear(noms, "y", ["cat_group"], 8)


@query(
    "contest_size_filter",
    f"""SELECT contest, line, part_id, supp_id, score, work, 'listed' AS source FROM (SELECT *, count(*) OVER (PARTITION BY contest) AS n FROM t_short) WHERE n >= 5
        UNION ALL SELECT contest, line, part_id, supp_id, score, 'Substitute ' || work, 'substitute'
        FROM (SELECT *, count(*) OVER (PARTITION BY contest) AS n FROM t_short) WHERE n = 4""",
)
def contest_size_filter(spark: SparkSession, d: str) -> DataFrame:
    """Contests of five or more stay; a table of substitutes replaces some of the short ones."""
    lists = tables.shortlists(spark, d)
    sized = groupwise.with_group_stats(lists, ["contest"], n=F.count(F.lit(1)))
    substitutes = sized.filter("n = 4").select(
        "contest", *tables.LINE_KEY, F.concat(F.lit("Substitute "), "work").alias("work")
    )
    return enough_listed(sized, substitutes, 5).select("contest", *tables.LINE_KEY, "work", "source")


def enough_listed(sized: DataFrame, substitutes: DataFrame, least: int) -> DataFrame:
    """Full contests plus the substitute lists of short ones; other short contests drop out."""
    full = sized.filter(F.col("n") >= least).withColumn("source", F.lit("listed"))
    short = sized.filter(F.col("n") < least).select("contest").distinct()
    filled = substitutes.join(short, "contest", "left_semi").withColumn("source", F.lit("substitute"))
    return full.select(*filled.columns).unionByName(filled)
