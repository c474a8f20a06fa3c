"""Models, scoring and the streaming fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions import recode as R
from laurel.functions import text
from laurel.models import glm
from laurel.operators import cohorts, enrich, groupwise, history, sampling
from laurel.plans.cohort_queries import (
    AVG_RANK_SQL, SURNAME_SQL, acting_lists, average_ranked, paged_ranking, wide_contests,
)
from laurel.plans.features import ROW_KEY, modelling_table, with_capped_positions
from laurel.plans.registry import query
from laurel.plans.relational_queries import ACTING_COEFS, SERIES_COEFS
from laurel.session import scratch_path
from laurel.schema import CONTEST
from laurel.sources import tables
from laurel.sources.staging import staged
from laurel.streaming.history import read_history, stream_history

ROW = "period, category, person, work"


def group_model(spark: SparkSession, d: str, group: str) -> glm.Fit:
    terms = glm.ACTING_TERMS if group == "acting" else glm.SERIES_TERMS
    data = modelling_table(spark, d).filter(F.col("cat_group") == group)
    return glm.fit_glm(data, terms)


def _rounded(coefs: DataFrame) -> DataFrame:
    return coefs.select("term", *[F.round(c, 6).alias(c) for c in coefs.columns[1:]])


@query("glm_series")
def glm_series(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(glm.tidy(spark, group_model(spark, d, "series")))


@query("glm_acting")
def glm_acting(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(glm.tidy(spark, group_model(spark, d, "acting")))


def single_factor_sql(source: str) -> str:
    return f"""WITH g AS (SELECT alph_pos AS level, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins FROM {source} GROUP BY 1),
      l AS (SELECT *, CASE WHEN wins > 0 AND wins < n THEN ln(wins / (n - wins)) END AS lo,
                   CASE WHEN wins > 0 AND wins < n THEN 1.0 / wins + 1.0 / (n - wins) END AS v FROM g),
      b AS (SELECT lo AS blo, v AS bv, level AS base FROM l ORDER BY level LIMIT 1)
      SELECT level, n, wins, round(CASE WHEN level = base THEN lo ELSE lo - blo END, 6) AS estimate,
             round(CASE WHEN level = base THEN sqrt(v) ELSE sqrt(v + bv) END, 6) AS std_error FROM l, b"""


def nested(sql: str) -> str:
    """Use a statement with its own CTEs as a sub-select."""
    return f"SELECT * FROM ({sql})"


@query("glm_single_factor", nested(single_factor_sql(AVG_RANK_SQL)))
def glm_single_factor(spark: SparkSession, d: str) -> DataFrame:
    return glm.single_factor_logit(average_ranked(spark, d), "alph_pos")


def length_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Acting nominees of the orders with their name-length position flag and last season."""
    lists = acting_lists(spark, d).withColumn("len", text.name_length("person"))
    ranked = groupwise.with_average_rank_capped(lists, ["contest"], "len", 5, "len_pos", never_null=True)
    seasons = tables.seasons(spark, d)
    lagged = enrich.lag_join(ranked, seasons, 1, ["season"])
    return lagged.withColumn("len_1or5", F.col("len_pos").isin(1.0, 5.0))


@query("glm_mixed")
def glm_mixed(spark: SparkSession, d: str) -> DataFrame:
    fit = glm.fit_glm(length_flagged(spark, d), ["season", "len_1or5"])
    return _rounded(glm.tidy(spark, fit))


@query(
    "predict_response",
    f"""SELECT {ROW}, round(1 / (1 + exp(-(-1.2 - 0.08 * later_season + 0.1 * prev_wins - 0.02 * prev_noms))), 6) AS prob FROM t_lagged""",
)
def predict_response(spark: SparkSession, d: str) -> DataFrame:
    from laurel.plans.features import lagged

    out = lagged(spark, d)
    return out.select(*ROW_KEY, F.round(glm.predict(ACTING_COEFS), 6).alias("prob"))


@query("repeated_holdout")
def repeated_holdout(spark: SparkSession, d: str) -> DataFrame:
    data = modelling_table(spark, d).filter("cat_group = 'acting'")
    out = glm.repeated_holdout(data, glm.ACTING_TERMS, ROW_KEY)
    return out.select("repeat", "n_test", F.round("rmse", 6).alias("rmse"))


_TIDY = """SELECT term, n * 0.001 - 1 AS {g}_coef FROM (SELECT {term} AS term, count(*) AS n FROM t_hist WHERE cat_group = '{g}' GROUP BY 1)"""
_TERM = "CASE WHEN prev_wins = 0 THEN 'prev_noms' WHEN prev_wins = 1 THEN 'one_prev_win' ELSE 'prev_wins' END"


@query(
    "tidy_coefficients",
    f"""SELECT CASE coalesce(s.term, a.term) WHEN 'prev_noms' THEN 'per_number_of_previous_noms' WHEN 'one_prev_win' THEN 'has_one_previous_win'
         ELSE 'per_number_of_previous_wins' END AS term,
        round(1 / (1 + exp(1.38 - series_coef)) - 1 / (1 + exp(1.38)), 6) AS series_effect,
        round(1 / (1 + exp(1.38 - acting_coef)) - 1 / (1 + exp(1.38)), 6) AS acting_effect
        FROM ({_TIDY.format(g='series', term=_TERM)}) s FULL JOIN ({_TIDY.format(g='acting', term=_TERM)}) a ON s.term = a.term""",
)
def tidy_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Effect table from two coefficient tables; the estimates stand in for fitted ones."""
    hist = history.with_history(tables.nominations(spark, d))
    term = (
        F.when(F.col("prev_wins") == 0, "prev_noms")
        .when(F.col("prev_wins") == 1, "one_prev_win")
        .otherwise("prev_wins")
    )
    counts = hist.groupBy("cat_group", term.alias("term")).agg((F.count(F.lit(1)) * 0.001 - 1).alias("estimate"))
    side = lambda g: counts.filter(F.col("cat_group") == g).select("term", "estimate")
    out = coefficient_effects(side("series"), side("acting"))
    return out.select("term", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def coefficient_effects(series: DataFrame, acting: DataFrame) -> DataFrame:
    """Full join of two coefficient tables by term, scaled and relabelled, as probability effects."""
    scale = F.lit(1)
    for term, units in R.TERM_SCALES.items():
        scale = F.when(F.col("term") == term, units).otherwise(scale)
    both = series.withColumnRenamed("estimate", "series_coef").join(
        acting.withColumnRenamed("estimate", "acting_coef"), "term", "full"
    )
    return both.filter(F.col("term") != "(Intercept)").select(
        R.recode("term", R.TERM_LABELS).alias("term"),
        R.relative_effect(F.col("series_coef") * scale).alias("series_effect"),
        R.relative_effect(F.col("acting_coef") * scale).alias("acting_effect"),
    )


def pending_nominees(spark: SparkSession, d: str) -> DataFrame:
    """The next, undecided period: every nominee of the latest period of its category, one later."""
    noms = tables.nominations(spark, d)
    last = noms.groupBy("category").agg(F.max("period").alias("period"))
    open_ = noms.join(last, ["category", "period"], "left_semi")
    return open_.withColumn("period", F.col("period") + 1).drop("won")


def score_pending(
    pending: DataFrame, nominees: DataFrame, seasons: DataFrame, external: DataFrame,
    acting: dict[str, float], series: dict[str, float],
) -> DataFrame:
    """Roll history forward, enrich and score undecided contests."""
    state = history.latest_state(history.with_history(nominees))
    out = history.attach_state(pending, state)
    out = enrich.with_lagged_ratings(out, seasons)
    winners = nominees.filter("won = 1").select(
        "category", (F.col("period") + 1).alias("period"), "candidate", F.lit(True).alias("won_last_period")
    ).distinct()
    out = out.join(winners, ["category", "period", "candidate"], "left").fillna(False, subset=["won_last_period"])
    out = enrich.with_external_win(out, external)
    out = enrich.with_period_noms(enrich.with_also_nominated(out, pending), pending)
    out = glm.with_indicators(with_capped_positions(out, pending))
    scored = glm.score_by_group(out, acting, series)
    return glm.normalise_in_contest(scored, "score_raw")


def pending_scores(spark: SparkSession, d: str) -> DataFrame:
    """Unrounded scores of the pending contests from the two fitted models."""
    noms = tables.nominations(spark, d)
    return score_pending(
        pending_nominees(spark, d),
        noms,
        tables.seasons(spark, d),
        tables.external_winners(noms),
        group_model(spark, d, "acting").coefficients,
        group_model(spark, d, "series").coefficients,
    )


@query("score_pending")
def score_pending_query(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the pending contests from the two fitted models."""
    out = pending_scores(spark, d)
    return out.select(*ROW_KEY, "candidate", "prev_noms", "prev_wins", F.round("pred", 6).alias("pred"))


@query(
    "score_pending_fixed",
    """SELECT period, category, person, work, prev_noms, prev_wins,
       round(raw / sum(raw) OVER (PARTITION BY category, period), 9) AS pred FROM (
         SELECT *, coalesce(1 / (1 + exp(-(CASE WHEN cat_group = 'acting'
             THEN -1.2 - 0.08 * later_season + 0.1 * prev_wins - 0.02 * prev_noms
             ELSE -0.9 - 0.15 * later_season + 0.2 * prev_wins - 0.05 * prev_noms END))), 0.2) AS raw FROM (
           SELECT n.period + 1 AS period, n.category, n.cat_group, n.person, n.work, st.prev_noms, st.prev_wins,
                  coalesce(x.season, y.season) AS later_season
           FROM t_noms n JOIN (SELECT category, max(period) AS period FROM t_noms GROUP BY 1) m USING (category, period)
           LEFT JOIN (SELECT candidate, prev_noms + 1 AS prev_noms, prev_wins + won AS prev_wins FROM
             (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY period DESC, category DESC, score, person DESC, work DESC) AS r FROM t_hist) WHERE r = 1) st
             ON n.candidate = st.candidate
           LEFT JOIN t_seasons x ON n.work = x.work AND n.period = x.season_start
           LEFT JOIN t_seasons y ON n.work = y.work AND n.period - 1 = y.season_start))""",
)
def score_pending_fixed(spark: SparkSession, d: str) -> DataFrame:
    """The pending flow with fixed coefficients, so that its result can be checked exactly."""
    noms = tables.nominations(spark, d)
    out = score_pending(
        pending_nominees(spark, d),
        noms,
        tables.seasons(spark, d),
        tables.external_winners(noms),
        ACTING_COEFS,
        SERIES_COEFS,
    )
    return out.select(*ROW_KEY, "prev_noms", "prev_wins", F.round("pred", 9).alias("pred"))


INTERACTIONS = [f"{level}_x_{x}" for level in ("early", "late") for x in ("av_rating", "av_kvotes")]


def interaction_data(spark: SparkSession, d: str) -> DataFrame:
    """Rated series nominees with rating and thousands of votes, each apart for early and late periods."""
    from laurel.plans.features import lagged

    data = lagged(spark, d).filter("cat_group = 'series'").select(
        "won", "av_rating", (F.col("av_num_votes") / 1000).alias("av_kvotes"),
        (F.col("period") < 40).alias("early"), (F.col("period") >= 40).alias("late"),
    )
    return glm.with_interactions(data, [tuple(t.split("_x_")) for t in INTERACTIONS])


@query("interaction_terms")
def interaction_terms(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(glm.tidy(spark, glm.fit_glm(interaction_data(spark, d), INTERACTIONS)))


def _moments_sql(model: str, source: str, terms: list[str]) -> str:
    complete = " AND ".join(f"{t} IS NOT NULL" for t in terms)
    return " UNION ALL ".join(
        f"SELECT '{model}' AS model, '{t}' AS term, count(*) AS n, round(avg(CAST({x} AS DOUBLE) * won), 3) AS mean_xy "
        f"FROM {source} WHERE {complete}"
        for t, x in [*((t, t) for t in terms), ("(Intercept)", "1")]
    )


_INTERACTION_SQL = """(SELECT won, CAST(period < 40 AS INT) * av_rating AS early_x_av_rating, CAST(period < 40 AS INT) * av_num_votes / 1000 AS early_x_av_kvotes,
  CAST(period >= 40 AS INT) * av_rating AS late_x_av_rating, CAST(period >= 40 AS INT) * av_num_votes / 1000 AS late_x_av_kvotes
  FROM t_lagged WHERE cat_group = 'series')"""


@query(
    "glm_score_equations",
    " UNION ALL ".join([
        _moments_sql("series", "(FROM t_model WHERE cat_group = 'series')", glm.SERIES_TERMS),
        _moments_sql("acting", "(FROM t_model WHERE cat_group = 'acting')", glm.ACTING_TERMS),
        _moments_sql("interaction", _INTERACTION_SQL, INTERACTIONS),
    ]),
)
def glm_score_equations(spark: SparkSession, d: str) -> DataFrame:
    """The fitted models at their optimum: mean x * p of each term equals the data's mean x * y."""
    parts = []
    for model, data, terms in (
        ("series", modelling_table(spark, d).filter("cat_group = 'series'"), glm.SERIES_TERMS),
        ("acting", modelling_table(spark, d).filter("cat_group = 'acting'"), glm.ACTING_TERMS),
        ("interaction", interaction_data(spark, d), INTERACTIONS),
    ):
        parts.append(glm.fitted_moments(data, glm.fit_glm(data, terms)).withColumn("model", F.lit(model)))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return found.select("model", "term", "n", F.round("mean_xp", 3).alias("mean_xy"))


@query("pseudo_r2")
def pseudo_r2(spark: SparkSession, d: str) -> DataFrame:
    out = glm.pseudo_r2(spark, group_model(spark, d, "acting"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("multinomial_slot")
def multinomial_slot(spark: SparkSession, d: str) -> DataFrame:
    """Winner slot from the five slots' last seasons, without intercept: log odds against the first slot."""
    terms = [f"later_season_{s}" for s in range(1, 6)]
    build = lambda: wide_contests(spark, d, ["later_season"]).select("winning_slot", *terms)
    wide = staged(spark, d, "slots", tables.SOURCES, build)  # fits pass over it again and again
    matrix = glm.multinomial_slot(wide, terms).coefficientMatrix.toArray()
    rows = [(s + 1, t, float(matrix[s][j] - matrix[0][j])) for s in range(1, 5) for j, t in enumerate(terms)]
    return spark.createDataFrame(rows, "slot int, term string, estimate double").select(
        "slot", "term", F.round("estimate", 4).alias("estimate")
    )


def event_contests(events: DataFrame) -> DataFrame:
    """Events as nominations: contest = (day, event type), a user wins with a value above 10."""
    return events.select(
        F.col("user_id").cast("string").alias("entity"),
        F.dayofyear("ts").alias("period"),
        F.col("event_type").alias("category"),
        F.col("event_id").alias("order_key"),
        (F.col("value") > 10).cast("int").alias("won"),
    )


@query(
    "stream_history",
    """SELECT CAST(user_id AS VARCHAR) AS entity, CAST(dayofyear(ts) AS INT) AS period, event_type AS category, event_id AS order_key,
       CAST(value > 10 AS INT) AS won, row_number() OVER w - 1 AS prev_noms,
       CAST(coalesce(sum(CAST(value > 10 AS INT)) OVER (PARTITION BY user_id ORDER BY dayofyear(ts), event_type, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prev_wins
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY dayofyear(ts), event_type, event_id)""",
)
def stream_history_query(spark: SparkSession, d: str) -> DataFrame:
    """Drive the streaming fold over the events and read its written history."""
    schema = tables.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    root = scratch_path(spark, "stream")
    stream_history(event_contests(events), root).awaitTermination()
    return read_history(spark, root).select("entity", "period", "category", "order_key", "won", "prev_noms", "prev_wins")
