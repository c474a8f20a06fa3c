"""Logistic models of winning, and contest-normalised scores.

Fits run in Spark ML (iterations are tree-aggregated on the executors); only
coefficients reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.errors import UnsupportedOperationException
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.operators.groupwise import with_group_stats
from laurel.operators.sampling import holdout_split
from laurel.schema import CONTEST, DEFAULT_RATING, DEFAULT_WIN_RATE

# The terms of the two models.
SERIES_TERMS = [
    "later_season", "prev_wins", "one_prev_win", "prev_noms", "av_rating",
    "won_external", "won_last_period", "total_noms",
]
ACTING_TERMS = [
    "later_season", "prev_wins", "one_prev_win", "prev_noms", "alph_pos_1or5",
    "also_nominated", "total_noms", "won_external",
]
FITS_AT_ONCE = 4


def single_winner_contests(
    df: DataFrame, keys: Sequence[str] = CONTEST, source: DataFrame | None = None
) -> DataFrame:
    return with_group_stats(df, keys, source, __w=F.sum("won")).filter(F.col("__w") == 1).drop("__w")


def impute(df: DataFrame) -> DataFrame:
    """Missing rating -> 7.9, missing votes -> 0; rows without a season are left out."""
    return (
        df.fillna({"av_rating": DEFAULT_RATING, "av_num_votes": 0.0})
        .filter(F.col("later_season").isNotNull())
    )


def with_indicators(df: DataFrame) -> DataFrame:
    """Indicator terms as booleans."""
    return (
        df.withColumn("one_prev_win", F.col("prev_wins") == 1)
        .withColumn("alph_pos_1or5", F.col("alph_pos").isin(1, 5))
        .withColumn("name_length_pos_234", F.col("name_length_pos").isin(2, 3, 4))
        .withColumn("name_length_pos_1or5", F.col("name_length_pos").isin(1, 5))
    )


def _vector(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Terms as one vector; rows with a missing term are skipped, as in a model frame."""
    numeric = df.select(
        "*", *[F.col(t).cast("double").alias(f"__x_{t}") for t in terms]
    ).dropna(subset=[f"__x_{t}" for t in terms])
    assembler = VectorAssembler(inputCols=[f"__x_{t}" for t in terms], outputCol="features")
    return assembler.transform(numeric).drop(*[f"__x_{t}" for t in terms])


def complete_rows(df: DataFrame, terms: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, label and terms as doubles; rows with a missing term are left out."""
    numbers = [F.col(t).cast("double").alias(t) for t in terms]
    return df.dropna(subset=list(terms)).select(*keep, F.col(label).cast("double").alias("label"), *numbers)


def with_features(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(terms), outputCol="features").transform(rows)


@dataclass(frozen=True)
class Fit:
    """A fitted GLM; ``kept`` are the independent terms, the others are aliased."""

    model: GeneralizedLinearRegressionModel
    terms: list[str]
    kept: list[str]

    @property
    def coefficients(self) -> dict[str, float]:
        """Coefficient per kept term; an aliased term contributes nothing."""
        out = {t: float(c) for t, c in zip(self.kept, self.model.coefficients)}
        out["(Intercept)"] = float(self.model.intercept)
        return out


LEAST_SHARE = 1e-11  # of a term's variance that earlier terms must leave unexplained


def independent_terms(df: DataFrame, terms: Sequence[str]) -> list[str]:
    """Terms that are no linear combination of the intercept and earlier terms.

    One pass aggregates the terms' covariances (their Gram matrix apart from the
    intercept, free of cancellation).  Its Cholesky factor is built term by term: a
    term whose pivot, the variance that the terms kept so far leave over, is nothing
    next to its own variance is aliased.  So of dependent terms the first ones stay.
    """
    complete = df.select(*[F.col(t).cast("double").alias(t) for t in terms]).dropna()
    pairs = [(i, j) for i in range(len(terms)) for j in range(i + 1)]
    found = complete.agg(*[F.covar_pop(terms[i], terms[j]).alias(f"{i}_{j}") for i, j in pairs]).first()
    rows: list[list[float]] = []  # of the factor, for the terms kept
    kept: list[int] = []
    for i in range(len(terms)):
        row: list[float] = []
        for n, j in enumerate(kept):
            known = sum(a * b for a, b in zip(row, rows[n]))
            row.append((found[f"{i}_{j}"] - known) / rows[n][n])
        own = found[f"{i}_{i}"] or 0.0
        pivot = own - sum(a * a for a in row)
        if own > 0 and pivot > LEAST_SHARE * own:
            rows.append([*row, math.sqrt(pivot)])
            kept.append(i)
    return [terms[i] for i in kept]


def _glr() -> GeneralizedLinearRegression:
    return GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol="label", maxIter=25, tol=1e-8
    )


def fit_glm(df: DataFrame, terms: Sequence[str], label: str = "won") -> Fit:
    """Binomial GLM with logit link; the input plan runs once, then the fit reads the cached terms."""
    rows = complete_rows(df, terms, label).persist()
    try:
        kept = independent_terms(rows, terms)
        return Fit(_glr().fit(with_features(rows, kept).select("label", "features")), list(terms), kept)
    finally:
        rows.unpersist()


def _inference(model: GeneralizedLinearRegressionModel, size: int) -> list[tuple]:
    """(std. error, statistic, p-value) per coefficient; NULLs for a singular fit."""
    summary = model.summary
    try:
        errors = [float(x) for x in summary.coefficientStandardErrors]
    except UnsupportedOperationException:
        return [(None, None, None)] * size
    return list(zip(errors, map(float, summary.tValues), map(float, summary.pValues)))


def tidy(spark: SparkSession, fit: Fit) -> DataFrame:
    """Coefficient table: term, estimate, std_error, statistic, p_value (one row per term)."""
    names = [*fit.kept, "(Intercept)"]
    known = {
        name: (fit.coefficients[name], *rest)
        for name, rest in zip(names, _inference(fit.model, len(names)))
    }
    rows = [(t, *known.get(t, (None,) * 4)) for t in [*fit.terms, "(Intercept)"]]
    return spark.createDataFrame(
        rows, "term string, estimate double, std_error double, statistic double, p_value double"
    )


def predict(coefs: dict[str, float]) -> Column:
    """Probability from fixed coefficients; NULL where a term is missing."""
    eta = F.lit(coefs.get("(Intercept)", 0.0))
    for term, value in coefs.items():
        if term != "(Intercept)":
            eta = eta + F.lit(value) * F.col(term).cast("double")
    return 1 / (1 + F.exp(-eta))


def score_by_group(df: DataFrame, acting: dict[str, float], series: dict[str, float]) -> DataFrame:
    """Raw score from the model of the row's category group."""
    return df.withColumn(
        "score_raw",
        F.when(F.col("cat_group") == "acting", predict(acting)).otherwise(predict(series)),
    )


def normalise_in_contest(
    df: DataFrame, raw: str, name: str = "pred", keys: Sequence[str] = CONTEST,
    default: float = DEFAULT_WIN_RATE,
) -> DataFrame:
    """Score over the contest's score sum; a missing score counts as ``default``."""
    filled = df.withColumn(raw, F.coalesce(F.col(raw), F.lit(default)))
    out = with_group_stats(filled, keys, __t=F.sum(raw))
    return out.withColumn(name, F.col(raw) / F.col("__t")).drop("__t")


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(actual - predicted, 2)))


def pick_winner(df: DataFrame, score: str, keys: Sequence[str] = CONTEST, ties: Sequence[str | Column] = ("person", "work")) -> DataFrame:
    """Best-scored nominee per contest, without ties: a partially aggregated minimum."""
    key = F.struct((-F.col(score)).alias("s"), *ties)
    return df.groupBy(*keys).agg(
        F.min_by("candidate", key).alias("pred_winner"), F.max(score).alias("pred")
    )


def pick_accuracy(winners: DataFrame, picks: DataFrame) -> DataFrame:
    """Per category: contests, mean score of the pick, share of correct picks."""
    joined = winners.join(picks, CONTEST, "left")
    return joined.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_contests"),
        F.round(F.avg("pred"), 6).alias("mean_pred"),
        F.round(F.avg((F.col("winner") == F.col("pred_winner")).cast("int")), 6).alias("accuracy"),
    )


def single_factor_logit(df: DataFrame, factor: str, label: str = "won") -> DataFrame:
    """GLM of the label on one factor, in closed form (the model is saturated).

    Estimate = logit(p_level) - logit(p_base) with the lowest level as base.
    Levels with no or only wins have no finite estimate (NULL).
    """
    levels = df.groupBy(F.col(factor).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("wins")
    )
    mixed = (F.col("wins") > 0) & (F.col("wins") < F.col("n"))
    logit = F.when(mixed, F.log(F.col("wins") / (F.col("n") - F.col("wins"))))
    variance = F.when(mixed, 1.0 / F.col("wins") + 1.0 / (F.col("n") - F.col("wins")))
    levels = levels.withColumn("logit", logit).withColumn("variance", variance)
    base = levels.agg(
        F.min_by(F.struct("level", "logit", "variance"), "level").alias("base")
    ).scalar()
    out = levels.withColumn("base", base)
    is_base = F.col("level") == F.col("base.level")
    estimate = F.when(is_base, F.col("logit")).otherwise(F.col("logit") - F.col("base.logit"))
    error = F.sqrt(F.col("variance") + F.when(is_base, 0.0).otherwise(F.col("base.variance")))
    return out.select(
        "level", "n", "wins", F.round(estimate, 6).alias("estimate"), F.round(error, 6).alias("std_error")
    )


def repeated_holdout(
    df: DataFrame, terms: Sequence[str], row_key: Sequence[str], repeats: int = 10,
    fraction: float = 0.75, label: str = "won",
) -> DataFrame:
    """Test RMSE of ``repeats`` fits on hash-split rows: (repeat, n_test, rmse).

    The fits are independent jobs over one cached table, handed in side by side.
    """
    spark = df.sparkSession
    rows = complete_rows(df, terms, label, row_key).persist()
    try:
        data = with_features(rows, independent_terms(rows, terms)).select(*row_key, "label", "features")

        def one(repeat: int) -> tuple[int, int, float]:
            split = holdout_split(data, row_key, repeat, fraction)
            model = _glr().fit(split.filter("train"))
            error = rmse(F.col("label"), F.col("prediction"))
            row = model.transform(split.filter("not train")).agg(F.count(F.lit(1)).alias("n"), error.alias("r")).first()
            return repeat, int(row["n"]), float(row["r"])

        with ThreadPoolExecutor(FITS_AT_ONCE) as pool:  # each thread takes the caller's job properties along
            started = [pool.submit(inheritable_thread_target(spark)(partial(one, i + 1))) for i in range(repeats)]
            out = [fit.result() for fit in started]
    finally:
        rows.unpersist()
    return spark.createDataFrame(out, "repeat int, n_test long, rmse double")


def pseudo_r2(spark: SparkSession, fit: Fit) -> DataFrame:
    """Deviance, null deviance and the share explained."""
    s = fit.model.summary
    return spark.createDataFrame(
        [(float(s.deviance), float(s.nullDeviance), 1.0 - s.deviance / s.nullDeviance)],
        "deviance double, null_deviance double, pseudo_r2 double",
    )


def with_interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Product columns ``a_x_b`` for interaction terms."""
    for a, b in pairs:
        df = df.withColumn(f"{a}_x_{b}", F.col(a).cast("double") * F.col(b).cast("double"))
    return df


def multinomial_slot(wide: DataFrame, features: Sequence[str], label: str = "winning_slot"):
    """Winner slot as a multi-class outcome on wide contest rows, without intercept."""
    data = _vector(wide.filter(F.col(label).isNotNull()), features)
    lr = LogisticRegression(
        family="multinomial", labelCol="label", maxIter=100, tol=1e-10, fitIntercept=False, standardization=False
    )
    return lr.fit(data.withColumn("label", F.col(label).cast("double") - 1))


def fitted_moments(df: DataFrame, fit: Fit) -> DataFrame:
    """term, n, mean of x * p over the rows a model was fitted to (x = 1 for the intercept).

    At the optimum these equal the means of x * y, which a reader can take from the data alone.
    """
    p = predict(fit.coefficients)
    x = {t: F.col(t).cast("double") for t in fit.terms} | {"(Intercept)": F.lit(1.0)}
    moments = [F.struct(F.lit(t).alias("term"), F.avg(v * p).alias("mean_xp")) for t, v in x.items()]
    found = df.dropna(subset=fit.terms).agg(F.count(F.lit(1)).alias("n"), F.array(*moments).alias("m"))
    return found.select("n", F.inline("m"))
