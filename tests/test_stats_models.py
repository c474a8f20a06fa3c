import math
import random

from pyspark.sql import functions as F

from laurel.functions import stats
from laurel.models import glm
from laurel.operators import mix, sampling

# Run lengths of 199 works (length -> works) and the expected wins
# per season that 88 wins lead to.
RUN_LENGTHS = {
    2: 24, 3: 21, 4: 14, 5: 21, 6: 29, 7: 20, 8: 23, 9: 16, 10: 7, 11: 8, 12: 5, 13: 2, 14: 2,
    16: 2, 18: 1, 21: 1, 28: 1, 33: 1, 49: 1,
}
EXPECTED_WINS = [
    18.875952635327636, 18.875952635327636, 13.375952635327634, 10.1676193019943, 8.563452635327634,
    6.638452635327634, 4.423174857549858, 3.1136510480260475, 1.7959427146927143, 0.9811278998778998,
    0.6602945665445664,
]


def test_expected_wins_golden(spark):
    runs = spark.createDataFrame([(n,) for n, k in RUN_LENGTHS.items() for _ in range(k)], "length long")
    wins = spark.createDataFrame([(88,)], "wins long")
    got = [r.exp_wins for r in mix.expected_wins(runs, wins, 15).orderBy("season").collect()]
    assert len(got) == 15
    for a, b in zip(got, EXPECTED_WINS):
        assert math.isclose(a, b, abs_tol=1e-9)
    counts = mix.threshold_counts(runs, 10).orderBy("season").collect()
    assert [r.num_cases for r in counts][:3] == [199, 199, 175]


def test_binomial_quantiles(spark):
    sizes = spark.createDataFrame([(196,), (176,), (1,)], "n long")
    probs = [0.025, 0.05, 0.1, 0.9, 0.95, 0.975]
    out = {r.n: r for r in stats.binomial_quantiles(sizes, probs).collect()}
    assert (out[196].q_10, out[196].q_90) == (32, 46)
    assert (out[196].q_5, out[196].q_95) == (30, 49)
    assert (out[176].q_2_5, out[176].q_97_5) == (25, 46)
    assert (out[1].q_5, out[1].q_95) == (0, 1)


def test_binomial_large_n(spark):
    out = stats.binomial_quantiles(spark.createDataFrame([(100_000_000,)], "n long"), [0.05, 0.95]).first()
    sd = math.sqrt(100_000_000 * 0.16)
    assert abs(out.q_5 - (2e7 - 1.6449 * sd)) < 5 and abs(out.q_95 - (2e7 + 1.6449 * sd)) < 5


def test_correlation_null_on_constant(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (1, 1.0, 0), (2, 1.0, 0), (2, 2.0, 1), (2, None, 1)], "g int, x double, won int")
    out = {r.g: r.x_corr for r in stats.correlation_by(df, ["g"], ["x"], "won").collect()}
    assert out == {1: None, 2: 1.0}


def test_local_linear_recovers_a_line(spark):
    df = spark.createDataFrame([("a", p, 2.0 * p + 1) for p in range(1, 20)], "g string, period int, y double")
    for r in stats.local_linear(df, "y", ["g"], 6).collect():
        assert math.isclose(r.trend, 2.0 * r.period + 1, abs_tol=1e-6)


def labelled(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        level = float(1 + i % 3)
        rows.append((i, level, int(rng.random() < (0.2, 0.4, 0.3)[i % 3])))
    return spark.createDataFrame(rows, "id int, level double, won int")


def test_closed_form_equals_glm(spark):
    df = labelled(spark).withColumn("is2", F.col("level") == 2).withColumn("is3", F.col("level") == 3)
    closed = {r.level: r for r in glm.single_factor_logit(df, "level").collect()}
    fit = glm.fit_glm(df.withColumn("same", F.lit(1)), ["is2", "is3", "same"])
    fitted = {r.term: r for r in glm.tidy(spark, fit).collect()}
    assert fitted["same"].estimate is None  # aliased with the intercept
    for level, term in ((1.0, "(Intercept)"), (2.0, "is2"), (3.0, "is3")):
        assert math.isclose(closed[level].estimate, fitted[term].estimate, abs_tol=1e-4)
        assert math.isclose(closed[level].std_error, fitted[term].std_error, abs_tol=1e-4)
    total = df.agg(F.sum(glm.predict(fit.coefficients)), F.sum("won")).first()
    assert math.isclose(total[0], total[1], abs_tol=1e-3)
    r2 = glm.pseudo_r2(spark, fit).first()
    assert 0 < r2.pseudo_r2 < 1


def test_dependent_terms_are_aliased(spark):
    rng = random.Random(8)
    rows = [(rng.gauss(0, 1), rng.gauss(5, 2), 1e6 + rng.random(), int(rng.random() < 0.4)) for _ in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, big double, won int").withColumns({
        "total": F.col("a") * 2 - F.col("b") + 3, "same": F.lit(7), "near": F.col("a") + F.col("big") * 1e-3,
    })
    terms = ["same", "a", "b", "total", "big", "near"]
    assert glm.independent_terms(df, terms) == ["a", "b", "big"]
    assert glm.independent_terms(df, terms[::-1]) == ["near", "big", "total"]
    assert glm.independent_terms(df.limit(0), terms) == []
    fitted = {r.term: r for r in glm.tidy(spark, glm.fit_glm(df, terms)).collect()}
    without = {r.term: r for r in glm.tidy(spark, glm.fit_glm(df, ["a", "b", "big"])).collect()}
    assert [fitted[t].estimate for t in ("same", "total", "near")] == [None] * 3
    for term in ("a", "b", "big", "(Intercept)"):
        assert math.isclose(fitted[term].estimate, without[term].estimate, rel_tol=1e-9)
    slightly = df.withColumn("total", F.col("total") + F.col("won") * 1e-3)
    assert "total" in glm.independent_terms(slightly, terms)


def test_effects_are_scaled_and_labelled(spark):
    from laurel.functions.recode import relative_effect
    from laurel.plans.model_queries import coefficient_effects

    series = spark.createDataFrame([("av_num_votes", 0.0002), ("(Intercept)", 1.0)], "term string, estimate double")
    acting = spark.createDataFrame([("name_length_pos_1or5", 0.3)], "term string, estimate double")
    got = {r.term: r for r in coefficient_effects(series, acting).collect()}
    want = spark.range(1).select(relative_effect(F.lit(0.2))).first()[0]
    assert got.keys() == {"per_thousand_votes", "longest_or_shortest_name"}
    assert math.isclose(got["per_thousand_votes"].series_effect, want) and got["per_thousand_votes"].acting_effect is None


def test_normalised_scores(noms):
    raw = noms.withColumn("raw", F.when(F.col("person") == "Dot", None).otherwise(F.col("score") / 10))
    out = glm.normalise_in_contest(raw, "raw")
    for r in out.groupBy("period", "category").agg(F.sum("pred").alias("s")).collect():
        assert math.isclose(r.s, 1.0, abs_tol=1e-12)
    pick = {(r.period, r.category): r.pred_winner for r in glm.pick_winner(out, "pred").collect()}
    assert pick[(1, "A")] == "Ann Lee"


def test_holdout(spark):
    df = labelled(spark)
    out = glm.repeated_holdout(df, ["level"], ["id"], repeats=2).collect()
    assert all(150 < r.n_test < 300 and 0.3 < r.rmse < 0.6 for r in out)
    exact = sampling.stratified_split(df, ["won"], ["id"], 1)
    for r in exact.groupBy("won").agg(F.avg(F.col("train").cast("int")).alias("f")).collect():
        assert abs(r.f - 0.75) < 0.01
