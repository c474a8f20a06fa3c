from pyspark.sql import functions as F

from laurel.functions import text
from laurel.operators import acquisition, cohorts, enrich, positions
from laurel.plans.features import with_capped_positions


def test_two_lags(spark, noms):
    seasons = spark.createDataFrame(
        [("W1", 1, 3, 8.0, 10.0), ("W1", 0, 2, 6.0, 30.0), ("W2", 1, 5, 7.0, 50.0), ("W4", 0, 9, 4.0, 5.0)],
        "work string, season_start int, season int, av_rating double, av_num_votes double",
    )
    out = {(r.period, r.work): r for r in enrich.with_lagged_ratings(noms, seasons).collect()}
    assert out[(2, "W1")].av_rating == 7.0 and out[(2, "W1")].earlier_season == 2 and out[(2, "W1")].later_season == 3
    assert out[(2, "W2")].av_rating == 7.0 and out[(2, "W2")].earlier_season == 5
    assert out[(2, "W4")].later_season == 9  # only the second lag
    assert out[(2, "W5")].av_rating is None


def test_combine_seasons_zero_weights(spark):
    rows = [("W", 1, 2000, 0, 7.0, 5.0), ("X", 2, 2000, 1, 8.0, 10.0), ("X", 1, 2000, 3, 6.0, 20.0)]
    df = spark.createDataFrame(rows, "work string, season int, season_start int, num_eps long, av_rating double, av_num_votes double")
    out = {r.work: r for r in enrich.combine_seasons(df).collect()}
    assert out["W"].av_rating is None
    assert out["X"].av_rating == 6.5 and out["X"].season == 1 and out["X"].num_eps == 4


def test_flags_never_multiply_rows(noms):
    n = noms.count()
    last = enrich.with_won_last_period(noms)
    assert last.count() == n
    won = {(r.period, r.category, r.person, r.work) for r in last.filter("won_last_period").collect()}
    assert (2, "A", "Ann Lee", "W1") in won and (3, "S", "", "W2") in won and (2, "B", "Ann Lee", "W5") not in won
    assert enrich.with_last_winner_rows(noms).count() > n  # the tied contest fans out
    also = {(r.period, r.person, r.work): r.also_nominated for r in enrich.with_also_nominated(noms).collect()}
    assert also[(1, "Ann Lee", "W1")] == 1 and also[(1, "Bob Ray", "W2")] == 0 and also[(1, "", "W1")] is None
    rel = enrich.with_relative(noms, "score", "rel", exclude_self=True)
    got = {(r.period, r.category, r.work): r.rel for r in rel.collect()}
    assert got[(1, "S", "W1")] == 1.0 and got[(3, "S", "W2")] is None


def test_corrections_ids_first_and_exclusion(spark, noms):
    fix = spark.createDataFrame([(1, "A", "Cy Young Jr.", 1)], "period int, category string, person string, won int")
    out = enrich.apply_corrections(noms, fix, ["period", "category", "person"], "won")
    assert out.filter("period = 1 AND category = 'A'").agg(F.sum("won")).first()[0] == 3
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    over = spark.createDataFrame([("a", "fixed")], "name string, id string")
    hits = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("b", "z", 1)], "name string, id string, place int")
    ids = {r.name: r.id for r in enrich.resolve_ids(names, over, hits).collect()}
    assert ids == {"a": "fixed", "b": "z", "c": None}
    first = enrich.with_first_in_group_winner(noms, ["period", "category"], "person", -F.col("score"))
    flagged = first.filter("period = 2 AND category = 'A' AND won_by_order = 1")
    assert flagged.count() == 2  # both rows bearing the name
    kept = enrich.exclude_contests_with(noms, ["period", "category"], F.col("person") == "Dot")
    assert kept.filter("period = 2 AND category = 'A'").count() == 0
    k = spark.createDataFrame([(1, "A", 2)], "period int, category string, k int")
    listed = enrich.with_listed_winners(noms, noms, k, ["period", "category"], ["person", "work"], [F.col("score").desc()])
    assert listed.filter("period = 1 AND category = 'A' AND won_listed = 1").count() == 2
    assert listed.filter("period = 2 AND category = 'A' AND won_listed = 1").count() == 1


def test_winner_position(noms):
    rows = {(r.period, r.category): r.winner_pos for r in positions.winner_position(noms, ["period", "category"], ["person", "work"]).collect()}
    assert rows[(1, "A")] == 1 and rows[(2, "A")] == 2
    assert rows[(2, "B")] == 5  # no winner counts as the cap
    kept = positions.winner_position(noms, ["period", "category"], ["person", "work"], drop_no_winner=True)
    assert kept.filter("period = 2 AND category = 'B'").count() == 0


def test_winner_position_folded(spark):
    names = ["f", "a", "b", "c", "d", "e", "g"]
    rows = [(1, i, n) for i, n in enumerate(names)] + [(2, i, n) for i, n in enumerate(["g", *"abcdef"])]
    rows += [(3, i, n) for i, n in enumerate("eabcd")] + [(4, i, n) for i, n in enumerate("dabcefg")]
    df = spark.createDataFrame(rows, "c int, i int, n string")
    out = {r.c: r.winner_idx for r in positions.winner_position_folded(df, ["c"], "n", ["i"]).collect()}
    assert out == {1: 3, 2: 4, 3: 4, 4: 3}


def test_capped_positions(noms):
    out = {(r.period, r.category, r.person, r.work): (r.alph_pos, r.name_length_pos) for r in with_capped_positions(noms).collect()}
    assert out[(2, "A", "Dot", "W4")] == (1, 1) and out[(2, "A", "Ann Lee", "W1")] == (2, 2)


def test_text(spark):
    df = spark.createDataFrame([("Ann Lee",), ("Cy Young Jr.",), ("Cy Young Jr",), ("Jr.",), ("",), ("Dot",), ("Ann Lee ",)], "n string")
    got = df.select("n", text.surname("n").alias("s"), text.surname_skipping_suffix("n").alias("t")).collect()
    assert [(r.s, r.t) for r in got] == [
        ("Lee", "Lee"), ("Jr.", "Young"), ("Jr", "Young"), ("Jr.", "Jr."), ("", ""), ("Dot", "Dot"), ("Lee", "Lee"),
    ]
    titles = ["X (TV Series 1999–2004)", "X (TV Series 1999– )", "X (TV Mini-Series 1980)", "X (TV Movie 1990)", "X"]
    tdf = spark.createDataFrame([(t,) for t in titles], "title string")
    start, end = text.parse_title_years("title")
    assert [tuple(r) for r in tdf.select(start, end).collect()] == [
        (1999, 2004), (1999, 2016), (1980, 1981), (1990, 1991), (None, None),
    ]


def test_episodes(spark):
    seasons = {-1: {1: (9.0, 5, 1999)}, 1: {1: (None, 3, 2000), 2: (8.0, 4, 2001), 3: (7.0, 6, None)}, 2: {1: (None, None, None)}}
    df = spark.createDataFrame([("W", seasons)], acquisition.EPISODES)
    out = acquisition.season_from_episodes(acquisition.explode_episodes(df)).collect()
    assert [(r.season, r.season_start, r.num_eps, r.av_rating, r.av_num_votes) for r in out] == [(1, 2000, 1, 8.0, 4.0)]


def test_dense_bins(noms):
    out = cohorts.dense_win_fraction(noms.withColumn("b", F.col("period") * 2), "b").orderBy("b").collect()
    assert [(r.b, r.num_wins, r.num_tot) for r in out] == [(0, 0, 0), (1, 0, 0), (2, 3, 5), (3, 0, 0), (4, 2, 7), (5, 0, 0), (6, 2, 2)]
    assert out[0].win_frac is None and out[6].win_frac == 1.0
    assert sum(r.num_tot for r in out) == noms.count()  # no row beyond the last bin
    late = cohorts.dense_win_fraction(noms.withColumn("b", F.col("period") + 40), "b", None).orderBy("b").collect()
    assert [r.b for r in late] == [41, 42, 43] and sum(r.num_tot for r in late) == noms.count()
    assert cohorts.dense_win_fraction(noms.limit(0).withColumn("b", F.col("period")), "b").count() == 0


def test_side_tables_never_multiply_rows(spark, noms):
    external = spark.createDataFrame(
        [("A", 1, "W1"), ("A", 1, "Dot"), ("A", 1, "Dot")], "category string, period int, winner string"
    )
    won = enrich.with_external_win(noms, external)
    assert won.count() == noms.count()
    hits = {(r.person, r.work) for r in won.filter("won_external").collect()}
    assert hits == {("Ann Lee", "W1"), ("Dot", "W4")}
    fixes = spark.createDataFrame([("W1", 1, 3.0), ("W1", 1, 2.0)], "work string, period int, score double")
    fixed = enrich.apply_corrections(noms, fixes, ["work", "period"], "score")
    assert fixed.count() == noms.count()
    assert {r.score for r in fixed.filter("work = 'W1' and period = 1").collect()} == {3.0}
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    overrides = spark.createDataFrame([("a", "x2"), ("a", "x1")], "name string, id string")
    found = spark.createDataFrame([("a", "y", 1), ("b", "z", 2), ("b", "w", 1)], "name string, id string, place int")
    got = enrich.resolve_ids(names, overrides, found).collect()
    assert sorted((r.name, r.id) for r in got) == [("a", "x1"), ("b", "w"), ("c", None)]
    ratings = spark.createDataFrame([("W1", 0, 1, 7.0), ("W1", 0, 2, 6.0)], "work string, season_start int, season int, av_rating double")
    lagged = enrich.lag_join(noms, ratings, 1, ["season", "av_rating"])
    assert lagged.count() == noms.count()
    assert {(r.season, r.av_rating) for r in lagged.filter("season is not null").collect()} == {(2, 6.0)}
