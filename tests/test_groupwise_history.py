import random
from collections import defaultdict

from pyspark.sql import functions as F

from laurel.operators import groupwise as G
from laurel.operators import history as H


def skewed(spark):
    """300 rows, more than a third under one key."""
    rng = random.Random(1)
    rows = [
        (("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}"), rng.randrange(6), i, rng.randrange(2))
        for i in range(300)
    ]
    return rows, spark.createDataFrame(rows, "k string, cell int, i int, v int")


def test_running_totals_equal_a_fold(spark):
    rows, df = skewed(spark)
    out = G.with_running_totals(df, ["k"], ["cell"], ["i"], {"n": F.lit(1), "s": F.col("v")})
    got = {r.i: (r.n, r.s) for r in out.collect()}
    seen = defaultdict(lambda: (0, 0))
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        assert got[i] == seen[k]
        seen[k] = (seen[k][0] + 1, seen[k][1] + v)
    strict = G.with_running_totals(df, ["k"], ["cell"], ["i"], {"n": F.lit(1)}, strict=True)
    got = {r.i: r.n for r in strict.collect()}
    for k, cell, i, _ in rows:
        assert got[i] == sum(1 for r in rows if r[0] == k and r[1] < cell)


def test_position_and_capped_ranks(spark):
    rows, df = skewed(spark)
    pos = {r.i: r.pos for r in G.with_position(df, ["k"], F.col("cell"), ["cell", "i"]).collect()}
    first = {r.i: r.r for r in G.with_first_rank_capped(df, ["k"], ["v", "i"], ["i"], 5, "r").collect()}
    avg = {r.i: r.a for r in G.with_average_rank_capped(df, ["k"], "cell", 5, "a").collect()}
    for k, cell, i, v in rows:
        group = [r for r in rows if r[0] == k]
        assert pos[i] == 1 + sum((r[1], r[2]) < (cell, i) for r in group)
        assert first[i] == min(5, 1 + sum((r[3], r[2]) < (v, i) for r in group))
        less, same = sum(r[1] < cell for r in group), sum(r[1] == cell for r in group)
        assert avg[i] == min(5.0, less + (same + 1) / 2)


def test_average_rank_of_ties(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "c")], "c int, x string")
    out = {r.x: r.r for r in G.with_average_rank_capped(df, ["c"], "x", 5, "r").collect()}
    assert out == {"a": 1.5, "b": 3.0, "c": 4.0}


def test_history_reads_before_it_counts(noms):
    out = {
        (r.period, r.category, r.person, r.work): (r.prev_noms, r.prev_wins, r.prev_losses)
        for r in H.with_history(noms).collect()
    }
    assert out[(1, "A", "Ann Lee", "W1")] == (0, 0, 0)
    assert out[(2, "A", "Ann Lee", "W1")] == (1, 1, 0)
    # The second work of the same person in the same contest sees the first.
    assert out[(2, "A", "Ann Lee", "W2")] == (2, 1, 1)
    assert out[(2, "B", "Ann Lee", "W5")] == (3, 2, 1)
    assert out[(3, "A", "Ann Lee", "W2")] == (4, 2, 2)
    assert out[(2, "S", "", "W1")] == (1, 1, 0)
    assert all(n == w + l for n, w, l in out.values())


def test_history_strict_and_pair(noms):
    strict = {
        (r.period, r.category, r.person, r.work): r.prev_noms for r in H.with_history(noms, strict=True).collect()
    }
    assert strict[(2, "B", "Ann Lee", "W5")] == 1 and strict[(3, "A", "Ann Lee", "W2")] == 4
    pair = {
        (r.period, r.category, r.person, r.work): r.prev_noms for r in H.with_history(noms, style="pair").collect()
    }
    assert pair[(3, "A", "Ann Lee", "W2")] == 1 and pair[(2, "A", "Ann Lee", "W2")] == 0


def test_seeds_and_latest_state(spark, noms):
    hist = H.with_history(noms)
    seeds = spark.createDataFrame([("A", "Dot", 0, 1), ("A", "Ann Lee", 2, 1)], "category string, entity string, add_noms int, add_wins int")
    out = {(r.period, r.category, r.candidate): r for r in H.with_seeds(hist, seeds).collect()}
    assert out[(2, "A", "Dot")].prev_losses == -1  # a seed win without a seed nomination
    assert out[(3, "A", "Ann Lee")].prev_noms == 6
    assert out[(2, "B", "Ann Lee")].prev_noms == 3  # seeds are per category
    state = {r.candidate: r for r in H.latest_state(hist).collect()}
    assert (state["Ann Lee"].prev_noms, state["Ann Lee"].prev_wins) == (5, 3)
    assert state["Dot"].prev_noms_without_win == 1
    pending = spark.createDataFrame([("Ann Lee",), ("New One",)], "candidate string")
    attached = {r.candidate: r.prev_noms for r in H.attach_state(pending, H.latest_state(hist)).collect()}
    assert attached == {"Ann Lee": 5, "New One": 0}


def test_null_keys_are_one_group(spark):
    from pyspark.sql import functions as F

    from laurel.operators import groupwise

    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 5)], "k string, t int, v int")
    stats = groupwise.with_group_stats(df, ["k"], n=F.count(F.lit(1)))
    assert sorted((r.k or "", r.t, r.n) for r in stats.collect()) == [("", 1, 2), ("", 2, 2), ("a", 1, 1)]
    running = groupwise.with_running_totals(df, ["k"], ["t"], ["v"], {"before": F.col("v")})
    assert sorted((r.k or "", r.t, r.before) for r in running.collect()) == [("", 1, 0), ("", 2, 2), ("a", 1, 0)]
    ranked = groupwise.with_average_rank_capped(df, ["k"], "v", 5, "r")
    assert sorted((r.k or "", r.t, r.r) for r in ranked.collect()) == [("", 1, 1.0), ("", 2, 2.0), ("a", 1, 1.0)]
