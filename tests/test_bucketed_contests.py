"""Contests staged in buckets: nothing is shuffled after staging, and results are those of the plain forms."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from laurel.operators import groupwise, positions, sampling
from laurel.plans.cohort_queries import wide_contests
from laurel.sources import tables
from laurel.sources.staging import bucket_count, forget_staged

NAMES = ["red widget", "blue anvil", "hot rod", "cold bolt"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders of 1 to 7 lines; some keys repeat, some are null, some lines have no order or part."""
    d = tmp_path_factory.mktemp("contests")
    start = datetime.datetime(1995, 3, 1)
    lines, orders = [], []
    for o in range(60):
        orders.append((o, start + datetime.timedelta(days=9 * o), ["1-URGENT", "2-HIGH", "5-LOW"][o % 3]))
        for n in range(o % 7 + 1):
            lines.append((o, (o * 5 + n * 3) % 13, n, n + 1, float((o * 37 + n * 11) % 50 + 1), 5.0, start + datetime.timedelta(days=o)))
    orders += [(7, start, "2-HIGH"), (None, start, "1-URGENT")]
    lines += [(None, 1, 1, 1, 9.0, 5.0, start), (900, 1, 1, 1, 9.0, 5.0, start), (8, 99, 1, 9, 99.0, 5.0, start), (9, 1, 1, 9, None, 5.0, start)]
    parts = [(p, NAMES[p % 4], f"Brand#{p % 3}") for p in range(13)] + [(None, "hot rod", "Brand#1")]
    for name, rows, schema in (
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_shipdate timestamp"),
        ("orders", orders, "o_orderkey long, o_orderdate timestamp, o_orderpriority string"),
        ("part", parts, "p_partkey long, p_name string, p_brand string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.mark.parametrize(
    "name", ["exclude_contests_with", "glm_single_factor", "winner_position_collated", "rp_28", "wide_contests", "slot_number", "winner_position"]
)
def test_contests_are_not_shuffled_again(spark, folder, name):
    """After staging, rows of contests stay in their buckets: only counts by few levels are exchanged."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if name != "wide_contests":  # its ratings, a row for each work and month, are small whatever the lines
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables too large for it
    try:
        if name == "wide_contests":  # what multinomial_slot fits
            out = wide_contests(spark, folder, ["later_season"])
        else:
            out = __spark_entry__.queries()[name](spark, folder)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "hashpartitioning(contest" not in plan and "hashpartitioning(coalesce(contest" not in plan
    assert "Bucketed: true" in plan


def test_shortlists_are_the_joined_lines(spark, folder):
    """Best of the contest, nearly best with a tie width, against the plain joins."""
    forget_staged()
    line, order, part = (tables.table(spark, folder, t) for t in ("lineitem", "orders", "part"))
    plain = line.join(order, line.l_orderkey == order.o_orderkey).join(part, line.l_partkey == part.p_partkey)
    plain = plain.withColumn("cents", tables.cents("l_extendedprice"))
    for width in (None, 20):
        level = F.col("cents") if width is None else F.floor(F.col("cents") / (width * 100))
        best = plain.groupBy("o_orderkey").agg(F.max(level).alias("best"))
        want = plain.join(best, "o_orderkey").select("o_orderkey", "l_linenumber", "p_brand", (level == F.col("best")).cast("int").alias("won"))
        got = tables.shortlists(spark, folder, width).select("contest", "line", "work", "won")
        rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
        assert rows(got) == rows(want) and got.count() > 200


def test_buckets_grow_with_the_input(spark, folder, monkeypatch):
    path = f"{folder}/lineitem.parquet"
    assert bucket_count(spark, path) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr("laurel.sources.staging.BUCKET_BYTES", 100)
    assert bucket_count(spark, path) > 20


def test_small_contests_are_placed_as_large_ones(spark):
    rows = [(c, k, n % 4, n, int(n % 3 == (c or 0) % 3)) for c in (1, 2, None) for k in ("a", "b", None) for n in range(c or 6)]
    df = spark.createDataFrame(rows, "c int, k string, v int, n int, won int")
    both = [
        {repr(tuple(r)) for r in positions.winner_position(df, ["c", "k"], ["v", "n"], small=small).collect()} for small in (False, True)
    ]
    assert both[0] == both[1]
    slots = [
        sorted(map(repr, map(tuple, sampling.slot_numbers(df, ["c", "k"], ["n"], 3, small=small).collect()))) for small in (False, True)
    ]
    assert slots[0] == slots[1]


def test_average_ranks_of_null_and_tied_values(spark):
    """Null keys are one group unless ``never_null``; a null value is a value."""
    df = spark.createDataFrame([(k, v) for k in (1, None) for v in (None, "a", "a", "b", "c", "d", "e")], "k int, v string")
    want = {None: 1.0, "a": 2.5, "b": 4.0, "c": 5.0, "d": 5.0, "e": 5.0}
    for never_null in (False, True):
        ranked = groupwise.with_average_rank_capped(df, ["k"], "v", 5, "r", never_null=never_null).collect()
        assert len(ranked) == 14 and all(r.r == want[r.v] for r in ranked if r.k == 1 or not never_null)
