"""Seats of the mix against an allotment seat by seat; sparse sources; many shards."""

import collections
import hashlib
import heapq

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laurel.llm import mixing


def allot(votes, most, ties, house):
    """One seat after the other to the highest quotient."""
    seats = collections.Counter()
    heap = [(-v, t, p) for p, (v, t) in enumerate(zip(votes, ties, strict=True)) if most[p] > 0]
    heapq.heapify(heap)
    for _ in range(house):
        if not heap:
            break
        _, tie, party = heapq.heappop(heap)
        seats[party] += 1
        if seats[party] < most[party]:
            heapq.heappush(heap, (-votes[party] / (2 * seats[party] + 1), tie, party))
    return seats


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from([1.0, 3.0, 7.5, 40.0, 41.0, 900.0, 12345.0])), min_size=1, max_size=40), st.integers(0, 400))
def test_seats_one_by_one(spark, parties, house):
    rows = [(g, i, v, 10_000, i * 7919 % 31, house) for i, (g, v) in enumerate(parties)]
    df = spark.createDataFrame(rows, "grp int, party int, votes double, most bigint, tie bigint, house bigint")
    got = {r.party: r.seats for r in mixing.apportioned(df, "t").collect()}
    assert len(got) == len(rows)
    for grp in {r[0] for r in rows}:
        members = [r for r in rows if r[0] == grp]
        want = allot([r[2] for r in members], [r[3] for r in members], [r[4] for r in members], house)
        assert {r[1]: got[r[1]] for r in members} == {r[1]: want[p] for p, r in enumerate(members)}


def words(n, start=0):
    return " ".join(f"w{start + i}" for i in range(n))


def totals(df):
    rows = df.collect()
    taken, target = collections.Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    return taken, target


@pytest.mark.parametrize("shard_words", [1 << 16, 500])
def test_sparse_sources_take_their_target(spark, monkeypatch, shard_words):
    monkeypatch.setattr(mixing, "SHARD_WORDS", shard_words)
    docs = spark.createDataFrame(
        [(i, "one" if i % 32 == 0 else "", "a") for i in range(12_800)]
        + [(20_000 + i, words(80, i), "b") for i in range(200)],
        "doc_id bigint, text string, source string",
    )
    taken, target = totals(mixing.mix(docs))
    assert target["a"] == 800.0 and abs(taken["a"] - 800) <= 16
    shards = -(-16_000 // shard_words)
    assert abs(taken["b"] - target["b"]) <= 16 + 16 * shards


def test_many_uneven_shards(spark, monkeypatch):
    """Every source's taken words are its seats'; a shard's quota is that of an allotment seat by seat."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 300)
    sizes = {"a": [5, 900, 17, 1, 33] * 30, "b": [60] * 250, None: [1, 2, 3] * 100}
    rows = [(1000 * j + i, words(n), s) for j, (s, v) in enumerate(sizes.items()) for i, n in enumerate(v)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    seeded = lambda *v: int(hashlib.md5("|".join(["mix", *("null" if x is None else str(x) for x in v)]).encode()).hexdigest()[:15], 16)
    by_shard, taken, source_words = collections.Counter(), collections.Counter(), {s: sum(v) for s, v in sizes.items()}
    for r in got:
        shard = seeded(r.doc_id) % -(-source_words[r.source] // 300)
        by_shard[r.source, shard] += r.size
        taken[r.source, shard] += r.taken
    target = {r.source: r.target for r in got}
    names = ["a", "b", None]
    house = int(sum(target.values()) / 16 + 0.5)
    seats = allot([target[s] for s in names], [2 * source_words[s] // 16 for s in names], [seeded(s) for s in names], house)
    for p, source in enumerate(names):
        shards = [k for k in by_shard if k[0] == source]
        quotas = allot(
            [float(by_shard[k]) for k in shards], [2 * by_shard[k] // 16 for k in shards], [seeded(*k) for k in shards], seats[p]
        )
        assert {k: taken[k] for k in shards} == {k: 16 * quotas[i] for i, k in enumerate(shards)}
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_third_of_all_words_in_one_document(spark):
    docs = spark.createDataFrame(
        [(0, words(5000), "a")] + [(i, words(100), "ab"[i % 2]) for i in range(1, 100)], "doc_id bigint, text string, source string"
    )
    taken, target = totals(mixing.mix(docs))
    assert all(abs(taken[s] - target[s]) <= 16 for s in target)
    assert mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0
