"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes: the number of words of a text. Sources, by code point with null last, weigh 3, 1, 2 in turn and share
``SHARE_PERCENT`` of all words; a target stops at ``MOST_PASSES`` times its source's size, and the excess is shared again
by weight among the others until no target is above.

The house is the sum of the targets in blocks of ``BLOCK`` words. Its seats go to the sources by the highest quotients
target / (2k + 1), then each source's seats to its shards by the highest quotients words / (2k + 1); nobody gets more than
``MOST_PASSES`` passes over its words hold. Quotients that surely win are counted by a divisor just above the limit, those
that surely lose by one just below; the few between (at most a few for each party) are ranked in one distributed sort. So
the apportionment is exact, whatever the number of parties. Equal quotients at the limit go by seeded order.

Shards: documents with words are dealt by a seeded hash into shards of about ``SHARD_WORDS`` words (a shard of a source
of few words holds all of them, however many documents they are in). A shard's documents, in seeded order, form one
circular run of words. Its quota of blocks is taken from a seeded place onwards: whole passes, and a rest of consecutive
blocks. The words taken from a document follow from its place in the run by arithmetic: no block is ever a row. A source
takes its seats' words exactly: half a block from its target, or, where the target is two full passes, up to a block less
for each shard.

Everything is DataFrame work; only sums over sources pass through the driver, two or three numbers a round.

Defined cases: null and empty texts have size 0 and give nothing. A null source is a source. Null ids take part.
Equal rows each take part; among them only their order is arbitrary, their sum is not. An empty table gives an empty
result. Only the columns doc_id, source and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laurel.llm.common import WORD, numbered, written

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_PASSES = 2
BLOCK = 16
SHARD_WORDS = 1 << 16
SEED = "mix"
BROADCAST_SOURCES = 20_000  # source rows (some hundred bytes each) that may be broadcast


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every document, stored: all later steps read this narrow table."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    return written(docs.select("doc_id", "source", size.alias("size")), "mix-sizes")


def numbered_sources(sized: DataFrame) -> DataFrame:
    """One row per source: source_size and ``pos``, its place by code point with null last."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return numbered(written(per_source, "mix-source-sizes"), F.col("source").asc_nulls_last(), label="mix-sources")


def with_targets(sources: DataFrame) -> DataFrame:
    """``sources`` with ``target``: its weight's part of the mix, at most MOST_PASSES times its size."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("pos"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = written(sources.withColumn("weight", weight.cast("double")), "mix-weights")
    most = MOST_PASSES * F.col("source_size")
    total, weights = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return rows.withColumn("target", F.lit(0.0))
    wanted = total * SHARE_PERCENT / 100
    level, stopped = wanted / weights, 0
    while True:  # the level only rises, so stopped sources stay stopped
        above = F.col("weight") * level > most
        count, full, open_weight = rows.agg(
            F.count_if(above), F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if count == stopped:
            break
        stopped, level = count, (wanted - full) / open_weight
    return rows.withColumn("target", F.least(F.col("weight") * F.lit(level), most.cast("double")))


def _seeded(*values: Column) -> Column:
    """A 60-bit number from the seed and the values, the same in any engine that has MD5."""
    text = F.concat_ws("|", F.lit(SEED), *(F.coalesce(v.cast("string"), F.lit("null")) for v in values))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def apportioned(parties: DataFrame, label: str) -> DataFrame:
    """``parties`` (columns grp, party, votes, most, tie, house) with ``seats``.

    Each group's house goes by the highest quotients votes / (2k + 1), at most ``most`` seats a party; equal quotients
    by ``tie``. ``house`` is the same for all parties of a group.
    """
    parties = written(parties, f"{label}-parties")
    sums = parties.groupBy("grp").agg(
        F.sum("votes").alias("all_votes"), F.count(F.lit(1)).alias("n"), F.max("house").alias("seats_to_give")
    )
    # seats by divisor d differ from votes / d by half a seat a party at most: sure above the one, not below the other
    slack = F.col("n") / 2 + 2
    fewer = F.greatest(F.col("seats_to_give") - slack, F.lit(0.0)) / F.col("all_votes")
    more = (F.col("seats_to_give") + slack) / F.col("all_votes")
    bounds = sums.select("grp", fewer.alias("fewer"), more.alias("more"), "seats_to_give")
    rounded = lambda rate: F.least(F.floor(F.col("votes") * F.col(rate) + 0.5), F.col("most")).cast("bigint")
    known = parties.join(bounds, "grp").withColumns({"sure": rounded("fewer"), "upto": rounded("more")})
    known = written(known, f"{label}-bounds")
    given = known.groupBy("grp").agg(F.sum("sure").alias("given"))
    open_seats = known.filter("upto > sure").select(
        "grp", "party", "tie", "votes", F.explode(F.expr("sequence(sure, upto - 1)")).alias("k")
    )
    quotients = open_seats.withColumn("quotient", F.col("votes") / (2 * F.col("k") + 1)).drop("votes")
    order = (F.col("grp"), F.col("quotient").desc(), F.col("tie"), F.col("party"), F.col("k"))
    ranked = numbered(written(quotients, f"{label}-quotients"), *order, label=f"{label}-ranks")
    firsts = ranked.groupBy("grp").agg(F.min("pos").alias("first"))
    left = bounds.join(given, "grp").join(firsts, "grp").select(
        "grp", (F.col("first") + F.col("seats_to_give") - F.col("given")).alias("end")
    )
    won = (
        ranked.join(left, "grp").filter("pos < end").groupBy(F.col("grp").alias("__grp"), F.col("party").alias("__party"))
        .agg(F.count(F.lit(1)).alias("won"))
    )
    same = (F.col("grp") == F.col("__grp")) & (F.col("party") == F.col("__party"))
    seats = F.col("sure") + F.coalesce("won", F.lit(0))
    return known.join(won, same, "left").select(*parties.columns, seats.alias("seats"))


def _most_blocks(words: str) -> Column:
    return F.expr(f"({MOST_PASSES} * {words}) div {BLOCK}")


def source_seats(sources: DataFrame) -> DataFrame:
    """``sources`` with ``seats``: the blocks each source gives to the mix."""
    wanted = sources.agg(F.sum("target")).first()[0] or 0.0
    parties = sources.filter("target > 0").select(
        F.lit(0).alias("grp"), F.col("pos").alias("party"), F.col("target").alias("votes"),
        _most_blocks("source_size").alias("most"), _seeded(F.col("source")).alias("tie"),
        F.lit(int(wanted / BLOCK + 0.5)).cast("bigint").alias("house"),
    )
    seats = apportioned(parties, "mix-seats").select(F.col("party").alias("pos"), "seats")
    return sources.join(seats, "pos", "left").withColumn("seats", F.coalesce("seats", F.lit(0)))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document."""
    sized = sizes(docs)
    targets = written(with_targets(numbered_sources(sized)), "mix-targets")
    sources = written(source_seats(targets), "mix-sources-seats")
    side = sources.select(F.col("source").alias("__source"), "pos", "source_size", "target", "seats")
    if sources.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    known = sized.join(side, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    shards = F.expr(f"(source_size + {SHARD_WORDS - 1}) div {SHARD_WORDS}")
    dealt = known.filter("size > 0").withColumn("order", _seeded(F.col("doc_id"))).withColumn(
        "shard", F.pmod(F.col("order"), shards)
    )
    words = dealt.groupBy("pos", "shard").agg(
        F.sum("size").alias("words"), F.first("seats").alias("house"), F.first("source").alias("source")
    )
    parties = words.select(
        F.col("pos").alias("grp"), F.col("shard").alias("party"), F.col("words").cast("double").alias("votes"),
        _most_blocks("words").alias("most"), _seeded(F.col("source"), F.col("shard")).alias("tie"), "house", "words",
    )
    quotas = apportioned(parties, "mix-quotas").select(
        F.col("grp").alias("pos"), F.col("party").alias("shard"), "words", (BLOCK * F.col("seats")).alias("quota"),
        F.expr("tie % words").alias("phase"),
    )
    run = Window.partitionBy("pos", "shard").orderBy("order", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = dealt.withColumn("upto", F.sum("size").over(run)).join(quotas, ["pos", "shard"])
    rest = "(quota - quota div words * words)"

    def before(place: str) -> str:
        """Words of the rest before a place of the run: the rest begins at ``phase`` and goes on at the run's start."""
        ahead = f"least(greatest({place} - phase, 0L), {rest})"
        around = f"least(greatest({place} + words - phase, 0L), {rest})"
        return f"({ahead} + {around})"

    taken = F.expr(f"quota div words * size + {before('upto')} - {before('(upto - size)')}")
    columns = ("doc_id", "source", "size", "source_size", "target")
    without = known.filter("size = 0").select(*columns, F.lit(0).cast("bigint").alias("taken"))
    return placed.select(*columns, taken.alias("taken")).unionByName(without)
