"""Streaming form of the running history.

A stateful operator keeps, for every entity, the counts before its newest period and the rows of that period, in a RocksDB
state store: a micro-batch reads and writes the entities it touches and no others, whatever the number known.

Rows of one period may come in several batches and files, in any order. As a row's history depends on the rows that
sort before it (by category and order key), each batch gives the touched period's rows anew, and ``read_history``
takes an entity's period from the last batch that has it. So the result does not depend on how rows were cut into
batches, as long as periods come in order.

A row older than its entity's newest period is late, as is a row without period: it is written to ``late`` and changes
nothing. A batch's output folder is named by its number and replaced when the batch is replayed after a failure.
An entity's rows of one micro-batch, and of one period, are sorted in one task: let the source limit the files of a
trigger (``maxFilesPerTrigger``) where an entity dominates.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from laurel.operators.groupwise import with_running_totals

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def history_step(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One batch: (history rows, late rows, next state).

    ``rows`` need entity, period, category, order_key and won.
    """
    known = rows.join(state, "entity", "left")
    late_row = F.col("period") < F.coalesce(F.col("last_period"), F.col("period"))
    late = known.filter(late_row).select(*rows.columns)
    fresh = known.filter(~late_row)
    counted = with_running_totals(
        fresh,
        ["entity"],
        ["period", "category"],
        ["order_key"],
        {"__n": F.lit(1), "__w": F.col("won")},
    )
    noms = F.coalesce(F.col("noms"), F.lit(0)) + F.col("__n")
    wins = F.coalesce(F.col("wins"), F.lit(0)) + F.col("__w")
    history = counted.select(
        *rows.columns,
        noms.alias("prev_noms"),
        wins.alias("prev_wins"),
        (noms - wins).alias("prev_losses"),
    )
    gained = fresh.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("won").cast("bigint").alias("w"),
        F.max("period").cast("bigint").alias("p"),
    )
    zero = F.lit(0)
    merged = state.join(gained, "entity", "full").select(
        "entity",
        (F.coalesce("noms", zero) + F.coalesce("n", zero)).alias("noms"),
        (F.coalesce("wins", zero) + F.coalesce("w", zero)).alias("wins"),
        F.greatest("last_period", "p").alias("last_period"),
    )
    return history, late, merged


class HistoryProcessor(StatefulProcessor):
    """Prior nominations, wins and losses of an entity's rows.

    ``before`` holds the counts before the newest period, ``newest`` the rows of that period.
    """

    def __init__(self, rows: T.StructType):
        self.output = Row(*_output_schema(rows).names)
        self.key_type = T.StructType([T.StructField(n, rows[n].dataType) for n in ("category", "order_key", "won")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "noms bigint, wins bigint, period bigint")
        self.newest = handle.getListState("newest", self.key_type)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        noms, wins, period = self.before.get() if self.before.exists() else (0, 0, None)
        by_period: dict[int, list[tuple]] = {}
        for row in rows:
            if row.period is None or (period is not None and row.period < period):
                yield self.output(*key, row.period, row.category, row.order_key, row.won, None, None, None, True)
            else:
                by_period.setdefault(row.period, []).append((row.category, row.order_key, row.won))
        if not by_period:
            return
        last = max(by_period)
        if period in by_period:
            by_period[period] += [tuple(r) for r in self.newest.get()]
        elif period is not None:  # the period is over
            held = [tuple(r) for r in self.newest.get()]
            noms, wins = noms + len(held), wins + sum(r[2] or 0 for r in held)
        for at in sorted(by_period):
            if at == last:
                self.before.update((noms, wins, at))
                self.newest.put(by_period[at])
            for category, order_key, won in sorted(by_period[at], key=_nulls_first):
                yield self.output(*key, at, category, order_key, won, noms, wins, noms - wins, False)
                noms, wins = noms + 1, wins + (won or 0)

    def close(self) -> None:
        pass


def _nulls_first(row: tuple) -> tuple:
    return tuple((value is not None, value) for value in row)


def _output_schema(rows: T.StructType) -> T.StructType:
    given = [rows[n] for n in ("entity", "period", "category", "order_key", "won")]
    counts = [T.StructField(n, T.LongType()) for n in ("prev_noms", "prev_wins", "prev_losses")]
    return T.StructType([T.StructField(f.name, f.dataType) for f in given] + counts + [T.StructField("late", T.BooleanType())])


def stream_history(rows: DataFrame, root: str) -> StreamingQuery:
    """Start the fold over a streaming DataFrame; output under ``root``/history and ``root``/late.

    ``rows`` need entity, period, category, order_key and won.
    """
    spark = rows.sparkSession
    spark.conf.set(STATE_STORE, ROCKS_DB)
    needed = rows.select("entity", "period", "category", "order_key", "won")
    folded = needed.groupBy("entity").transformWithState(
        HistoryProcessor(needed.schema), _output_schema(needed.schema), "Update", "None"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            kept = batch.filter("NOT late").drop("late")
            kept.write.mode("overwrite").parquet(f"{root}/history/batch={batch_id}")
            late = batch.filter("late").select(*needed.columns)
            late.write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        folded.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}/checkpoint")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """The history so far: every entity's period as the last batch that touched it gave it."""
    given = spark.read.parquet(f"{root}/history")
    latest = given.groupBy("entity", "period").agg(F.max("batch").alias("batch"))
    same = given["entity"].eqNullSafe(latest["entity"]) & (given["period"] == latest["period"])
    return given.join(latest, same & (given["batch"] == latest["batch"]), "left_semi").drop("batch")
