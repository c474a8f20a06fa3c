"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.window import Window

from laurel.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"  # bytes.split() cuts at exactly these characters
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SEPARATORS = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or chr(b).isalpha()))
LOWER_ALNUM = bytes.maketrans(
    bytes(range(0x41, 0x5B)) + _SEPARATORS, bytes(range(0x61, 0x7B)) + b" " * len(_SEPARATORS)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, stored in the shared folder: lineage ends here and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, *order: Column, label: str) -> DataFrame:
    """``rows`` with ``pos``, their places 0, 1, 2 .. in ``order``. Every task numbers its own range of rows; only one
    count for each range meets in a window. The ranges are sampled, so ``rows`` should be cheap to read twice."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("__at", F.monotonically_increasing_id()), label)
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return (
        placed.join(before, part == before["__part"])
        .withColumn("pos", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1))
        .select(*rows.columns, "pos")
    )


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS_PER_BATCH = 1000


def utf8(text: Column | str) -> Column:
    """Text as UTF-8 bytes, null as empty, for Python functions.

    Spark hands rows to Python in batches of a number of rows, whatever their length; the session's number is lowered to
    TEXTS_PER_BATCH, so that batches of long texts stay small.
    """
    spark = SparkSession.active()
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= TEXTS_PER_BATCH:
        spark.conf.set(BATCH_ROWS, TEXTS_PER_BATCH)
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


_SPARK = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.float64(): T.DoubleType()}


def per_text(function: Callable[[bytes], tuple], schema: pa.StructType):
    """An Arrow UDF that applies ``function`` to each text's bytes and returns its tuple as a struct."""

    @F.arrow_udf(T.StructType([T.StructField(field.name, _SPARK[field.type]) for field in schema]))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [function(value.as_py()) for value in batch]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.StructArray.from_arrays(
                [pa.array(column, field.type) for column, field in zip(columns, schema, strict=True)],
                fields=list(schema),
            )

    return run.asNondeterministic()  # costly: never copied into a filter or a second projection


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded length from an iterator of row tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(columns, schema, strict=True)], schema=schema
    )
