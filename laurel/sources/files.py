"""Header CSV, sectioned text and JSON-object sources; table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_header_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed header CSV; both an empty field and ``NA`` read as NULL for numbers.

    Empty strings stay empty strings, because an empty person is a valid value.
    """
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", "NA")
        .option("emptyValue", "")
        .csv(path)
    )
    strings = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return raw.fillna("", subset=strings) if strings else raw


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their order: (file, block, line_no, line).

    Files stay splittable: a block is one input split of a file, and
    ``line_no`` grows inside it.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )


def forward_fill(
    lines: DataFrame, file: str, block: str, order: str, values: dict[str, Column]
) -> DataFrame:
    """Carry each value (NULL = keep the last one) down a file.

    Done per block; the last value of every block is then carried over the
    block table, so no task ever holds a whole file.
    """
    inside = (
        Window.partitionBy(file, block)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    )
    marked = lines.select("*", *[v.alias(f"__{n}") for n, v in values.items()])
    ends = marked.groupBy(file, block).agg(
        *[
            F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.col(order))).alias(f"__e_{n}")
            for n in values
        ]
    )
    carried = ends.select(
        file,
        block,
        *[F.last(f"__e_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in values],
    )
    filled = marked.select(
        *lines.columns,
        *[F.last(f"__{n}", ignorenulls=True).over(inside).alias(f"__i_{n}") for n in values],
    )
    return filled.join(carried, [file, block], "left").select(
        *lines.columns,
        *[F.coalesce(f"__i_{n}", f"__c_{n}").alias(n) for n in values],
    )


def sectioned_rows(
    lines: DataFrame,
    categories: Sequence[str],
    file: str = "file",
    block: str = "block",
    order: str = "line_no",
    line: str = "line",
) -> DataFrame:
    """Sectioned lines -> (file, order, period, category, work, person).

    A year line holds an integer strictly between 1960 and 2020, a category
    line one of ``categories``; all others are nominees: "work" or "work,person"
    (either part may be quoted).
    """
    text = F.trim(line)
    number = text.try_cast("int")
    year = F.when((number > 1960) & (number < 2020), number)
    # The marker carries the year, so a new year starts without category.
    category = F.when(year.isNotNull(), F.lit("")).otherwise(
        F.when(text.isin(*categories), text)
    )
    filled = forward_fill(
        lines.filter(text != ""), file, block, order, {"period": year, "category": category}
    )
    parts = F.split(F.col(line), ",", 2)
    plain = F.struct(
        parts[0].alias("work"), F.try_element_at(parts, F.lit(2)).alias("person")
    )
    # The CSV parser is only needed where a field is quoted.
    fields = F.when(
        F.col(line).contains('"'), F.from_csv(F.col(line), F.lit("work STRING, person STRING"))
    ).otherwise(plain)
    nominee = number.isNull() | (number <= 1960) | (number >= 2020)
    return (
        filled.filter(nominee & ~text.isin(*categories) & (F.col("category") != ""))
        .withColumn("f", fields)
        .select(
            file,
            order,
            "period",
            "category",
            F.col("f.work").alias("work"),
            F.coalesce(F.col("f.person"), F.lit("")).alias("person"),
        )
    )


def read_sectioned(spark: SparkSession, path: str, categories: Sequence[str]) -> DataFrame:
    return sectioned_rows(numbered_lines(spark, path), categories)


def json_map_entries(df: DataFrame, column: str, value_type: str = "int") -> DataFrame:
    """One row per entry of a JSON object column: (..., key, value)."""
    parsed = F.from_json(F.col(column), f"map<string,{value_type}>")
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(parsed).alias("key", "value"))


def read_json_map(
    spark: SparkSession, path: str, value: str, key: str = "work", value_type: str = "int", object_lines: bool = False
) -> DataFrame:
    """A JSON object of key -> value as (key, value) rows: a whole object or JSON lines.

    ``object_lines``: one object that ``write_json_object`` wrote, an entry a line; each line is read by itself.
    """
    lines = spark.read.text(path).select("value")
    if object_lines:
        entry = F.regexp_replace(F.regexp_replace("value", r"^\{", ""), r"[,}]$", "")
        lines = lines.select(F.concat(F.lit("{"), entry, F.lit("}")).alias("value"))
    entries = json_map_entries(lines, "value", value_type)
    return entries.select(F.col("key").alias(key), F.col("value").alias(value))


def run_date_maps(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(work, start) and (work, end) -> (work, start, end)."""
    return starts.join(ends, "work")


def json_map_lines(df: DataFrame, key: str, value: str) -> DataFrame:
    """Key/value rows as JSON lines, one single-entry object per row."""
    return df.select(F.to_json(F.create_map(F.col(key), F.col(value))).alias("value"))


def write_json_map(df: DataFrame, key: str, value: str, path: str) -> None:
    """Key/value rows as JSON lines, whatever their number."""
    json_map_lines(df, key, value).write.text(path)


def write_json_object(df: DataFrame, key: str, value: str, path: str) -> None:
    """Key/value rows as one JSON object, cut over the part files at line ends and ordered by key.

    The files' lines, in order of their names, are the object.  Keys are ranged over
    the tasks; the line of the least key opens the object, that of the greatest closes it.
    Of equal keys the greatest value stays, null keys have no place in an object.  An empty table is ``{}``.
    """
    entries = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(value))
    ends = entries.agg(F.min(key), F.max(key)).first()
    if ends[0] is None:
        df.sparkSession.createDataFrame([("{}",)], "value string").coalesce(1).write.text(path)
        return
    pair = F.to_json(F.create_map(F.col(key), F.col(value)), {"ignoreNullFields": "false"})
    first, last = F.col(key) == F.lit(ends[0]), F.col(key) == F.lit(ends[1])
    line = F.concat(
        F.when(first, "{").otherwise(""), F.expr("substring(pair, 2, length(pair) - 2)"), F.when(last, "}").otherwise(",")
    )
    entries.sort(key).withColumn("pair", pair).select(line.alias("value")).write.text(path)


def write_sorted_table(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Globally sorted header CSV: one range-partitioned exchange, one file per range."""
    df.sort(*order).write.option("header", True).option("emptyValue", "").csv(path)


def append_by_period(
    df: DataFrame, path: str, spread: Sequence[str], partitions: int | None = None, within: Sequence[str] = ()
) -> None:
    """Add to a store partitioned by period (and ``within``), so that adding the same rows again changes nothing.

    The rows take the place of all rows that the store has for their periods (and ``within`` values); other
    partitions stay.  Rows are ranged over the partitions and ``spread``: few files per
    period, and a dominant period is still written by many tasks.
    """
    order = ["period", *within, *spread]
    ranged = df.repartitionByRange(*order) if partitions is None else df.repartitionByRange(partitions, *order)
    writer = ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("period", *within).parquet(path)


def clean_number(column: str) -> Column:
    """Text to double, 'nan' to 0, unparsable to NULL."""
    x = F.trim(F.col(column)).try_cast("double")
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(x)
