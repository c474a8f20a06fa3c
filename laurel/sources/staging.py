"""Derived tables written once to the shared folder and reused.

Reports, lag joins and model fits read the same few derived tables many times.
Writing them cuts the lineage at a point that survives the loss of executors,
and the large inputs are scanned once instead of once per use.

A staged table belongs to one application and to one state of its input files
(path, size, time stamp): changed inputs are staged anew.

A table can be staged in buckets of a key.  Grouping, windows and joins on that
key then need no shuffle, however often the table is read.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from laurel.session import scratch_path

BUCKET_BYTES = 8 << 20  # of input a bucket: some 400,000 order lines, sorted without spilling

_lock = threading.RLock()  # building one table may stage another
_tables: dict[str, tuple[str, T.StructType | None]] = {}  # folder and schema, or the name of a table in buckets


def _fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = [spark.sparkContext.applicationId]
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        status = path.getFileSystem(conf).getFileStatus(path)
        parts.append(f"{p}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def bucket_count(spark: SparkSession, path: str) -> int:
    """Buckets for a table that grows with the input at ``path``, a file or a folder.

    No fewer than the session's shuffle partitions, as a join would deal the rows over those otherwise.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def staged(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    inputs: Sequence[str],
    build: Callable[[], DataFrame],
    spread: Sequence[str] = (),
    buckets: tuple[int, str] | None = None,
) -> DataFrame:
    """The derived table ``name``, built on first use.

    ``spread`` (a row key) deals the rows evenly over as many files as the
    cluster has cores, so that later readers use all of them.  ``buckets`` is a
    number and a key whose buckets are kept on disk: ``build`` best ends with the
    rows dealt over that number by that key, as each file is then one bucket.
    """
    key = name + ":" + _fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in inputs])
    with _lock:
        if key not in _tables:
            path = scratch_path(spark, f"staged-{name}")
            table = build()
            if spread:
                table = table.repartition(spark.sparkContext.defaultParallelism, *spread)
            if buckets:  # only a table of the catalogue remembers its buckets
                name = f"spark_catalog.default.{path.rstrip('/').rpartition('/')[2].replace('-', '_')}"
                table.write.bucketBy(*buckets).option("path", path).format("parquet").saveAsTable(name)
                _tables[key] = (name, None)
            else:
                table.write.parquet(path)
                _tables[key] = (path, table.schema)
    path, schema = _tables[key]
    if schema is None:
        return spark.table(path)
    return spark.read.schema(schema).parquet(path)


def forget_staged() -> None:
    """Build every staged table anew on its next use."""
    with _lock:
        _tables.clear()
