"""Writers that may run twice, objects over many files, orders of a locale, table functions, the shared folder."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from laurel.operators import positions
from laurel.sources import files, html


def test_a_period_stored_again_changes_nothing(spark, noms, tmp_path):
    store = str(tmp_path / "store")
    rows = noms.select("period", "category", "cat_group", "work", "won")
    read = lambda: sorted(map(repr, spark.read.parquet(store).select(*rows.columns).collect()))
    for group in ("acting", "series"):
        files.append_by_period(rows.filter(F.col("cat_group") == group), store, ["category"], within=["cat_group"])
    once = read()
    assert len(once) == rows.count()
    files.append_by_period(rows.filter("period = 2 AND cat_group = 'acting'"), store, ["category"], within=["cat_group"])
    files.append_by_period(rows.filter("cat_group = 'series'"), store, ["category"], 2, within=["cat_group"])
    assert read() == once
    fewer = rows.filter("period = 1 AND cat_group = 'series' AND won = 1")
    files.append_by_period(fewer, store, ["category"], within=["cat_group"])
    assert len(read()) == len(once) - 1  # the period's rows are those given last


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_one_object_over_many_files(spark, tmp_path, n):
    rows = [(f'k"{i:04}, }}', i) for i in range(n)] + [(None, 7)]
    path = str(tmp_path / "object")
    df = spark.createDataFrame(rows, "work string, n bigint").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_json_object(df.unionByName(df.limit(1)), "work", "n", path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(Path(path).glob("part-*"))
    assert n < 1000 or len(parts) > 1
    assert json.loads("".join(p.read_text() for p in parts)) == dict(rows[:n])
    back = files.read_json_map(spark, path, "n", object_lines=True)
    assert sorted(map(tuple, back.collect())) == rows[:n]


def test_null_values_in_an_object(spark, tmp_path):
    files.write_json_object(spark.createDataFrame([("a", None), ("b", 1)], "work string, n int"), "work", "n", str(tmp_path / "o"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))) == {"a": None, "b": 1}


NAMES = ["Zoë", "Élan", "apple", "Ärger", "Bear", "eland", "Zoe", "Elan"]
ORDERS = {
    None: sorted(NAMES, key=lambda x: x.encode()),
    "UNICODE": ["apple", "Ärger", "Bear", "Elan", "Élan", "eland", "Zoe", "Zoë"],
    "de": ["apple", "Ärger", "Bear", "Elan", "Élan", "eland", "Zoe", "Zoë"],
    "sv": ["apple", "Bear", "Elan", "Élan", "eland", "Zoe", "Zoë", "Ärger"],  # Ä is a letter behind Z
}


@pytest.mark.parametrize("collation", ORDERS, ids=str)
def test_names_in_the_order_of_a_locale(spark, collation):
    rows = [(w, n, int(n == w), i) for w in NAMES for i, n in enumerate(sorted(NAMES, key=lambda x: x != w))]
    df = spark.createDataFrame(rows, "contest string, name string, won int, line int")
    place = positions.winner_position(df, ["contest"], ["name", "line"], cap=99, collation=collation)
    index = positions.winner_position_folded(df, ["contest"], "name", ["line"], collation=collation, fold=False)
    want = {n: i for i, n in enumerate(ORDERS[collation])}
    assert {r.contest: r.winner_pos - 1 for r in place.collect()} == want
    assert {r.contest: r.winner_idx for r in index.collect()} == want


def test_accents_and_case_may_be_equal(spark):
    df = spark.createDataFrame(
        [("c", n, int(n == "Zoë"), i) for i, n in enumerate(["Zoë", "zoe", "Elan"])], "contest string, name string, won int, line int"
    )
    index = positions.winner_position_folded(df, ["contest"], "name", ["line"], collation="en_CI_AI")
    assert index.first().winner_idx == 1  # zoe is not before Zoë, Elan is
    assert positions.winner_position_folded(df, ["contest"], "name", ["line"]).first().winner_idx == 1  # bytes: Elan, Zoë, zoe


PAGE = "<table><tr><th>A<th>B</tr><tr><td rowspan=2>x<td>{}</tr><tr><td>z</tr></table>"


def test_table_functions_agree_and_hand_on_small_batches(spark, monkeypatch):
    monkeypatch.setattr(html, "ROWS_PER_BATCH", 5)
    rows = [(f"p{i}", PAGE.format(i) * (1 + i % 3)) for i in range(40)] + [("none", "<p>no"), ("null", None)]
    pages = spark.createDataFrame(rows, "page string, html string")
    by_batch = html.html_cells(pages)
    html.register_html_cells(spark)
    lateral = spark.sql("SELECT page, c.* FROM {pages}, LATERAL html_cells(html) AS c", pages=pages)
    assert by_batch.schema.names == lateral.schema.names
    got = sorted(map(repr, by_batch.collect()))
    assert got == sorted(map(repr, lateral.collect())) and len(got) == sum(6 * (1 + i % 3) for i in range(40))
    assert "Exchange" not in by_batch._jdf.queryExecution().executedPlan().toString()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"page": ["a", "b"], "html": [PAGE * 3, PAGE]})
    taken = iter(html._arrow_batches(batch, html.page_cells, html.to_arrow_schema(html.PAGE_CELLS)))
    assert [len(b) for b in taken] == [5, 5, 5, 5, 4]


SCRIPT = """
from laurel.session import local_session, scratch_path, shared_dir
spark = local_session("1", "1")
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = shared_dir(spark)
assert shared_dir(spark) == first and scratch_path(spark, "x").startswith(first)
spark.range(3).write.parquet(scratch_path(spark, "t"))
spark.stop()
spark = local_session("1", "1")
assert shared_dir(spark) != first
print("fine")
"""


def test_local_session_without_a_shared_folder(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env |= {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.strip().endswith("fine"), done.stderr[-3000:]
