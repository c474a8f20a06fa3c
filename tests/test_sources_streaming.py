import pytest
from pyspark.sql import functions as F

from laurel.operators import history as H
from laurel.schema import NOMINATIONS, RATINGS
from laurel.sources import files, html
from laurel.streaming.history import history_step, read_history, stream_history

PAGE = """<!-- <table><tr><td>no</td></tr></table> --><table><tr><th>Year</th><th>Actor</th></tr>
<tr><td rowspan=2>1999</td><td><a href="/x?a>b">Ann</a> &amp; <i>co</i></td></tr><tr><td><i>Bob</i></td></tr></table>
<table><tr><th>Other</th></tr><tr><td>x<table><tr><td>in</td></tr></table></td></tr></table>"""


def test_csv_null_and_empty(spark, tmp_path):
    (tmp_path / "n.csv").write_text('category,period,work,person,won\nA,1972,"W, one",,1\nB,NA,W2,Ann,0\n')
    rows = files.read_header_csv(spark, str(tmp_path / "n.csv"), NOMINATIONS).orderBy("category").collect()
    assert tuple(rows[0]) == ("A", 1972, "W, one", "", 1)
    assert rows[1].period is None and rows[1].person == "Ann"
    (tmp_path / "r.csv").write_text("work,season,season_start,num_eps,av_rating,av_num_votes\nW,1,1999,10,8.1,\n")
    assert files.read_header_csv(spark, str(tmp_path / "r.csv"), RATINGS).first().av_num_votes is None


@pytest.mark.parametrize("split", [None, "60"])
def test_sectioned_file(spark, tmp_path, split):
    text = "1972\nActor Drama\nShow A,Ann Lee\n\"Show, B\",Bob\nShow Drama\nShow A\n24\n1973\nActor Drama\nShow C,Cy\n"
    (tmp_path / "s.csv").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:  # cut the file inside its sections
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = files.read_sectioned(spark, str(tmp_path / "s.csv"), ["Actor Drama", "Show Drama"])
        rows = [tuple(r) for r in out.orderBy("period", "category", "work").select("period", "category", "work", "person").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == [
        (1972, "Actor Drama", "Show A", "Ann Lee"),
        (1972, "Actor Drama", "Show, B", "Bob"),
        (1972, "Show Drama", "24", ""),
        (1972, "Show Drama", "Show A", ""),
        (1973, "Actor Drama", "Show C", "Cy"),
    ]


def test_json_maps_and_store(spark, noms, tmp_path):
    runs = spark.createDataFrame([("A", 1990, 1995), ("B", 2000, 2016)], "work string, start int, end int")
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    files.write_json_map(runs, "work", "start", one)
    files.write_json_map(runs, "work", "end", many)
    assert spark.read.text(one).count() == spark.read.text(many).count() == 2
    joined = files.run_date_maps(files.read_json_map(spark, one, "start"), files.read_json_map(spark, many, "end"))
    assert sorted(map(tuple, joined.collect())) == [("A", 1990, 1995), ("B", 2000, 2016)]
    store = str(tmp_path / "store")
    files.append_by_period(noms.filter("period = 1"), store, ["category"])
    files.append_by_period(noms.filter("period > 1"), store, ["category"])
    assert spark.read.parquet(store).count() == noms.count()
    csv = str(tmp_path / "csv")
    table = noms.select("category", "period", "work", "person", "won")
    files.write_sorted_table(table, csv, ["period", "category", "work"])
    assert sorted(map(tuple, files.read_header_csv(spark, csv, NOMINATIONS).collect())) == sorted(map(tuple, table.collect()))


def test_html_cells(spark):
    pages = spark.createDataFrame([("p", PAGE), ("q", "<p>none</p>")], "page string, html string")
    cells = html.html_cells(pages)
    rows = {(r.table_no, r.row_no, r.col_no): r for r in cells.collect()}
    assert rows[(0, 1, 0)].rowspan == 2 and rows[(0, 1, 1)].text == "Ann & co" and rows[(0, 1, 1)].header == "Actor"
    assert rows[(2, 0, 0)].text == "in"
    linked = {(r.row_no, r.text, r.rowspan) for r in html.linked_cells(cells).collect()}
    assert linked == {(1, "Ann", 1), (2, "Bob", 1)}
    record = html.table_records(cells, ["Year", "Actor"], 0, 0).orderBy("row_no").first()
    assert (record.Year, record.Actor) == ("1999", "Ann & co")


def test_rowspan_carry():
    grid = list(html.carry_rowspans([("a", 2), ("b", 1), ("c", 1), ("d", 3)], 2))
    assert grid == [(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "c"), (2, 0, "d")]


def test_header_blocks(spark):
    lines = ["<b>Best TV Actor Drama</b>", '<a href="/1">Show A</a>', ">Ann</a>", "text", '<a href="/2">Show B</a>', ">Bob</a>",
             "<h2>Next</h2>", '<a href="/3">Hidden</a>', ">No</a>", "Best Television Series Comedy"]
    lines += ["x"] * 47 + ['<a href="/4">Show C</a>', "x", '<a href="/5">Too far</a>']
    pages = spark.createDataFrame([("p", "\n".join(lines))], "page string, html string")
    got = {(r.category, r.work, r.person) for r in html.header_blocks(pages, 49).collect()}
    assert got == {("Actor Drama", "Show A", "Ann"), ("Actor Drama", "Show B", "Bob"), ("Show Comedy", "Show C", "")}
    assert {r.work for r in html.header_blocks(pages).collect()} == {"Show A", "Show B", "Show C", "Too far"}


def event_rows(spark, noms):
    return noms.filter("cat_group = 'acting'").select(
        F.col("person").alias("entity"), "period", "category", (F.col("work")).alias("order_key"), "won"
    )


def test_stream_equals_batch_and_drops_late(spark, noms, tmp_path):
    rows = event_rows(spark, noms)
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    for period in (1, 2, 3):
        rows.filter(F.col("period") == period).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).parquet(src)
        stream_history(stream, root).awaitTermination()
    late = spark.createDataFrame([("Ann Lee", 1, "A", "W9", 1)], rows.schema)
    late.write.mode("append").parquet(src)
    stream_history(spark.readStream.schema(rows.schema).parquet(src), root).awaitTermination()
    got = {(r.period, r.category, r.entity, r.order_key): r.prev_noms for r in spark.read.parquet(f"{root}/history").collect()}
    acting = noms.filter("cat_group = 'acting'")
    batch = H.with_history(acting, order=["work"]).collect()
    assert got == {(r.period, r.category, r.person, r.work): r.prev_noms for r in batch}
    assert spark.read.parquet(f"{root}/late").count() == 1


def test_periods_cut_over_batches_and_files(spark, tmp_path):
    """Every period comes in three batches of two files, each in reverse order; state of others stays as it is."""
    rows = [
        (f"e{i % 3}" if i % 11 else None, 1 + i // 40, "AB"[i % 2], (i * 7) % 40, int(i % 4 == 0)) for i in range(160)
    ]
    schema = "entity string, period int, category string, order_key int, won int"
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    for period in (1, 2, 3, 4):
        for part in (2, 1, 0):
            some = [r for r in rows if r[1] == period and r[3] % 3 == part]
            spark.createDataFrame(some, schema).repartition(2).write.mode("append").parquet(src)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
            stream_history(stream, root).awaitTermination()
    want, seen = {}, {}
    for entity, period, category, order_key, won in sorted(rows, key=lambda r: r[1:]):
        noms, wins = seen.get(entity, (0, 0))
        want[entity, period, category, order_key] = (won, noms, wins, noms - wins)
        seen[entity] = (noms + 1, wins + won)
    got = read_history(spark, root).collect()
    assert {tuple(r)[:4]: tuple(r)[4:] for r in got} == want and len(got) == len(rows)
    assert spark.read.parquet(f"{root}/late").count() == 0
    only = spark.createDataFrame([("e1", 5, "A", 1, 1), ("new", 1, "A", 1, 1)], schema)
    only.coalesce(1).write.mode("append").parquet(src)
    query = stream_history(spark.readStream.schema(schema).parquet(src), root)
    query.awaitTermination()
    assert sum(o.numRowsUpdated for o in query.lastProgress.stateOperators) <= 2 * 3  # two entities of five, not all


def test_step_is_repeatable(spark, noms):
    rows = event_rows(spark, noms)
    state = spark.createDataFrame([("Ann Lee", 4, 1, 0)], "entity string, noms bigint, wins bigint, last_period bigint")
    history, late, merged = history_step(rows, state)
    assert late.count() == 0
    assert history.filter("entity = 'Ann Lee'").agg(F.min("prev_noms")).first()[0] == 4
    assert {r.entity: r.noms for r in merged.collect()}["Ann Lee"] == 9


def test_spanned_cells():
    from laurel.sources.html import parse_cells

    page = (
        "<table><tr><th>Year<th>Actor<th>Program</tr><tr><td rowspan=2>1999</td><td>Ann</td><td>W1</td></tr>"
        "<tr><td>Bob</td><td>W2</td></tr><tr><td colspan='2'>both</td><td rowspan=9>tail</td></tr><tr><td>x</table>"
    )
    grid = {(c["row_no"], c["col_no"]): (c["text"], c["spanned"]) for c in parse_cells(page)}
    assert [grid[2, i] for i in range(3)] == [("1999", True), ("Bob", False), ("W2", False)]
    assert [grid[3, i] for i in range(3)] == [("both", False), ("both", True), ("tail", False)]
    assert grid[4, 0] == ("x", False) and grid[4, 2] == ("tail", True) and max(r for r, _ in grid) == 4
