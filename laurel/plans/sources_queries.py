"""Queries over sources and sinks (scan, sectioned text, JSON, HTML, writers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions import text
from laurel.operators.groupwise import with_position
from laurel.plans.registry import query
from laurel.session import scratch_path
from laurel.sources import files, html, tables
from laurel.schema import NOMINATIONS

# The five order priorities used as contest categories.
CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "read_table",
    "SELECT o_orderkey AS contest, o_orderpriority AS category, CAST(year(o_orderdate) AS INT) AS period, "
    "o_orderstatus AS status, o_totalprice AS total FROM orders",
)
def read_table(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("contest"),
        F.col("o_orderpriority").alias("category"),
        F.year("o_orderdate").alias("period"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"),
    )


@query(
    "read_csv_table",
    """SELECT o_orderkey AS contest, o_orderpriority || ', "' || o_orderstatus || '"' AS label,
       CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS person,
       CASE WHEN o_orderstatus <> 'O' THEN CAST(year(o_orderdate) AS INT) END AS period FROM orders""",
)
def read_csv_table(spark: SparkSession, d: str) -> DataFrame:
    """Orders through a header CSV: quoted commas and quotes, empty strings, numbers that are ``NA``."""
    status = F.col("o_orderstatus")
    orders = tables.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("contest"),
        F.concat("o_orderpriority", F.lit(', "'), status, F.lit('"')).alias("label"),
        F.when(status != "F", status).otherwise("").alias("person"),
        F.when(status != "O", F.year("o_orderdate")).alias("period"),
    )
    path = scratch_path(spark, "csv")
    orders.write.option("header", True).option("nullValue", "NA").csv(path)
    return files.read_header_csv(spark, path, orders.schema)


def sectioned_lines(spark: SparkSession, d: str) -> DataFrame:
    """Nominations rendered as sectioned text: year, category and nominee lines.

    One file per category group.  The line number orders year, category, month
    and listing; blocks stand for the splits of a large file and cut sections.
    """
    noms = tables.nominations(spark, d)
    year = (F.floor((F.col("period") - 1) / 12) + 1995).cast("bigint")
    year_no = (year - 1900) * 10**14
    section = F.substring("category", 1, 1).cast("bigint") * 10**12
    listed = tables.with_listing_pos(noms).withColumn("year_no", year_no)
    noms = noms.withColumn("year", year).withColumn("year_no", year_no)
    years = noms.select("cat_group", "year", "year_no").distinct()
    heads = noms.select("cat_group", "year_no", "category").distinct()
    nominee = F.when(F.col("cat_group") == "series", F.col("work")).otherwise(
        F.concat_ws(",", "work", "person")
    )
    order = F.col("year_no") + section + F.col("period").cast("bigint") * 10**9 + F.col("pos")

    def lines(df: DataFrame, line_no, line) -> DataFrame:
        return df.select(F.col("cat_group").alias("file"), line_no.alias("line_no"), line.alias("line"))

    out = (
        lines(years, F.col("year_no"), F.col("year").cast("string"))
        .unionByName(lines(heads, F.col("year_no") + section, F.col("category")))
        .unionByName(lines(listed, order, nominee))
    )
    return out.withColumn("block", F.expr("line_no div 10000000000"))


@query(
    "sectioned_to_rows",
    "SELECT cat_group AS file, CAST((period - 1) // 12 + 1995 AS INT) AS period, category, "
    "CAST(period AS BIGINT) * 1000000000 + pos AS pos, work, person FROM t_pos",
)
def sectioned_to_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = files.sectioned_rows(sectioned_lines(spark, d), CATEGORIES)
    return rows.select(
        "file", "period", "category", (F.col("line_no") % 10**12).alias("pos"), "work", "person"
    )


@query(
    "json_map_rows",
    """SELECT event_id, key, CAST(v AS INT) AS value FROM (
         SELECT event_id, unnest(map_keys(m)) AS key, unnest(map_values(m)) AS v
         FROM (SELECT event_id, CAST(CAST(props AS JSON) AS MAP(VARCHAR, INT)) AS m FROM events))""",
)
def json_map_rows(spark: SparkSession, d: str) -> DataFrame:
    return files.json_map_entries(tables.table(spark, d, "events").select("event_id", "props"), "props")


@query(
    "json_run_dates",
    "SELECT work, CAST(s AS INT) AS start_period, CAST(e AS INT) AS end_period FROM t_runs",
)
def json_run_dates(spark: SparkSession, d: str) -> DataFrame:
    """Start and end maps written as JSON text, parsed back and joined."""
    runs = tables.run_dates(tables.nominations(spark, d))
    as_map = lambda c, name: files.json_map_entries(
        files.json_map_lines(runs, "work", c), "value"
    ).select(F.col("key").alias("work"), F.col("value").alias(name))
    return files.run_date_maps(as_map("start", "start_period"), as_map("end", "end_period"))


@query(
    "cast_clean_csv",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS num_wins,
              CASE WHEN l_tax = 0 THEN 0.0 ELSE round(l_discount * 100, 6) END AS win_pct
       FROM lineitem""",
)
def cast_clean_csv(spark: SparkSession, d: str) -> DataFrame:
    raw = tables.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("bigint").cast("string").alias("num_wins"),
        F.when(F.col("l_tax") == 0, "nan").otherwise(F.col("l_discount").cast("string")).alias("frac"),
    )
    return raw.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("num_wins").try_cast("bigint").alias("num_wins"),
        F.round(files.clean_number("frac") * 100, 6).alias("win_pct"),
    )


def nominee_pages(spark: SparkSession, d: str) -> DataFrame:
    """One stored page per nominee with a links table and a listing table, plus the raw pages."""
    noms = tables.nominations(spark, d)
    body = F.concat(
        F.lit("<html><body><table><tr><th>Note</th></tr><tr><td>plain</td></tr></table>"),
        F.lit("<table><tr><th>Year</th><th>Program</th><th>Actor</th></tr><tr><td rowspan=\"2\">"),
        F.col("period").cast("string"),
        F.lit("</td><td><i>"),
        F.col("work"),
        F.lit("</i></td><td><a href=\"/p\">"),
        F.when(F.col("person") == "", F.lit("none")).otherwise(F.col("person")),
        F.lit("</a> &amp; co</td></tr><tr><td colspan=\"2\">both "),
        F.col("work"),
        F.lit("</td></tr></table></body></html>"),
    )
    made = noms.select(F.concat_ws("|", "period", "category", "person", "work").alias("page"), body.alias("html"))
    raw = tables.table(spark, d, "pages").select("url", "html").withColumnRenamed("url", "page")
    return made.unionByName(raw)


_PAGE = "concat_ws('|', period, category, person, work)"


@query(
    "html_table_cells",
    f"""SELECT {_PAGE} AS page, 1 AS table_no, 1 AS row_no, CAST(period AS VARCHAR) AS year_text, work AS program,
               CASE WHEN person = '' THEN 'none' ELSE person END || ' & co' AS actor FROM t_noms
        UNION ALL
        SELECT {_PAGE}, 1, 2, CAST(period AS VARCHAR), 'both ' || work, 'both ' || work FROM t_noms""",
)
def html_table_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = html.html_cells(nominee_pages(spark, d))
    rows = html.table_records(cells, ["Year", "Program", "Actor"], 1, 1)
    return rows.select(
        "page", "table_no", "row_no", F.col("Year").alias("year_text"),
        F.col("Program").alias("program"), F.col("Actor").alias("actor"),
    )


@query(
    "html_cell_text",
    f"""SELECT {_PAGE} AS page, 1 AS col_no, work AS text, 1 AS rowspan FROM t_noms
        UNION ALL
        SELECT {_PAGE}, 2, CASE WHEN person = '' THEN 'none' ELSE person END, 1 FROM t_noms""",
)
def html_cell_text(spark: SparkSession, d: str) -> DataFrame:
    html.register_html_cells(spark)
    pages = nominee_pages(spark, d).filter(F.lower("html").contains("<table"))
    cells = spark.sql("SELECT page, c.* FROM {pages}, LATERAL html_cells(html) AS c", pages=pages)
    return html.linked_cells(cells).select("page", "col_no", "text", "rowspan")


@query(
    "rowspan_carry",
    f"""SELECT {_PAGE} AS page, CAST(r AS INT) AS row, CAST(c AS INT) AS col,
               CASE WHEN c = 0 THEN CASE WHEN r < span THEN category ELSE 'next' END
                    ELSE CASE WHEN c = 1 THEN work ELSE 'x' || person END || r END AS text
        FROM (SELECT *, 1 + (won + length(work)) % 2 AS span FROM t_noms), range(0, 3) a(r), range(0, 3) b(c)""",
)
def rowspan_carry(spark: SparkSession, d: str) -> DataFrame:
    """A 3 x 3 grid per nominee whose first column spans one or two rows."""
    noms = tables.nominations(spark, d)
    span = 1 + (F.col("won") + F.length("work")) % 2

    def row(r: int):
        first = F.lit("")
        if r == 0:
            first = F.concat(F.lit('<td rowspan="'), span.cast("string"), F.lit('"><i>'), F.col("category"), F.lit("</i></td>"))
        elif r == 1:
            first = F.when(span == 1, F.lit('<td rowspan="2"><i>next</i></td>')).otherwise("")
        else:
            first = F.when(span == 2, F.lit("<td><i>next</i></td>")).otherwise("")
        return F.concat(
            F.lit("<tr>"), first,
            F.lit("<td><a>"), F.col("work"), F.lit(f"{r}</a></td><td><a>x"),
            F.col("person"), F.lit(f"{r}</a></td></tr>"),
        )

    pages = noms.select(
        F.concat_ws("|", "period", "category", "person", "work").alias("page"),
        F.concat(F.lit("<table>"), row(0), row(1), row(2), F.lit("</table>")).alias("html"),
    )
    return html.rowspan_grid(pages, 3)


@query(
    "extract_links",
    r"""SELECT page_id, CAST(link_no AS INT) AS link_no, href, regexp_extract(href, '(.{4})\?', 1) AS year_text FROM (
          SELECT page_id, unnest(l) AS href, unnest(range(len(l))) AS link_no
          FROM (SELECT page_id, regexp_extract_all(html || '<a href="' || url || '">', '<a href="([^"]*)"', 1) AS l FROM pages))
        WHERE contains(href, 'e')""",
)
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    pages = tables.table(spark, d, "pages")
    # The page's own address counts as its last link: it may carry the '?' suffix.
    own = F.concat("html", F.lit('<a href="'), "url", F.lit('">'))
    return html.extract_links(pages.select("page_id", own.alias("html")), "e")


@query(
    "extract_block_after_header",
    f"""SELECT {_PAGE} AS page, CASE WHEN cat_group = 'acting' THEN 'Actor Drama' ELSE 'Show Comedy' END AS category,
               work, person FROM t_noms""",
)
def extract_block_after_header(spark: SparkSession, d: str) -> DataFrame:
    noms = tables.nominations(spark, d)
    head = F.when(F.col("cat_group") == "acting", "<b>Best TV Actor - Drama</b>").otherwise(
        "<b>Best Television Series - Comedy</b>"
    )
    page = F.concat(
        F.lit("<html>\n"), head, F.lit('\n<p>\n<a href="/w">'), F.col("work"), F.lit('</a>\n>'),
        F.col("person"), F.lit('</a>\n<h2>Other</h2>\n<a href="/x">after</a>\n>nobody</a>\n</html>'),
    )
    pages = noms.select(
        F.concat_ws("|", "period", "category", "person", "work").alias("page"), page.alias("html")
    )
    return html.header_blocks(pages).select("page", "category", "work", "person")


@query(
    "parse_title_years",
    """SELECT o_orderkey AS contest, CASE WHEN p < '5' THEN y END AS start_year,
              CASE WHEN p < '2' THEN y + 3 WHEN p < '3' THEN 2016 WHEN p < '5' THEN y + 1 END AS end_year
       FROM (SELECT o_orderkey, o_orderpriority AS p, CAST(year(o_orderdate) AS INT) AS y FROM orders)""",
)
def parse_title_years(spark: SparkSession, d: str) -> DataFrame:
    y = F.year("o_orderdate")
    p = F.col("o_orderpriority")
    kind = (
        F.when(p < "2", F.format_string("TV Series %d–%d", y, y + 3))
        .when(p < "3", F.format_string("TV Series %d– ", y))
        .when(p < "4", F.format_string("TV Mini-Series %d", y))
        .when(p < "5", F.format_string("TV Movie %d", y))
        .otherwise("Video Game")
    )
    titles = tables.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("contest"), F.concat(F.lit("<title>Order ("), kind, F.lit(")</title>")).alias("title")
    )
    start, end = text.parse_title_years("title")
    return titles.select("contest", start.alias("start_year"), end.alias("end_year"))


@query(
    "write_sorted_table",
    "SELECT category, period, work, person, won FROM t_noms",
)
def write_sorted_table(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "sorted")
    noms = tables.nominations(spark, d).select("category", "period", "work", "person", "won")
    files.write_sorted_table(noms, path, ["period", "category", "work", "person"])
    return files.read_header_csv(spark, path, NOMINATIONS)


@query(
    "append_by_period",
    "SELECT period, cat_group, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins FROM t_noms GROUP BY 1, 2",
)
def append_by_period(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "by-period")
    noms = tables.nominations(spark, d)
    for group in ("acting", "series", "acting"):  # a group that comes again takes the place of its former rows
        files.append_by_period(noms.filter(F.col("cat_group") == group), path, ["category", "work"], within=["cat_group"])
    stored = spark.read.parquet(path)
    return stored.groupBy("period", "cat_group").agg(
        F.count(F.lit(1)).alias("n"), F.sum("won").alias("wins")
    )


@query(
    "write_json_map",
    "SELECT '{\"' || candidate || '\":' || count(*) || '}' AS value FROM t_noms GROUP BY candidate",
)
def write_json_map(spark: SparkSession, d: str) -> DataFrame:
    counts = tables.nominations(spark, d).groupBy("candidate").agg(F.count(F.lit(1)).alias("n"))
    return files.json_map_lines(counts, "candidate", "n")


@query(
    "write_json_object",
    """SELECT candidate, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY candidate) AS BIGINT) AS place
       FROM t_noms GROUP BY 1""",
)
def write_json_object(spark: SparkSession, d: str) -> DataFrame:
    """One JSON object over ordered part files, read back; the entries stand in key order."""
    counts = tables.nominations(spark, d).groupBy("candidate").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "json-object")
    files.write_json_object(counts, "candidate", "n", path)
    back = files.read_json_map(spark, path, "n", "candidate", "bigint", object_lines=True)
    return with_position(back, [], F.substring("candidate", 1, 1), ["candidate"], "place")


@query(
    "literal_table",
    """SELECT category, period, work, person, won FROM t_noms
       UNION ALL SELECT '0-MANUAL', 12, 'Manual work', 'Manual person', 0""",
)
def literal_table(spark: SparkSession, d: str) -> DataFrame:
    manual = spark.createDataFrame([("0-MANUAL", 12, "Manual work", "Manual person", 0)], NOMINATIONS)
    return tables.nominations(spark, d).select(*manual.columns).unionByName(manual)
