"""Tables, cells, links and blocks from stored HTML pages.

Table parsing is the only Python step: table functions over (page, html) rows that
hand on rows page by page, without a shuffle.  ``html_cells`` takes whole Arrow
batches (a TABLE argument); ``LateralCells`` is the same for LATERAL joins in SQL,
where Spark takes no Arrow function.  Both hold the cells of one page and one
batch of ``ROWS_PER_BATCH`` rows at most.  Links and blocks are native expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


_TOKEN = re.compile(
    r"<!--.*?-->|<(?P<raw>script|style)\b.*?</(?P=raw)\s*>"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ROWSPAN = re.compile(r"\browspan\s*=\s*[\"']?(\d+)", re.I)
_COLSPAN = re.compile(r"\bcolspan\s*=\s*[\"']?(\d+)", re.I)
MOST_SPAN = {_ROWSPAN: 65534, _COLSPAN: 1000}  # fixed values of the HTML standard


def parse_cells(html: str) -> list[dict]:
    """Table cells of a page: table, row and column number, tag, texts, rowspan.

    One pass over the tags; markup other than tables, links and italics only
    separates text.  Cells close at the next cell, row or table tag.  A cell that
    spans rows or columns comes once for every grid place it covers, ``spanned``
    at all places but its first.
    """
    out: list[dict] = []
    covered: list[tuple[dict, int, int]] = []  # (cell, row, column) of further grid places
    tables = 0
    stack: list[list] = []  # per open table: [number, row, next column, {column: (rows left, cell)}]

    def carry(table: list, upto: int | None) -> None:
        """Lays cells from rows above into the row, at the next column, or at all columns left."""
        while table[3] and (table[2] in table[3] or (upto is None and table[2] <= max(table[3]))):
            if table[2] in table[3]:
                left, above = table[3].pop(table[2])
                covered.append((above, table[1], table[2]))
                if left > 1:
                    table[4][table[2]] = (left - 1, above)
            table[2] += 1

    cell: dict | None = None
    inner: str | None = None  # the a or i element being read
    last = 0
    for m in _TOKEN.finditer(html or ""):
        if cell is not None and m.start() > last:
            _add_text(cell, inner, html[last : m.start()])
        last = m.end()
        tag = (m["tag"] or "").lower()
        if tag in ("a", "i"):
            if m["end"]:
                inner = None if inner == tag else inner
            elif cell is not None and cell[tag] is None:
                cell[tag], inner = "", tag
        elif tag in ("table", "tr", "td", "th"):
            if cell is not None:
                out.append(cell)
                cell = inner = None
            if m["end"]:
                if tag == "table" and stack:
                    carry(stack[-1], None)
                    stack.pop()
            elif tag == "table":
                stack.append([tables, -1, 0, {}, {}])
                tables += 1
            elif stack and tag == "tr":
                table = stack[-1]
                carry(table, None)
                table[1:] = [table[1] + 1, 0, table[3] | table[4], {}]
            elif stack:
                table = stack[-1]
                table[1] = max(table[1], 0)
                carry(table, table[2])
                rows, wide = (_span(pattern, m["attrs"]) for pattern in (_ROWSPAN, _COLSPAN))
                cell = {
                    "table_no": table[0], "row_no": table[1], "col_no": table[2], "tag": tag,
                    "text": "", "a": None, "i": None, "rowspan": rows, "spanned": False,
                }
                for col in range(table[2], table[2] + wide):
                    if col > table[2]:
                        covered.append((cell, table[1], col))
                    if rows > 1:
                        table[4][col] = (rows - 1, cell)
                table[2] += wide
    if cell is not None:
        _add_text(cell, inner, html[last:])
        out.append(cell)
    for table in stack:
        carry(table, None)
    return out + [above | {"row_no": row, "col_no": col, "spanned": True} for above, row, col in covered]


def _span(pattern: re.Pattern[str], attributes: str) -> int:
    """The span an attribute asks for, within the bounds that the markup language sets."""
    found = pattern.search(attributes)
    return min(max(int(found[1]), 1), MOST_SPAN[pattern]) if found else 1


def _add_text(cell: dict, inner: str | None, text: str) -> None:
    text = unescape(text)
    cell["text"] += text
    if inner:
        cell[inner] += text


def carry_rowspans(cells: Iterable[tuple[str, int]], n_cols: int) -> Iterator[tuple[int, int, str]]:
    """Lay a flat cell list over an n-column grid; a cell repeats for its rowspan.

    Yields (row, col, text) until a row needs a new cell and none is left.
    """
    queue = iter(cells)
    text, left = [""] * n_cols, [0] * n_cols
    row = 0
    while True:
        for col in range(n_cols):
            if left[col] == 0:
                nxt = next(queue, None)
                if nxt is None:
                    return
                text[col], left[col] = nxt
            left[col] -= 1
            yield row, col, text[col]
        row += 1


_STRING, _INT = T.StringType(), T.IntegerType()
CELL_TYPES = {
    "table_no": _INT, "row_no": _INT, "col_no": _INT, "tag": _STRING, "text": _STRING, "link_text": _STRING,
    "italic_text": _STRING, "rowspan": _INT, "spanned": T.BooleanType(), "header": _STRING,
}
CELLS = T.StructType([T.StructField(n, t) for n, t in CELL_TYPES.items()])
PAGE_CELLS = T.StructType([T.StructField("page", _STRING), *CELLS.fields])
GRID = T.StructType([T.StructField(n, _INT if n in ("row", "col") else _STRING) for n in ("page", "row", "col", "text")])
ROWS_PER_BATCH = 4096
BYTES_PER_BATCH = 64 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _with_tables(pages: DataFrame) -> DataFrame:
    """Pages that hold a table; they go to Python in batches of BYTES_PER_BATCH at most."""
    conf = pages.sparkSession.conf
    if int(conf.get(_BATCH_BYTES).rstrip("b")) > BYTES_PER_BATCH:
        conf.set(_BATCH_BYTES, BYTES_PER_BATCH)
    return pages.select("page", "html").filter(F.lower("html").contains("<table"))


def page_cells(html: str) -> Iterator[tuple]:
    """The cells of one page as rows of CELLS."""
    cells = parse_cells(html)
    heads = {
        (c["table_no"], c["col_no"]): c["text"].strip() for c in cells if c["tag"] == "th" and c["row_no"] == 0
    }
    for c in cells:
        yield (
            c["table_no"], c["row_no"], c["col_no"], c["tag"], c["text"].strip(), c["a"], c["i"], c["rowspan"],
            c["spanned"], heads.get((c["table_no"], c["col_no"])),
        )


def page_grid(html: str, n_cols: int) -> Iterator[tuple[int, int, str]]:
    """(row, col, text): the linked cells of one page laid over an n-column grid."""
    flat = (
        (c["a"] if c["a"] is not None else c["i"], c["rowspan"])
        for c in parse_cells(html)
        if c["tag"] == "td" and not c["spanned"] and (c["a"] is not None or c["i"] is not None)
    )
    return carry_rowspans(flat, n_cols)


def _arrow_batches(pages: pa.RecordBatch, rows_of: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for page, html in zip(pages.column("page"), pages.column("html")):
        name = page.as_py()
        for row in rows_of(html.as_py()):
            held.append((name, *row))
            if len(held) == ROWS_PER_BATCH:
                yield _arrow_batch(held, schema)
                held = []
    if held:
        yield _arrow_batch(held, schema)


def _arrow_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(columns, schema, strict=True)], schema=schema
    )


def _table_function(rows_of: Callable, kind: T.StructType) -> Callable:
    """An Arrow table function of (page, html) rows, from a function of one page."""
    schema = to_arrow_schema(kind)

    class PageRows:
        def eval(self, pages: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield from _arrow_batches(pages, rows_of, schema)

    return F.arrow_udtf(PageRows, returnType=kind)


class LateralCells:
    """Handler of ``html_cells(html)`` for SQL: ``FROM pages, LATERAL html_cells(html)``."""

    def eval(self, html: str) -> Iterator[tuple]:
        if html is not None:
            yield from page_cells(html)


def register_html_cells(spark: SparkSession) -> None:
    """Make ``html_cells(html)`` known to the session's SQL."""
    spark.udtf.register("html_cells", F.udtf(LateralCells, returnType=CELLS))


def html_cells(pages: DataFrame) -> DataFrame:
    """Every table cell of every page; ``pages`` has (page string, html string).

    ``header`` is the cell's column heading, from the first row of its table.
    Pages without a table have no cells and never reach Python.
    """
    return _table_function(page_cells, PAGE_CELLS)(_with_tables(pages).asTable())


def linked_cells(cells: DataFrame) -> DataFrame:
    """Data cells holding a link or italics, once each: link text, else italic text, with rowspan."""
    return cells.filter(
        (F.col("tag") == "td") & ~F.col("spanned") & (F.col("link_text").isNotNull() | F.col("italic_text").isNotNull())
    ).withColumn("text", F.coalesce("link_text", "italic_text"))


def rowspan_grid(pages: DataFrame, n_cols: int) -> DataFrame:
    """(page, row, col, text): linked cells of each page laid over an n-column grid."""
    return _table_function(partial(page_grid, n_cols=n_cols), GRID)(_with_tables(pages).asTable())


def table_records(cells: DataFrame, columns: list[str], first_table: int, last_table: int) -> DataFrame:
    """Body rows of the tables first..last, the named columns found by header text."""
    body = cells.filter((F.col("tag") == "td") & F.col("table_no").between(first_table, last_table))
    return body.groupBy("page", "table_no", "row_no").agg(
        *[F.max(F.when(F.col("header") == c, F.col("text"))).alias(c) for c in columns]
    )


def extract_links(pages: DataFrame, contains: str) -> DataFrame:
    """(page_id, link_no, href, year_text) of anchors whose href contains a text.

    ``year_text`` is the four characters before the first '?'.
    """
    hrefs = F.expr(r"""regexp_extract_all(html, '<a href="([^"]*)"', 1)""")
    return (
        pages.select("page_id", F.posexplode(hrefs).alias("link_no", "href"))
        .filter(F.col("href").contains(contains))
        .withColumn("year_text", F.regexp_extract("href", r"(.{4})\?", 1))
    )


# Header line patterns of the six categories, and the anchor shapes.
CATEGORY_PATTERNS = {
    "Actor Drama": "(Actor.*T|TV Actor).*Drama",
    "Actor Comedy": "(Actor.*T|TV Actor).*Comedy",
    "Actress Drama": "(Actress.*T|TV Actress).*Drama",
    "Actress Comedy": "(Actress.*T|TV Actress).*Comedy",
    "Show Drama": "Best T.*(Series|Show).*Drama",
    "Show Comedy": "Best T.*(Series|Show).*Comedy",
}
ANCHOR = "^<a[^>]*>([^<]*)</a>"
SECOND_ANCHOR = "^>([^<]*)</a>"


def header_blocks(pages: DataFrame, block_lines: int | None = None) -> DataFrame:
    """Nominees listed below category header lines: (page, category, header_no, item_no, work, person).

    A block is the lines after the header, up to the first one holding <h2>, or
    to the page's end; ``block_lines`` limits it to a number of lines.  In acting categories the person is on the line after the work's
    anchor.  Array expressions inside the page's row: nothing is shuffled, and
    only header lines with their own block leave the row.
    """
    any_header = "|".join(f"(?:{p})" for p in CATEGORY_PATTERNS.values())
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("no"), x.alias("line")))
    headers = F.filter(numbered, lambda s: s["line"].rlike(any_header))
    reach = F.size("lines") if block_lines is None else F.lit(block_lines + 1)
    blocks = F.transform(
        headers,
        lambda h: F.struct(
            h["no"].alias("no"),
            h["line"].alias("line"),
            F.slice(F.col("lines"), h["no"] + 2, reach).alias("block"),
        ),
    )
    line = F.col("h.line")
    categories = F.array_compact(
        F.array(*[F.when(line.rlike(p), F.lit(c)) for c, p in CATEGORY_PATTERNS.items()])
    )
    found = (
        pages.select("page", F.split("html", "\n").alias("lines"))
        .select("page", F.explode(blocks).alias("h"))
        .select("page", "h", F.explode(categories).alias("category"))
    )
    stop = F.array_position(F.transform("h.block", lambda x: x.contains("<h2>")), F.lit(True))
    most = F.size("h.block") if block_lines is None else F.lit(block_lines)
    last = F.when(stop > 0, F.least(stop, most)).otherwise(most)
    items = found.select(
        "page",
        "category",
        F.col("h.no").alias("header_no"),
        F.col("h.block").alias("block"),
        F.posexplode(F.slice("h.block", F.lit(1), last.cast("int"))).alias("item_no", "line"),
    ).filter(F.col("line").rlike(ANCHOR))
    following = F.coalesce(F.try_element_at("block", F.col("item_no") + 2), F.lit(""))
    acting = F.col("category").startswith("Act")
    return items.select(
        "page",
        "category",
        "header_no",
        "item_no",
        F.regexp_extract("line", ANCHOR, 1).alias("work"),
        F.when(acting, F.regexp_extract(following, SECOND_ANCHOR, 1)).otherwise("").alias("person"),
    )
