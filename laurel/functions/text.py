"""Name, title and number-format helpers; all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name endings that are not surnames.
NAME_SUFFIXES = ["Jr.", "Jr"]


def surname(name: str | Column) -> Column:
    """Last blank-separated token; '' for an empty name."""
    c = F.col(name) if isinstance(name, str) else name
    return F.substring_index(F.rtrim(c), " ", -1)


def surname_skipping_suffix(name: str | Column) -> Column:
    """Surname, but the token before it where the last one is a suffix."""
    c = F.rtrim(F.col(name) if isinstance(name, str) else name)
    tokens = F.split(c, " ")
    last = F.try_element_at(tokens, F.lit(-1))
    before = F.try_element_at(tokens, F.lit(-2))
    return F.when(last.isin(*NAME_SUFFIXES), F.coalesce(before, last)).otherwise(last)


def name_length(name: str | Column) -> Column:
    return F.char_length(F.col(name) if isinstance(name, str) else name)


def signed_or_tilde(x: Column) -> Column:
    """'+0.123' / '-0.123', or '~' for effects below one percent."""
    return F.when(F.abs(x) >= 0.01, F.format_string("%+.3f", x)).otherwise("~")


def percent(x: Column) -> Column:
    return F.format_string("%.0f%%", x * 100)


def parse_title_years(title: str, open_end: int = 2016) -> tuple[Column, Column]:
    """(start, end) of a page title such as '... (TV Series 1999-2004)'.

    An open-ended series runs to ``open_end``; a mini-series or movie one year.
    """
    t = F.col(title)
    series = r"TV Series ([0-9]{4}).*([0-9]{4}|\s)\)"
    single = r"TV (?:Mini-Series|Movie) ([0-9]{4})"
    number = lambda c: F.nullif(c, F.lit("")).try_cast("int")
    s_start = number(F.regexp_extract(t, series, 1))
    s_end = F.regexp_extract(t, series, 2)
    one = number(F.regexp_extract(t, single, 1))
    is_series = s_start.isNotNull()
    start = F.when(is_series, s_start).otherwise(one)
    end = (
        F.when(is_series & (F.trim(s_end) == ""), F.lit(open_end))
        .when(is_series, number(s_end))
        .otherwise(one + 1)
    )
    return start, end
