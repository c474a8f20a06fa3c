"""Pages of many unmatched tags take time in proportion to their length."""

import time

import pytest

from laurel.llm.html_density import main_text

PAGES = {
    "inline": lambda n: "<i>" * n + "x" + "</b>" * n,
    "blocks": lambda n: "<div><p>" + "<b>" * n + "<p>x" * (n // 10),
    "items": lambda n: "<ul>" + "<li>x" * n,
    "deep": lambda n: "<div>" * n + "text " * 50 + "</div>" * n,
    "left out": lambda n: "<nav>" + "<b></i>" * n + "<li>" * n,
    "cells": lambda n: "<aside>" + "<p>" * n + "<td>" * n,
}


def took(page):
    started = time.process_time()
    main_text(page)
    return time.process_time() - started


@pytest.mark.parametrize("name", PAGES)
def test_time_grows_with_the_page(name):
    short, long = PAGES[name](2_000), PAGES[name](32_000)
    assert took(long) < 60 * max(took(short), 0.01)  # 16 times as long; a square would be 256 times


def test_unmatched_tags_keep_the_text():
    page = "<i>" * 3000 + "<p>one</u></em> two</p>" + "</b>" * 3000 + "<p>three"
    assert main_text(page) == "one two\n\nthree"
