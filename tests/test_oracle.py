"""Registered queries against their SQL oracles on the smallest tables.

A cross-section runs by default; LAUREL_ALL_QUERIES=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as E
from tools import check

SF = "/root/testdata/sf0.001"
SAMPLE = """
rp_24 rp_11 rp_30 rp_36 prior_appearances prior_wins latest_state join_two_lags won_last_period
winner_position winner_position_folded average_rank_capped first_rank_capped slot_number
read_csv_table glm_score_equations multinomial_slot interaction_terms
sectioned_to_rows html_table_cells rowspan_carry extract_block_after_header glm_single_factor stream_history
""".split()
NAMES = list(E.queries()) if os.environ.get("LAUREL_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    status, detail = check.compare(spark, duck, name, SF)
    assert status in ("ok", "rows"), detail


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 170


def test_entry(spark):
    assert E.entry(spark).count() > 0
