"""All registered queries and their oracles."""

from __future__ import annotations

from laurel.plans import (  # noqa: F401  (importing registers)
    cohort_queries,
    model_queries,
    relational_queries,
    report_queries,
    sources_queries,
)
from laurel.plans.registry import ORACLES, QUERIES, Plan

FLAGSHIP = "rp_24"


def queries() -> dict[str, Plan]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
