"""Query registry: a Spark plan and, where SQL can state it, an independent oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = plan
        if oracle is not None:
            ORACLES[name] = with_ctes(oracle)
        return plan

    return register


def with_ctes(body: str) -> str:
    """Prefix an oracle body with the shared table expressions it names."""
    from laurel.plans.oracle_tables import TABLES

    if body.lstrip().startswith("WITH t_"):  # already complete
        return body.strip()
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in re.findall(r"\bt_[a-z0-9_]+\b", text):
            if name in TABLES and name not in needed:
                visit(TABLES[name])
                needed[name] = None

    visit(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({TABLES[n].strip()})" for n in needed)
    return f"WITH {ctes}\n{body.strip()}"
