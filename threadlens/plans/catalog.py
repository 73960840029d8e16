"""Registry of queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}


def check_sql(body: str, views: Sequence[str] = ()) -> str:
    """``body`` is a SELECT, or further CTEs followed by one; ``views`` are CTEs put before it."""
    body = body.strip()
    ctes = list(views)
    if not ctes:
        return body if body.upper().startswith(("SELECT", "WITH")) else "WITH " + body
    head = "WITH " + ",\n".join(v.strip() for v in ctes)
    return f"{head}\n{body}" if body.upper().startswith("SELECT") else f"{head},\n{body}"


def query(name: str, sql: str | None = None, views: Sequence[str] = ()) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            CHECKS[name] = check_sql(sql, views)
        return plan

    return add
