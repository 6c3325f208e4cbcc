"""Named queries over the driver's tables, each with the SQL that must agree with it."""

from __future__ import annotations

FLAGSHIP = "q158_risk_score"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(spark, sf_dir) under a name, with its SQL where SQL can express it."""

    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put
