"""All registered queries and the SQL they are held against."""

from __future__ import annotations

from gleaner.plans import etl_queries, label_queries, metric_queries, retrieval_queries, store_queries, table_queries, text_queries, training_queries  # noqa: F401  they register themselves
from gleaner.plans.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
