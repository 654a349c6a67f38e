"""All registered queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import catalog, contest, details, evidence, review, web

FLAGSHIP = "proposal_states"
PARTS = (review.R, catalog.R, contest.R, web.R, details.R, evidence.R)

#: Columns that DuckDB's count_if makes wider than a long.
LONGS = {
    "proposal_states": ("proven", "candidate", "rejected", "ambiguous"),
    "materialize_reviews": ("n_evidence", "n_candidate", "n_rejected", "n_ambiguous"),
    "counter_report": ("proven",),
    "schema_assertions": ("observed",),
    "owner_receipts": ("active_count", "passive_count"),
    "reconcile_identities": ("n",),
    "overlap_report": ("urgent",),
    "field_accuracy": ("correct", "unknown"),
    "target_state": ("attempts",),
    "crawl_summary": ("loaded", "failed", "pending"),
}


def _longs(name: str, sql: str) -> str:
    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in LONGS.get(name, ()))
    return f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in PARTS for name, q in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _longs(name, q) for part in PARTS for name, q in part.sql.items()}
