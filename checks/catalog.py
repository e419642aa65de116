"""All registered queries."""

from checks import cases_activity, cases_ingest, cases_scoring, cases_state, cases_text, cases_vectors, cases_whole  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
