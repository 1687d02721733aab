"""All registered queries of the library's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from tessera.plans import conversations, corpus, evaluation, retrieval, screening, streams, telemetry  # noqa: F401
from tessera.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
