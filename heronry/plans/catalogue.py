"""All registered queries of the core engine and their SQL twins; each imported module registers its own."""

from __future__ import annotations

from heronry.plans import activity, applied, core, desk, evidence, gates, ingest, monitoring, nested, people, people_activity, readers, releases, rules, sets, state, streams, weekly  # noqa: F401
from heronry.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
