"""Named queries over the test tables, each with its SQL counterpart."""

from corpuswarden.plans import (  # noqa: F401  (importing registers the queries)
    aggregates,
    audits,
    filters,
    joins_links,
    joins_sides,
    release,
    scalars,
    scans,
    sequences,
    streams,
)
from corpuswarden.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
