"""All queries of the core and their SQL counterparts."""

from __future__ import annotations

from . import problems, reference

QUERIES = {**problems.QUERIES, **reference.QUERIES}
ORACLES = {**problems.ORACLES, **reference.ORACLES}
