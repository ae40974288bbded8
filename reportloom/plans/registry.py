"""All registered queries and their SQL, gathered from the plans."""

from __future__ import annotations

from reportloom.plans import documents, incidents, media

_PLANS = [incidents, media, documents]
QUERIES: dict = {}
ORACLES: dict = {}
for _plan in _PLANS:
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
