"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from quaystone.plans import inbox, records, reporting, shipments, upkeep

QUERIES = {**shipments.QUERIES, **reporting.QUERIES, **inbox.QUERIES, **records.QUERIES, **upkeep.QUERIES}
ORACLES = {**shipments.ORACLES, **reporting.ORACLES, **inbox.ORACLES, **records.ORACLES, **upkeep.ORACLES}
