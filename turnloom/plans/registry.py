"""All queries of the engine and their oracles by name."""

from __future__ import annotations

from turnloom.plans import contract_oracles, contracts, oracles, queries

QUERIES = {**queries.QUERIES, **contracts.QUERIES}
ORACLES = {**oracles.ORACLES, **contract_oracles.ORACLES}
