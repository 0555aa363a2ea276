"""All queries over the shared tables, with their SQL twins."""

from __future__ import annotations

from assayer.plans import analysis, evidence, gateway, guards, layout, ledger, levels, reports, scoring, search, versions

_MODULES = (scoring, analysis, evidence, levels, ledger, search, gateway, versions, layout, reports, guards)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
