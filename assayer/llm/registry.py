"""Queries of the language-model operators, with their SQL twins."""

from __future__ import annotations

from assayer.llm import chat, lattice, licenses, media, mixing, quality, secrets, simhash, token_counts, url_rules

_MODULES = (lattice, chat, licenses, simhash, url_rules, token_counts, media, quality, mixing, secrets)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
