"""All queries of the library's core, with the SQL that checks them."""

from __future__ import annotations

from millrace.plans import audits, corpus, learned, ledgers, made, misc, mixes, packs, upkeep
from millrace.plans.result_types import typed

MODULES = (upkeep, corpus, packs, mixes, ledgers, learned, misc, audits, made)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: typed(name, sql) for module in MODULES for name, sql in module.ORACLES.items()}
