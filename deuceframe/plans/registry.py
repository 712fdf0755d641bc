"""All named queries of the core."""

from __future__ import annotations

from deuceframe.plans import audits, checks, cleaning, evaluation, features, histories, linking, live, more, ratings

_MODULES = (audits, checks, cleaning, evaluation, features, histories, linking, live, more, ratings)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
