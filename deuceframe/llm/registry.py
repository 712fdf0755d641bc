"""All queries of the subpackage."""

from __future__ import annotations

from deuceframe.llm import aliases, comparisons, crosswalk, history, texts, tokens

_MODULES = (aliases, comparisons, crosswalk, history, tokens, texts)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
