"""All queries of the subpackage."""

from scanloom.llm import queries_keys, queries_text

MODULES = (queries_keys, queries_text)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
