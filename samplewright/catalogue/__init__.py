"""Registered queries over the test tables, each with DuckDB SQL where SQL can say the same."""

from samplewright.catalogue import annotations, evidence, labels, media, state

MODULES = (evidence, labels, annotations, media, state)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
