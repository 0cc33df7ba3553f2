"""All queries of the library's own operators."""

from __future__ import annotations

from . import files, gates, inference, market, records, study, texts

_ALL = {**texts.QUERIES, **records.QUERIES, **market.QUERIES, **inference.QUERIES, **study.QUERIES, **files.QUERIES, **gates.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
