"""Queries and DuckDB twins of the corpus operators."""

from __future__ import annotations

from pairfeat.llm import langid, licenses, mixing, packing, pages, pii, quality, secrets, simhash, spelling, substrings, vectors, whitening

MODULES = [vectors, simhash, packing, langid, quality, licenses, mixing, pii, secrets, pages, whitening, substrings, spelling]

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
