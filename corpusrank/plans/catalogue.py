"""All queries of the core, by name, and the SQL that says the same."""

from __future__ import annotations

from corpusrank.plans import pages, retrieval, streams, texts

FLAGSHIP = "l4_bm25"
QUERIES = {**retrieval.QUERIES, **texts.QUERIES, **streams.QUERIES, **pages.QUERIES}
SQL = {**retrieval.SQL, **texts.SQL, **streams.SQL, **pages.SQL}
