"""Queries and SQL of the corpus operators, for the entry module."""

from __future__ import annotations

from . import fingerprints, html_extract, lang_id, packing, periodic_runs, sentencepiece_fst, simhash, substring_dedup, token_store, topk, vector_dedup, warc, whitening

MODULES = (simhash, substring_dedup, warc, html_extract, packing, sentencepiece_fst, token_store, fingerprints, topk, lang_id, periodic_runs, vector_dedup, whitening)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
