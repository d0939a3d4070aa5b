"""Queries of this subpackage and their DuckDB SQL (None where SQL cannot express one)."""

from __future__ import annotations

from . import exact_dedup, language, media, mixing, near_dedup, packing, quality, spelling, substrings, token_files, toxicity, vector_packing

MODULES = (near_dedup, media, language, toxicity, quality, substrings, packing, mixing, token_files, exact_dedup, vector_packing, spelling)
QUERIES = {name: pair for m in MODULES for name, pair in m.QUERIES.items()}
