"""Versions and schemas of the index tables."""

from __future__ import annotations

SCHEMA_VERSION = 1
HASH_SCHEME = 1
HARNESS_VERSION = 1

CHUNK = (
    "row_id bigint, repository string, file string, language string, symbol string, symbol_type string, signature string, "
    "doc_first_line string, line_start int, line_end int, content_hash string, body string, fragment int, live boolean"
)
VECTOR = "row_id bigint, vector array<float>"
CHANGE = "op string, path string, from_path string"
LABEL = "query string, expected array<struct<file: string, symbol: string>>, source string, provenance string, label_set string"
