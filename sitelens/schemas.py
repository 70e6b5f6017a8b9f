"""Schemas of the tables that pass between operators."""

from __future__ import annotations

FETCHED_PAGE = "url string, status_code int, content_type string, text string, fetched_at timestamp, headers map<string,string>"
CANDIDATE = "field string, raw_value string, source_url string, collected_at timestamp, extraction_layer string, metadata map<string,string>, seq int"
PROVENANCE = "struct<source_url string, collected_at timestamp, extraction_layer string, raw_value string>"
FINDING = (
    "field string, value string, extraction_confidence double, page_support int, occurrence_count int, "
    f"first_seen_url string, metadata map<string,string>, provenance array<{PROVENANCE}>"
)
PAGE_LOG = "url string, depth int, status string, detail string, http_status int, content_type string, findings_count int"
LEDGER = (
    "run_id string, target_host string, target_url string, purpose_category string, purpose_note string, created_at timestamp, "
    "retention_days int, directory string, pages_fetched int, findings_count int, files array<string>"
)
ROBOTS = "host_key string, status_code int, body binary, error string, fetched_at timestamp"
ROUTE = "url string, body binary, status int, content_type string, location string, headers map<string,string>"
