"""Explicit schemas of the input tables, as DDL; nothing is inferred."""

from __future__ import annotations

POLICIES = "doc_id BIGINT, lang STRING, body STRING"
DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
FETCHES = "fetch_id BIGINT, url STRING, content_type STRING, status INT, body STRING, fetched_at TIMESTAMP"
REQUESTS = (
    "request_id BIGINT, tab_id BIGINT, ts TIMESTAMP, scheme STRING, host STRING, path STRING, url STRING, "
    "method STRING, resource_type STRING, query_key STRING"
)
COOKIE_CHANGES = (
    "change_id BIGINT, tab_id BIGINT, ts TIMESTAMP, name STRING, domain STRING, removed BOOLEAN, secure BOOLEAN, "
    "same_site STRING, partition_site STRING"
)
TOGGLE = "STRUCT<label: STRING, checked: BOOLEAN, name: STRING, id: STRING>"
CONSENT_PAYLOAD = (
    "STRUCT<detected: BOOLEAN, observed_from: STRING, choice_at: STRING, choice_kind: STRING, "
    f"containers: ARRAY<STRUCT<text: STRING, buttons: ARRAY<STRING>, toggles: ARRAY<{TOGGLE}>>>>"
)
FORM_FIELDS = "field_id BIGINT, tab_id BIGINT, name STRING, type STRING, label STRING, required BOOLEAN"
VENDOR_RULES = (
    "id STRING, vendor STRING, patterns ARRAY<STRING>, category STRING, risk STRING, expected_sections ARRAY<STRING>, "
    "position BIGINT"
)
