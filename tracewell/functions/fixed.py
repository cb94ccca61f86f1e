"""Spellings and limits that a ledger written by other tools already holds."""

from __future__ import annotations

import json
import os
from pathlib import Path

# Schema tags of the wire format, of stored payloads and of digests: those of the tool whose events are read, so
# they come from a file, which TRACEWELL_WIRE_FORMAT may replace.
_TAGS = json.loads(Path(os.environ.get("TRACEWELL_WIRE_FORMAT") or Path(__file__).parent.parent / "data" / "wire_format.json").read_text())
EVENT_SCHEMA: str = _TAGS["event_schema"]
OBSERVATION_SCHEMA: str = _TAGS["observation_schema"]
DIGEST_SCHEMA: str = _TAGS["digest_schema"]

# Kinds.
HARNESS_SOURCE = "agent-harness"
HARNESS_KIND = "agent-harness-event"
NOTE_KIND = "manual-intervention"
HARNESS_TRANSFORMATION = "agent-harness-observation/v1"

# Limits of the wire format, in bytes or items.
MAX_RECORD_BYTES = 131072
MAX_BLANK_BYTES = 131072
MAX_EXCERPTS = 8
MAX_EXCERPT_BYTES = 8192
MAX_FACETS = 64
MAX_INBOX_ENTRIES = 10_000
MAX_BANDS = 8
DEFAULT_LIST_LIMIT, MAX_LIST_LIMIT = 50, 1000

# Reasons for quarantine.
REASONS = (
    "record-too-large",
    "blank-input-limit",
    "invalid-json",
    "unsupported-schema",
    "invalid-reference",
    "invalid-event",
    "empty-event",
    "multiple-events",
    "identity-conflict",
    "incomplete-quarantine",
)

# Closed vocabularies of derived records, in rank order where they have one.
CONFIDENCE = ("speculative", "weak", "moderate", "strong")
FRESHNESS = ("current", "aging", "stale")
CONTRADICTION = ("uncontested", "contested", "reconciled")
SCOPE_FIDELITY = ("exact", "broader", "narrower")
DERIVATION_KINDS = ("facet", "aggregate", "cluster")
RELATIONS = ("supports", "refutes", "caused-by", "enabled", "prevented", "supersedes", "derives-from", "co-occurs-with", "no-effect")
ROLES = ("supporting", "refuting")
SLOTS = ("text", "integer", "boolean")
