from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.functions.fixed import EVENT_SCHEMA
from tracewell.operators import quarantine as q
from tracewell.queries.ledger import quarantine_errors
from tracewell.sources import records


def event(**changes) -> dict:
    base = {
        "schema": EVENT_SCHEMA,
        "source_event_id": "e1",
        "occurred_at": "2024-01-01T00:00:00Z",
        "source": {"kind": "agent-harness", "locator": "s.jsonl#1"},
        "subject": {"kind": "repository", "identifier": "/w"},
        "harness": {"name": "h", "version": "1"},
        "session_id": "s",
        "event_type": "t",
        "redaction": {"policy": "p", "version": "1", "transformations": ["x"]},
        "excerpts": [],
        "facets": [],
    }
    return {k: v for k, v in (base | changes).items() if v is not ...}


def text(**changes) -> str:
    return json.dumps(event(**changes), ensure_ascii=False)


def reason(spark, *bodies) -> list:
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "raw_id long, body string")
    return [r.reason for r in q.classify(rows).orderBy("raw_id").collect()]


def excerpt(n: int) -> dict:
    return {"kind": "k", "text": "x" * n}


def padded(size: int) -> str:
    body = text()
    return body[:-1] + " " * (size - len(body.encode())) + "}"


CASES = [
    (text(), None),
    (text() + "\n", None),
    ("\n \t\n" + text() + "\r\n", None),
    (text(harness={"name": "h"}), None),
    (text(harness={"name": "h", "version": None}), None),
    (text(occurred_at="2024-01-01T01:00:00.123456+02:00"), None),
    (text(facets=[{"name": "a", "value": "t"}, {"name": "b", "value": -(2**63)}, {"name": "c", "value": True}]), None),
    (text(excerpts=[excerpt(8192)] * 8), None),
    (text(facets=[{"name": f"f{i}", "value": 1} for i in range(64)]), None),
    (padded(131_072), None),
    ("{not-json}", "invalid-json"),
    (text(extra=1), "invalid-json"),
    (text(redaction=...), "invalid-json"),
    (text(session_id=5), "invalid-json"),
    (text(source={"kind": "agent-harness", "locator": "l", "x": 1}), "invalid-json"),
    (text(facets=[{"name": "a", "value": 7.0}]), "invalid-json"),
    (text(facets=[{"name": "a", "value": None}]), "invalid-json"),
    (text(facets=[{"name": "a", "value": 2**63}]), "invalid-json"),
    (text(facets=[{"name": "a"}]), "invalid-json"),
    (text(excerpts=None), "invalid-json"),
    (text(occurred_at="yesterday"), "invalid-json"),
    (text(occurred_at="2024-01-01T00:00:00"), "invalid-json"),
    (text(occurred_at="2024-13-01T00:00:00Z"), "invalid-json"),
    (text(schema=...), "invalid-json"),
    (text(schema=1), "invalid-json"),
    (text() + "]", "invalid-json"),
    ("﻿" + text(), "invalid-json"),
    (text()[:-1] + ',"session_id":"s"}', "invalid-json"),
    ('{"schema": NaN}', "invalid-json"),
    ("[]", "invalid-json"),
    (text(schema=EVENT_SCHEMA[:-1] + "2", source={"kind": "", "locator": ""}), "unsupported-schema"),
    (text(schema=EVENT_SCHEMA + " "), "unsupported-schema"),
    (text(source={"kind": "　", "locator": "l"}), "invalid-reference"),
    (text(subject={"kind": "r", "identifier": "\n"}, event_type=" "), "invalid-reference"),
    (text(event_type=""), "invalid-event"),
    (text(harness={"name": "h", "version": " "}), "invalid-event"),
    (text(redaction={"policy": "p", "version": "1", "transformations": ["\t"]}), "invalid-event"),
    (text(source={"kind": "repository", "locator": "l"}), "invalid-event"),
    (text(excerpts=[excerpt(8193)]), "invalid-event"),
    (text(excerpts=[{"kind": "k", "text": "é" * 4097}]), "invalid-event"),
    (text(excerpts=[excerpt(1)] * 9), "invalid-event"),
    (text(excerpts=[{"kind": "k", "text": " "}]), "invalid-event"),
    (text(facets=[{"name": f"f{i}", "value": 1} for i in range(65)]), "invalid-event"),
    (text(facets=[{"name": "", "value": 1}]), "invalid-event"),
    (padded(131_073), "record-too-large"),
    ("", "empty-event"),
    (None, "empty-event"),
    ("\n" * 131_072, "empty-event"),
    (" " * 131_072, "empty-event"),
    ("\n" * 131_073, "blank-input-limit"),
    ("\n" * 131_072 + text(), "blank-input-limit"),
    (" " * 131_073, "record-too-large"),
    (text() + "\n" + text(), "multiple-events"),
    (text() + "\n{", "invalid-json"),
    ("{\n" + text(), "invalid-json"),
    (text() + "\n" + text(schema="x"), "unsupported-schema"),
    (text() + "\n" + "\n" * 131_073, "blank-input-limit"),
]


@pytest.fixture(scope="module")
def judged(spark):
    return reason(spark, *[body for body, _ in CASES])


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(judged, i):
    assert judged[i] == CASES[i][1]


def test_valid_rows_are_typed_and_the_rest_kept_with_reasons(spark):
    rows = spark.createDataFrame([(1, text(facets=[{"name": "n", "value": 7}, {"name": "b", "value": False}, {"name": "t", "value": "x"}]), "e"), (2, "{", "e"), (2, "{", "e")], "raw_id long, body string, errors string")
    judged = q.classify(rows)
    (good,) = q.valid_events(judged).collect()
    assert [(f.text_value, f.integer_value, f.boolean_value) for f in good.facets] == [(None, 7, None), (None, None, False), ("x", None, None)]
    assert [(r.raw_id, r.reason, r.errors) for r in q.quarantined(judged).collect()] == [(2, "invalid-json", ["invalid-json"])] * 2
    assert [(r.reason, r.files) for r in q.reason_counts(judged).collect()] == [("invalid-json", 2)]


def test_empty_table(spark):
    assert q.classify(spark.createDataFrame([], "raw_id long, body string")).count() == 0


def test_reasons_of_all_lines_are_given(spark, tmp_path):
    bodies = ["\n".join([text(), text(), text(schema="other"), text(session_id=" ")]), "\n".join([text(schema="other"), text(), "{"]), text()]
    spark.createDataFrame(list(enumerate(bodies)), "raw_id long, body string").write.parquet(str(tmp_path / "inbox_files.parquet"))
    got = {r.raw_id: (r.reason, r.errors) for r in quarantine_errors(spark, str(tmp_path)).collect()}
    assert got == {0: ("multiple-events", "invalid-event,unsupported-schema"), 1: ("unsupported-schema", "invalid-json,unsupported-schema")}


FOREIGN = EVENT_SCHEMA[:-1] + "9"
UNUSUAL = [
    (text(schema=FOREIGN)[:-1] + ',"x":' + "[" * 3000 + "]" * 3000 + "}", "unsupported-schema"),
    (text(schema=FOREIGN)[:-1] + ',"x":' + "7" * 2000 + "}", "unsupported-schema"),
    (text(schema=FOREIGN)[:-1] + ',"' + "k" * 60_000 + '":1}', "unsupported-schema"),
    (text(schema=FOREIGN)[:-1] + ',"x":{"a":1,"a":2}}', "invalid-json"),
    (text(schema=FOREIGN)[:-1] + ',"x":{"a":1,"a":2},"y":' + "[" * 3000 + "]" * 3000 + "}", "invalid-json"),
    (text()[:-1] + ',"x":' + "[" * 3000 + "]" * 3000 + "}", "invalid-json"),
    (text(facets=[{"name": "n", "value": 0}]).replace(": 0}", ": -0}"), "invalid-json"),
    (text(session_id="-0", facets=[{"name": "n", "value": -1}]), None),
    (text(excerpts=[{"kind": "k", "text": "x"}, None]), "invalid-json"),
    (text(excerpts=[{"kind": "k", "text": "x"}, {"kind": "k"}]), "invalid-json"),
    (text(excerpts=[{"kind": "k", "text": "x"}, {"kind": "k", "text": None}]), "invalid-json"),
    (text(facets=[{"name": "n", "value": "x"}, {"name": None, "value": 1}]), "invalid-json"),
    (text(facets=[{"name": "n", "value": "x"}, {"name": "m", "value": {}}]), "invalid-json"),
    (text(redaction={"policy": "p", "version": "1", "transformations": [None]}), "invalid-json"),
    (text(redaction={"policy": "p", "version": "1", "transformations": ["a", 1]}), "invalid-json"),
    (text(source={"kind": "agent-harness", "`l`": "x"}), "invalid-json"),
]


def test_unusual_records(spark):
    assert reason(spark, *[body for body, _ in UNUSUAL]) == [expected for _, expected in UNUSUAL]


def by_lines(body: str) -> list:
    """``physical_records`` line by line."""
    data, found, at, line, skipped = body.encode(), [], 0, 0, 0
    while at < len(data) and len(found) < 3:
        line += 1
        if skipped == M:
            return [*found, (line, "blank-input-limit", None)]
        end = data.find(b"\n", at)
        content = data[at : end if end >= 0 else len(data)]
        at += len(content) + (end >= 0)
        lead = len(content) - len(content.lstrip(b" \t\n\x0c\r"))
        if skipped and skipped + lead > M:
            return [*found, (line, "blank-input-limit", None)]
        if len(content) > M:
            return [*found, (line, "record-too-large", None)]
        if lead == len(content):
            skipped += lead + (end >= 0)
            if skipped > M:
                return [*found, (line, "blank-input-limit", None)]
            continue
        found.append((line, None, content.decode()))
        skipped = 0
    return found


M = 6


@settings(max_examples=600, deadline=None)
@given(st.text("a \n\t", max_size=24))
def test_lines_are_bounded_as_if_read_one_by_one(body):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(records, "MAX_BLANK_BYTES", M)
        patch.setattr(records, "MAX_RECORD_BYTES", M)
        assert records.physical_records(body, 3) == by_lines(body)
