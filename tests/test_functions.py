from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import bands, derived, ids, redaction, strict_json, text
from tracewell.functions.digest import canonical_json, instant_text, semantic_digest, sha256_raw
from tracewell.functions.fixed import DIGEST_SCHEMA, OBSERVATION_SCHEMA
from tracewell.queries import sqlfn

I64 = 2**63
LATENCY = bands.BandTable.of("latency", "duration", "v1", "instant", (100, "quick"), (1000, "slow"), (10000, "stalled"))


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_bounds_belong_to_the_band_above(spark):
    raw = [-I64, 99, 100, 999, 1000, 9999, 10000, I64 - 1, None]
    got = values(spark, [(x,) for x in raw], "x long", LATENCY.band(F.col("x")))
    assert [x for (x,) in got] == ["instant", "instant", "quick", "quick", "slow", "slow", "stalled", "stalled", None]


def test_dense_range_counts(spark):
    df = spark.range(-500, 2000)
    got = {r.band: r.n for r in df.groupBy(LATENCY.band(F.col("id")).alias("band")).agg(F.count("*").alias("n")).collect()}
    assert got == {"instant": 600, "quick": 900, "slow": 1000}
    registry = bands.Registry()
    registry.register(LATENCY)
    assert {r.band: r.n for r in bands.band_by_join(df, "id", registry.as_table(spark)).groupBy("band").agg(F.count("*").alias("n")).collect()} == got
    for name, n in got.items():
        assert df.where(LATENCY.predicate(F.col("id"), name)).count() == n


@pytest.mark.parametrize(
    "made",
    [
        [("a", -I64, 10), ("b", 11, None)],
        [("a", -I64, 10), ("b", 9, None)],
        [("a", 0, 10), ("b", 10, None)],
        [("a", -I64, 10)],
        [("A prose name", -I64, None)],
        [("a", -I64, 10), ("a", 10, None)],
        [("a", -I64, 10), ("b", 10, 10), ("c", 10, None)],
        [(f"b{i}", -I64 if i == 0 else i, i + 1 if i < 8 else None) for i in range(9)],
        [],
    ],
)
def test_refused_tables(made):
    with pytest.raises(bands.BandError):
        bands.BandTable("n", "m", "v", tuple(bands.Band(*b) for b in made))


def test_registry_refusals():
    registry = bands.default_registry()
    with pytest.raises(bands.BandError):
        registry.register(registry.lookup("event", "value"))
    with pytest.raises(bands.BandError):
        registry.register(LATENCY, kind="content")
    with pytest.raises(bands.BandError):
        registry.lookup("no", "facet")


def test_guard(spark):
    excerpts = ["ERROR: Could not read   credentials from the remote socket while waiting", "process being killed by oom"]
    rows = [("could not read credentials", "verbatim"), ("remote-socket-waiting", "derivable"), ("toolchain_mismatch", None), ("oom_kill", "derivable"), ("ab cd", None)]
    df = spark.createDataFrame([(v, excerpts) for v, _ in rows], "v string, e array<string>")
    assert [r[0] for r in df.select(redaction.guard_reason(F.col("v"), F.col("e"))).collect()] == [x for _, x in rows]
    assert values(spark, [("all of process being killed by oom and more", excerpts), ("x", []), ("x", None)], "v string, e array<string>", redaction.guard_reason(F.col("v"), F.col("e"))) == [("superset",), (None,), (None,)]


def test_projection_is_banded_and_guarded(spark):
    registry = bands.default_registry()
    df = spark.createDataFrame([(1234, ["it was slow"]), (50, ["it was slow"])], "x long, e array<string>")
    got = df.select(registry.project_banded("latency", "duration", F.col("x"), F.col("e")).alias("p")).select("p.*").collect()
    assert [(r.value, r.breach) for r in got] == [("slow", "verbatim"), ("instant", None)]
    got = df.select(registry.project_category("effort", "outcome", F.lit("other"), F.col("e"), strict=True).alias("p")).select("p.*").collect()
    assert {r.breach for r in got} == {"undeclared"}


def test_strictest_redaction(spark):
    schema = "r array<struct<policy:string,version:string,transformations:array<string>>>"
    rows = [([("lenient", "1", ["b"]), ("strict", "2", ["c", "a"])],), ([("x", "1", ["a"]), ("y", "1", ["b"])],), ([],), (None,), ([("n", "1", None)],)]
    got = values(spark, rows, schema, redaction.strictest_redaction(F.col("r")).alias("s"))
    assert [s and (s.policy, s.transformations) for (s,) in got] == [("strict", ["a", "b", "c"]), ("x", ["a", "b"]), None, None, ("n", [])]


def test_blank_and_normal_text(spark):
    rows = [("",), (" \t　",), ("a",), (None,), (" A \n b ",)]
    assert values(spark, rows, "t string", text.is_blank(F.col("t"))) == [(True,), (True,), (False,), (None,), (False,)]
    assert values(spark, rows[-1:], "t string", text.normalize_text(F.col("t"))) == [("a b",)]


def test_instants(spark):
    rows = [("2024-01-01T00:00:00Z",), ("2024-01-01T02:00:00.1234567+02:00",), ("2024",), ("2024-02-30T00:00:00Z",), (None,), ("2024-01-01t00:00:00z",), ("2024-01-01 20:00:00.5-0330",), ("2024-01-02T00:00:00+23:59",), ("2024-01-02T00:00:00+24:00",), ("2024-01-02T00:00:00+01:60",)]
    got = values(spark, rows, "t string", instant_text(text.rfc3339(F.col("t"))))
    assert [x for (x,) in got] == ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.123456Z", None, None, None, "2024-01-01T00:00:00Z", "2024-01-01T23:30:00.500Z", "2024-01-01T00:01:00Z", None, None]


def one_event(spark, **changes):
    fields = {"source_event_id": "e-17", "session_id": "s-1", "event_type": "tool-completed", "excerpt": "tests\u2028passed \x1f"} | changes
    return spark.createDataFrame(
        [
            (
                ("agent-harness", "s.jsonl#17"), ("repository", "/w"), fields["source_event_id"], ("h", None), fields["session_id"], fields["event_type"],
                ("p", "1", ["b", "a"]), [("log", fields["excerpt"])], [("result", "passed", None, None), ("n", None, -7, None), ("retry", None, None, False)],
            )
        ],
        "source struct<kind:string,locator:string>, subject struct<kind:string,identifier:string>, source_event_id string, harness struct<name:string,version:string>, session_id string, event_type string,"
        "redaction struct<policy:string,version:string,transformations:array<string>>, excerpts array<struct<kind:string,text:string>>, facets array<struct<name:string,text_value:string,integer_value:bigint,boolean_value:boolean>>",
    )


def test_semantic_digest_by_hand_and_any_change(spark):
    digest = lambda df: df.select(semantic_digest(F.lit("2024-01-01T08:00:00Z"))).collect()[0][0]
    by_hand = (
        '{"schema":"' + DIGEST_SCHEMA + '","occurred_at":"2024-01-01T08:00:00Z","source":{"kind":"agent-harness","locator":"s.jsonl#17"},"subject":{"kind":"repository","identifier":"/w"},"persisted_payload":{"schema":"'
        + OBSERVATION_SCHEMA + '","source_event_id":"e-17","harness":{"name":"h","version":null},"session_id":"s-1","event_type":"tool-completed","redaction":{"policy":"p","version":"1","transformations":["b","a"]},'
        '"excerpts":[{"kind":"log","text":"tests\u2028passed \\u001f"}],"facets":[{"name":"result","value":"passed"},{"name":"n","value":-7},{"name":"retry","value":false}]}}'
    )
    golden = hashlib.sha256(by_hand.encode()).hexdigest()
    assert digest(one_event(spark)) == golden
    assert len({digest(one_event(spark, **{k: "other"})) for k in ("source_event_id", "session_id", "event_type", "excerpt")} | {golden}) == 5


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=12))
def test_canonical_json_bytes(spark, value):
    value = value + '\\u2028 "/ \x1f\x0b\\'
    row = spark.createDataFrame([(value, None)], "a string, b string").select(canonical_json(F.struct("a", "b"))).collect()[0][0]
    assert row == json.dumps({"a": value, "b": None}, ensure_ascii=False, separators=(",", ":")).replace("\\u007f", "\x7f")


def test_raw_digest_and_ids(spark):
    assert values(spark, [("x",)], "x string", sha256_raw(F.col("x"))) == [(bytearray(hashlib.sha256(b"x").digest()),)]
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = values(spark, [("a",), ("a",), ("b",)], "x string", ids.make_ulid(at, F.col("x")))
    assert rows[0] == rows[1] != rows[2] and len(rows[0][0]) == 26
    assert values(spark, rows, "i string", ids.ulid_millis(F.col("i")))[0] == (1704067200000,)
    assert values(spark, [(" 01ARZ3NDEKTSV4RRFFQ69G5FAV\n",), ("81ARZ3NDEKTSV4RRFFQ69G5FAV",), ("",)], "i string", ids.parse_ulid(F.col("i"))) == [("01ARZ3NDEKTSV4RRFFQ69G5FAV",), (None,), (None,)]


def test_rules_of_derived_records(spark):
    got = values(spark, [("assisted", c) for c in ("speculative", "weak", "moderate", "strong")] + [("deterministic", "strong")], "m string, c string", derived.gate(F.col("m"), F.col("c")))
    assert [x for (x,) in got] == [True, True, False, False, True]
    slots = [("text", "a", None, None, True), ("text", None, 7, None, False), ("integer", None, 7, None, True), ("boolean", None, None, 1, True), ("text", "a", 1, None, False), ("odd", "a", None, None, False), (None, "a", None, None, False)]
    got = values(spark, [s[:4] for s in slots], "s string, t string, i long, b int", derived.slot_ok(F.col("s"), F.col("t"), F.col("i"), F.col("b")))
    assert [x for (x,) in got] == [s[4] for s in slots]
    assert values(spark, [("derivation:01ARZ3NDEKTSV4RRFFQ69G5FAV",), ("x:y",)], "k string", derived.target_of(F.col("k"))["kind"]) == [("derivation",), (None,)]
    assert values(spark, [("current",), ("stale",), ("aging",), (None,)], "f string", derived.weakest_freshness(F.col("f"))) == [("stale",)]


def test_escaping(spark):
    assert values(spark, [('a\tb\n"c\\\'',)], "t string", text.escape_debug(F.col("t"))) == [('a\\tb\\n\\"c\\\\\\\'',)]


def test_sql_functions(spark):
    made = sqlfn.register(spark)
    assert "band_latency_duration" in made
    row = spark.sql("SELECT band_latency_duration(1234), is_blank('　'), normalize_text(' A  b'), confidence_rank('weak'), freshness_rank('none')").collect()[0]
    assert tuple(row) == ("slow", True, "a b", 1, None)


def test_band_tables_held_as_data(spark):
    rows = [("a", "g", "x", -I64, 5), ("a", "g", "y", 6, None), ("a", "o", "x", -I64, 5), ("a", "o", "y", 4, None), ("a", "f", "x", 0, None), ("a", "b", "x", -I64, 5), ("a", "e", "x", -I64, -I64), ("a", "e", "y", -I64 + 1, None)]
    df = spark.createDataFrame(rows, "namespace string, name string, band string, lower long, upper long")
    assert {(r.name, r.band, r.fault) for r in bands.discontinuities(df).collect()} == {("g", "x", "gap"), ("o", "x", "overlap"), ("f", "x", "floating-low"), ("b", "x", "bounded-above"), ("e", "x", "empty")}
    assert bands.discontinuities(bands.default_registry().as_table(spark)).count() == 0


def test_paths(spark):
    rows = [("src/a/b.rs",), ("/x",), ("",), (None,), ("a//b",)]
    assert values(spark, rows, "p string", text.path_depth(F.col("p")), text.path_area(F.col("p"))) == [(3, "a"), (1, None), (0, None), (None, None), (2, "a")]


JSON = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text()), lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(st.text(max_size=3), x, max_size=4)), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(JSON, st.booleans(), st.sampled_from(["", "}", "]", ",", '"', "x", " 1"]), st.integers(0, 40))
def test_the_reader_with_a_stack_equals_the_library(value, ascii_only, junk, at):
    text = json.dumps(value, ensure_ascii=ascii_only)
    for t in (text, json.dumps(value, indent=1), text[: at % (len(text) + 1)] + junk + text[at % (len(text) + 1) :]):
        try:
            expected = strict_json.loads(t)
        except ValueError:
            with pytest.raises(ValueError):
                strict_json._deep(t, False)
        else:
            assert strict_json._deep(t, False) == expected


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', '"\\ud800"', "[1,]", "[,1]", '{"a":}', "{,}", "01", "+1", "1.", ".5", "NaN", "-", "tru", "", " ", '"\t"', "[1 2]", '{"a" 1}', "1 1", '{"a":1 "b":2}', "[1}", '{"a":1]'])
def test_neither_reader_takes_what_is_no_json(text):
    for read in (strict_json.loads, lambda t: strict_json._deep(t, True)):
        with pytest.raises(ValueError):
            read(text)


def test_any_depth_is_read_and_written():
    for n in (500, 20_000, 200_000):
        text = '{"a":[' * n + '"\\n"' + "]}" * n
        value = strict_json.loads(text)
        assert strict_json.compact(value) == text
        while isinstance(value, (dict, list)):
            value = value["a"] if isinstance(value, dict) else value[0]
        assert value == "\n"
    assert strict_json.loads_or_none("[" * 100_000) is None


STRICT = ['{"a":1}', ' [1, {"b": null}] ', '"x"', "1", "null", '{"a":{"b":1,"b":2}}', '{"a":1,"a":1}', '{"a":1} x', '{"a":1},{"b":2}', "", " ", "[1,]", '{"a":NaN}', '{"a":Infinity}', "{'a':1}", "01", "-0", "1e400", '"\\ud83d\\ude00"', '"\\ud83d"', '"\\\\ud83d"', '"\\udc00"', '"\t"', "//x\n1", "\ufeff{}", "]1[", "1]", "[1", "1],[2", '{"a":1}//', None]


def test_strict_json_as_a_column_equals_the_reader(spark):
    got = values(spark, [(x,) for x in STRICT], "x string", text.is_strict_json(F.col("x")))
    expected = []
    for x in STRICT:
        try:
            strict_json.loads(x) if x is not None else None
            expected.append((None if x is None else True,))
        except ValueError:
            expected.append((False,))
    assert got == expected


def test_whatever_is_not_printable_is_escaped(spark):
    shown = {"a\tb": "a\\tb", "\x1b[31mred": "\\u{1b}[31mred", "\x00\x7f": "\\0\\u{7f}", "caf\u00e9 \U0001f600": "caf\u00e9 \U0001f600", "\u2028\u00a0\u200b": "\\u{2028}\\u{a0}\\u{200b}", "\u0301e\u0301": "\\u{301}e\u0301", "\U000e0001'\"\\": "\\u{e0001}\\'\\\"\\\\", "": "", "plain": "plain"}
    assert values(spark, [(x,) for x in shown], "x string", text.escape_debug(F.col("x"))) == [(x,) for x in shown.values()]


def test_every_planned_facet_is_registered():
    registry = bands.default_registry()
    planned = "subject.crate subject.path.depth session.duration.bucket session.turns.bucket session.tool.errors.bucket session.delegation.depth outcome.class outcome.verification.gate friction.category friction.interruptions.bucket cost.input.tokens.bucket cost.wall.bucket".split()
    assert {tuple(p.split(".", 1)) for p in planned} <= {*registry.tables, *registry.categories}
    duration = registry.lookup("session", "duration.bucket")
    assert [(b.name, b.upper) for b in duration.bands] == [("xs", 300), ("s", 900), ("m", 3600), ("l", 14400), ("xl", None)]


KEYS = st.sampled_from(['"a"', '"b"', '"a\\\\"', '"a\\""', '"\\":"', '"\\u0061"', '"a": "x', '""'])


@settings(max_examples=500, deadline=None)
@given(st.recursive(st.sampled_from(["1", '"v\\":"', '"\\\\"', "null", "[]", "{}"]), lambda x: st.one_of(st.lists(x, max_size=3).map(lambda y: "[" + ",".join(y) + "]"), st.lists(st.tuples(KEYS, st.sampled_from([":", " : ", "\n:"]), x), max_size=3).map(lambda y: "{" + ",".join("".join(z) for z in y) + "}")), max_leaves=8))
def test_repeated_keys_are_never_overlooked(text):
    try:
        expected = strict_json._plain.decode(text)
    except ValueError:
        with pytest.raises(ValueError):
            strict_json.loads(text)
    else:
        assert strict_json.loads(text) == expected
