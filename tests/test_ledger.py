from __future__ import annotations

import io
import json

import pytest
from pyspark.sql import functions as F

from tracewell.operators import audit, derived, graph, ledger, quarantine
from tracewell import cli
from tracewell.sources import render
from tracewell.sources.files import FileThere, Folder
from tracewell.sources.inbox import FileInbox, InboxError
from tracewell.sources.store import TABLES, Store, StoreError
from tracewell.streaming.ingest import ingest_batch, ingest_inbox, run_available
from tests.test_quarantine import text

OBS = TABLES["observations"][0]
AT = "2024-01-01 00:00:00"


def ulid(n: int) -> str:
    return f"01ARZ3NDEKTSV4RRFFQ69{n:05d}"


def derivation(n: int, supersedes: int | None = None, **changes) -> tuple:
    doc = {
        "id": ulid(n), "kind": "facet",
        "scope": {"subject": {"kind": "repository", "identifier": "/w"}, "from_occurred_at": "2024-01-01T00:00:00Z", "to_occurred_at": "2024-01-02T00:00:00Z", "selection": []},
        "profile": {"confidence": "strong", "freshness": "current", "contradiction": "uncontested", "scope": "exact"},
        "method": {"kind": "deterministic", "version": "1"},
        "facets": [{"namespace": "s", "name": "area", "value": "auth"}, {"namespace": "s", "name": "tries", "value": 7}, {"namespace": "s", "name": "done", "value": True}],
        "recorded_at": f"2024-01-01T00:00:{n % 60:02d}Z", "supersedes": ulid(supersedes) if supersedes is not None else None,
    } | changes
    return doc["id"], doc["kind"], doc["recorded_at"].replace("Z", "+00:00"), doc["supersedes"], json.dumps(doc)


def derivations(spark, *rows):
    return spark.createDataFrame(list(rows), TABLES["derivations"][0])


def edge(n: int, a: str, b: str, relation: str = "supports", confidence: str = "strong") -> tuple:
    side = lambda k: dict([k.split(":")])
    doc = {"id": ulid(n), "from": side(a), "to": side(b), "relation": relation, "profile": {"confidence": confidence, "freshness": "current", "contradiction": "uncontested", "scope": "exact"}, "method": {"kind": "deterministic", "version": "1"}, "recorded_at": "2024-01-01T00:00:00Z"}
    return ulid(n), a, b, relation, confidence, "2024-01-01T00:00:00+00:00", json.dumps(doc)


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), TABLES["relationships"][0])


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store")).initialize()


def test_outcomes_compare_with_what_is_recorded(spark):
    events = spark.createDataFrame([("h", "s", "e", d, i) for i, d in enumerate("ABA")] + [("h", "s", "f", "A", 9), ("h", "s", "g", "B", 10)], "harness string, session_id string, source_event_id string, event_digest string, wire_id long")
    receipts = spark.createDataFrame([("h", "s", "f", "A", "o1"), ("h", "s", "g", "A", "o2")], TABLES["receipts"][0])
    got = {r.wire_id: r.outcome for r in ledger.outcomes(events, receipts).collect()}
    assert got == {0: "recorded", 1: "identity-conflict", 2: "duplicate", 9: "duplicate", 10: "identity-conflict"}
    summary = ledger.ingest_summary(ledger.outcomes(events, receipts).select("outcome", F.lit(None).cast("string").alias("reason")))
    assert render.summary_text(summary) == "Ingested 1 recorded, 2 duplicate, 2 quarantined\nQuarantine identity-conflict: 2\n"
    assert json.loads(render.summary_json(summary))["reasons"] == {"identity-conflict": 2}
    assert ledger.outcomes(events.limit(0), receipts).count() == 0


def test_notes_listing_and_limits(spark, store):
    for i, summary in enumerate(["first", "tab\tline\nend"]):
        assert store.append_observations(f"n{i}", render.note(spark, f"  {summary} ", "/w", f"2024-01-0{i + 1} 00:00:00.5"))
    observations = store.read("observations")
    lines = render.listing(observations).split("\n")
    assert lines[0] == render.HEADER and lines[1].endswith("\tmanual-intervention\ttab\\tline\\nend") and lines[2].endswith("\tfirst")
    assert len(json.loads(render.listing_json(observations, 1))) == 1
    assert audit.observation_rows(audit.checked_documents(observations)).count() == 0
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            ledger.newest(observations, bad)
    with pytest.raises(ValueError):
        render.note(spark, " \t", "/w", AT)
    with pytest.raises(StoreError):
        store.append_observations("again", observations)
    assert store.append_observations("n0", observations) is False


def test_export_is_a_pure_projection(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "x string, n long")
    render.export(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    store = Store(spark, str(tmp_path / "store")).initialize()
    store.append_observations("a", render.note(spark, "one", "/w", AT))
    assert render.export_new(store, "observations", str(tmp_path / "log")) == ["a"]
    store.append_observations("b", render.note(spark, "two", "/w", AT))
    assert render.export_new(store, "observations", str(tmp_path / "log")) == ["b"] and render.export_new(store, "observations", str(tmp_path / "log")) == []
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_window_is_closed_and_inverted_ones_refused(spark):
    df = spark.createDataFrame([(1, AT), (2, "2024-01-02 00:00:00"), (3, "2024-01-02 00:00:01"), (4, None)], "i int, occurred_at string").withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))
    assert [r.i for r in ledger.in_scope(df, start=AT, end="2024-01-02 00:00:00").collect()] == [1, 2]
    with pytest.raises(ValueError):
        ledger.in_scope(df, start="2024-01-02", end="2024-01-01")


def test_snapshots_and_differences(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string")
    assert ledger.snapshot_digest(a).collect() == ledger.snapshot_digest(a.orderBy("s")).collect()
    assert {(r.i, r.surplus) for r in ledger.differences(a, a.distinct()).collect()} == {(1, 1)}


def test_derived_views(spark):
    d = derivations(spark, derivation(1), derivation(1), derivation(2, 1), derivation(3), derivation(4, supersedes=99))
    facets = derived.project_facets(d)
    rows = {(r.derivation_id[-1], r.name): (r.slot, r.text_value, r.integer_value, r.boolean_value) for r in facets.collect()}
    assert rows["1", "area"] == ("text", "auth", None, None) and rows["1", "tries"] == ("integer", None, 7, None) and rows["1", "done"] == ("boolean", None, None, 1)
    view = derived.current_facets(facets, d)
    assert {r.derivation_id[-1]: r.current for r in view.collect()} == {"1": False, "2": True, "3": True, "4": True}
    (count,) = derived.aggregate(view, "s", "area").collect()
    assert (count.text_value, count.cnt, count.freshness) == ("auth", 3, "current")
    assert derived.aggregate(view, "s", "area", include_superseded=True).collect()[0].cnt == 4
    assert {r.id[-1] for r in derived.heads(d).collect()} == {"2", "3", "4"}
    assert derived.selected(facets, [("s", "area", "auth"), ("s", "tries", 7), ("s", "done", True)]).count() == 4
    with pytest.raises(ValueError):
        derived.selected(facets, [("s", " ", "x")])
    assert derived.scoped(facets, d, ("repository", "/w"), "2024-01-01 00:00:00", "2024-01-02 00:00:00").count() == 12
    assert derived.scoped(facets, d, ("repository", "/other")).count() == 0
    assert derived.clusters(d).collect()[0].n == 4


def test_refusals(spark):
    assisted = {"kind": "assisted", "model": "m", "prompt_version": "1"}
    weak = {"confidence": "weak", "freshness": "current", "contradiction": "contested", "scope": "exact"}
    d = derivations(
        spark, derivation(1, facets=[]), derivation(2, kind="aggregate"), derivation(3, supersedes=3), derivation(4, method=assisted), derivation(5, method=assisted, profile=weak), derivation(6), (ulid(7), "facet", "x", None, "{"), (ulid(8), "facet", "x", None, None)
    )
    got = {(r.id[-1], r.rule) for r in derived.refusals(d).collect()}
    assert got == {("1", "facet-kind-mismatch"), ("2", "facet-kind-mismatch"), ("3", "self-supersession"), ("4", "ungated-disposition"), ("7", "unreadable"), ("8", "unreadable")}


def test_graph(spark):
    a, b, c = (f"derivation:{ulid(i)}" for i in (1, 2, 3))
    r = edges(spark, edge(10, a, b), edge(10, a, b), edge(11, b, c, "refutes"), edge(12, c, a, "caused-by"))
    assert graph.neighbours(r, a).count() == 2 and graph.neighbours(r, a, "caused-by").count() == 1
    assert graph.both_ways(r).count() == 6
    start = spark.createDataFrame([(a,)], "key string")
    assert {(x.key, x.distance) for x in graph.explain(r, start, 3).collect()} == {(a, 0), (b, 1), (c, 1)}
    d = derivations(spark, derivation(1), derivation(2, 1))
    assert {(x.from_key[-1], x.missing) for x in derived.supersession_agreement(d, r).collect()} == {("2", "edge")}
    assert {x.key for x in derived.dangling(r, d, spark.createDataFrame([], OBS)).collect()} == {c}
    links = derived.evidence_of(r)
    assert {(x.derivation_key[-1], x.supporting, x.refuting) for x in derived.corroboration(links).collect()} == {("1", 1, 0), ("2", 0, 1)}
    assert ("2", "uncontested-but-refuted") in {(x.id[-1], x.warning) for x in derived.evidence_warnings(d, links).collect()}
    new = derivations(spark, derivation(1, supersedes=2))
    assert graph.closes_cycle(derivations(spark, derivation(2, 1)), new).count() == 1


def test_store_refuses_and_commits_together(spark, store):
    d = derivations(spark, derivation(1), derivation(2, 1))
    assert store.append_derivations("d1", d)
    assert store.read("derivations").count() == 2 and store.read("derivation_facets").count() == 6
    assert store.append_derivations("d2", derivations(spark, derivation(3))) and not store.commit("d2", {})
    with pytest.raises(StoreError):
        store.append_derivations("d3", derivations(spark, derivation(1)))
    with pytest.raises(StoreError):
        store.append_derivations("d4", derivations(spark, derivation(8, 9), derivation(9, 8)))
    with pytest.raises(StoreError):
        store.append_derivations("d5", derivations(spark, derivation(10)), registered=spark.createDataFrame([("s", "area")], "namespace string, name string"))
    a, b = f"derivation:{ulid(1)}", f"derivation:{ulid(2)}"
    assert store.append_relationships("r1", edges(spark, edge(20, a, b)))
    for bad in (edge(21, a, a), edge(22, a, b, "likes"), edge(23, a, f"derivation:{ulid(77)}"), edge(24, a, b, confidence="sure")):
        with pytest.raises(StoreError):
            store.append_relationships("r2", edges(spark, bad))
    # a batch without its manifest is invisible, and running it again succeeds
    derivations(spark, derivation(30)).write.parquet(f"{store.root}/derivations/batch=dead")
    assert store.read("derivations").count() == 3
    assert store.append_derivations("dead", derivations(spark, derivation(30)))
    assert store.open().version() == 3 and store.initialize().read("observations").count() == 0
    with pytest.raises(StoreError):
        Store(spark, store.root + "-none").open()


def test_audits_flag_drift(spark, store):
    ingest_batch(store, spark.createDataFrame([(1, "a.json", text()), (2, "b.json", text(source_event_id="e2"))], "raw_id long, file_name string, body string"), "b1", AT)
    o, r = store.read("observations"), store.read("receipts")
    d, f, e = derivations(spark, derivation(1)), derived.project_facets(derivations(spark, derivation(1))), edges(spark, edge(1, f"derivation:{ulid(1)}", f"derivation:{ulid(2)}"))
    assert audit.full(o, r, d, f, e).count() == 0
    checks = lambda *tables: {(x.check, x.detail) for x in audit.full(*tables).collect()}
    first = F.row_number().over(__import__("pyspark").sql.Window.orderBy("id")) == 1
    tampered = o.withColumn("document", F.when(first, F.replace("document", F.lit('"event_type":"t"'), F.lit('"event_type":"u"'))).otherwise(F.col("document")))
    assert {("observation", "digest"), ("receipt", "digest")} <= checks(tampered, r, d, f, e)
    assert ("observation", "observed_at") in checks(o.withColumn("observed_at", F.lit("2025-01-01T00:00:00+00:00")), r, d, f, e)
    assert any(c == "no-receipt" for c, _ in checks(o, r.limit(1), d, f, e))
    assert ("receipt", "identity") in checks(o, r.withColumn("session_id", F.lit("x")), d, f, e)
    assert ("receipt", "malformed-digest") in checks(o, r.withColumn("event_digest", F.lit("X")), d, f, e)
    assert ("facet", "missing") in checks(o, r, d, f.where("slot <> 'text'"), e)
    assert ("slot", "text") in checks(o, r, d, f.withColumn("integer_value", F.lit(1)), e)
    assert ("derivation", "kind") in checks(o, r, d.withColumn("kind", F.lit("cluster")), f, e)
    assert ("relationship", "relation") in checks(o, r, d, f, e.withColumn("relation", F.lit("refutes")))
    assert {x.key for x in audit.full(o, r, d, f, e.withColumn("relation", F.lit("likes"))).where("check = 'vocabulary-relationship'").collect()} == {"relation=likes"}
    assert audit.schema_drift(o, "id string, observed_at long") == ["extra document", "type observed_at"]


FILES = {"b.json": text(), "a.json": text(excerpts=[{"kind": "k", "text": "other"}]), "c.json": text(), "d.json": "{", "e.json": text(source_event_id="e9"), ".hidden.json": text(), "x.tmp": "{"}


def test_stream_takes_what_is_there_once(spark, store, tmp_path):
    box = tmp_path / "inbox"
    box.mkdir()
    for name, body in FILES.items():
        (box / name).write_text(body)
    (box / "bytes.json").write_bytes(b'{"schema":"\xff"}')
    run = lambda name: run_available(spark, store, str(box), str(tmp_path / "check"), AT, run=name)
    (summary,) = [s.collect()[0] for s in run("one")]
    assert (summary.recorded, summary.duplicate, summary.quarantined, summary.reasons) == (2, 0, 4, {"identity-conflict": 2, "invalid-json": 2})
    assert run("two") == [] and store.read("observations").count() == 2 and store.read("quarantine").count() == 4
    # the same files again, under another run, are duplicates and conflicts, and change nothing
    again = ingest_batch(store, store.read("quarantine").select("raw_id", "file_name", "body").unionByName(spark.createDataFrame([(7, "z.json", FILES["a.json"])], "raw_id long, file_name string, body string")), "again", AT).collect()[0]
    assert again.recorded == 0 and again.duplicate == 1 and store.read("observations").count() == 2
    files = sum(len(x) for x in [FILES]) - 2 + 1
    assert summary.recorded + summary.duplicate + summary.quarantined == files


def test_file_inbox(tmp_path):
    state = tmp_path / "state"
    with FileInbox(state) as box:
        with pytest.raises(InboxError):
            FileInbox(state)
        for name in ("b.json", "a.json", "c.tmp"):
            (box.inbox / name).write_text(name)
            (box.inbox / name).chmod(0o600)
        claims = list(box.claims())
        assert [c.read_text() for c in claims] == ["a.json", "b.json"]
        box.complete(claims[0])
        box.refuse(claims[1], "invalid-json")
        assert sorted(p.suffix for p in box.quarantine.iterdir()) == [".json", ".reason"]
        assert {e["dir"] for e in box.inventory()} == {"inbox", "quarantine"}
    lone = next(p for p in (state / "quarantine").iterdir() if p.suffix == ".reason")
    lone.unlink()
    with FileInbox(state) as box:
        assert lone.read_text() == "incomplete-quarantine"
        (box.inbox / "open.json").write_text("x")
        (box.inbox / "open.json").chmod(0o644)
        with pytest.raises(InboxError):
            box.inventory()


def test_repository_root(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert render.repository_root(tmp_path / "a" / "b") == tmp_path.resolve()


def test_documents_as_events_again(spark, store):
    ingest_batch(store, spark.createDataFrame([(1, "a.json", text(facets=[{"name": "n", "value": 7}], harness={"name": "h"}))], "raw_id long, file_name string, body string"), "b1", AT)
    o = store.read("observations")
    (event,) = quarantine.valid_events(ledger.reconstructed_events(o), key="id").collect()
    assert event.source_event_id == "e1" and event.facets[0].integer_value == 7 and event.harness.version is None
    broken = o.withColumn("document", F.replace("document", F.lit('"version":null'), F.lit('"edition":null')))
    assert [r.reason for r in ledger.reconstructed_events(broken).collect()] == ["invalid-json"]
    assert ledger.reconstructed_events(o.limit(0)).count() == 0


FILE = "raw_id long, file_name string, body string"


def one_file(spark, **changes):
    return spark.createDataFrame([(1, "a.json", text(**changes))], FILE)


def test_a_tampered_row_is_found_beside_the_good_one(spark, store):
    ingest_batch(store, one_file(spark), "b1", AT)
    good = store.read("observations")
    bad = good.withColumn("document", F.replace("document", F.lit('"event_type":"t"'), F.lit('"event_type":"u"')))
    for rows in (good.unionByName(bad), bad.unionByName(good), good.unionByName(good).unionByName(bad)):
        assert [r.detail for r in audit.observation_rows(audit.checked_documents(rows)).collect()] == ["digest"]
        assert [r.detail for r in audit.receipt_rows(store.read("receipts"), audit.checked_documents(rows)).collect()] == ["digest"]
    d = derivations(spark, derivation(1), derivation(1, kind="cluster"))
    assert [r.rule for r in derived.refusals(d).collect()] == ["facet-kind-mismatch"]


def test_clusters_tell_types_and_separators_apart(spark):
    facet = lambda *values: [{"namespace": "s", "name": f"n{i}", "value": v} for i, v in enumerate(values)]
    d = derivations(spark, derivation(1, facets=facet("1")), derivation(2, facets=facet(1)), derivation(3, facets=facet(True)), derivation(4, facets=facet("true")), derivation(5, facets=facet("a;s.n1=b")), derivation(6, facets=facet("a", "b")), derivation(7, facets=facet(1)))
    got = sorted((r.n, r.first_id[-1]) for r in derived.clusters(d).collect())
    assert got == [(1, "1"), (1, "3"), (1, "4"), (1, "5"), (1, "6"), (2, "2")]


def test_documents_that_are_no_strict_json_are_unreadable_everywhere(spark):
    row = derivation(1)
    twice, after = row[4].replace('"kind"', '"kind":"facet","kind"', 1), row[4] + " x"
    d = derivations(spark, (*row[:4], twice), (ulid(2), *row[1:4], after))
    assert {r.rule for r in derived.refusals(d).collect()} == {"unreadable"} and derived.project_facets(d).count() == 0
    o = spark.createDataFrame([("A", AT, '{"kind":"k","kind":"k"}'), ("B", AT, '{"kind":"k"} x'), ("C", AT, '{"kind":"k"}')], OBS)
    assert {r.id: r.kind for r in ledger.list_view(o).collect()} == {"A": None, "B": None, "C": "k"}


def test_of_rows_that_differ_under_one_key_the_same_one_is_taken(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, None)], "k string, n int, s string")
    for rows in (df, df.orderBy("n"), df.orderBy(F.desc("n"))):
        assert sorted(tuple(r) for r in derived.once(rows, "k").collect()) == [("a", 1, "y"), ("b", None, None)]


def test_stale_needs_a_reason(spark):
    stale = {"confidence": "weak", "freshness": "stale", "contradiction": "contested", "scope": "exact"}
    d = derivations(spark, derivation(1, profile=stale), derivation(2, profile=stale), derivation(3, supersedes=2), derivation(4, profile=stale))
    links = derived.evidence_of(edges(spark, edge(10, f"derivation:{ulid(4)}", f"derivation:{ulid(3)}", "refutes")))
    assert [r.id[-1] for r in derived.evidence_warnings(d, links).where("warning = 'stale-without-reason'").collect()] == ["1"]


def test_appends_verify_what_they_take(spark, store):
    note = render.note(spark, "a note", "/w", AT)
    forged = note.withColumn("document", F.replace("document", F.lit("a note"), F.lit("another")))
    other_instant = note.withColumn("observed_at", F.lit("2025-01-01T00:00:00+00:00"))
    for bad in (forged, other_instant, note.withColumn("id", F.lit("X")), note.withColumn("document", F.concat("document", F.lit(" x"))), note.withColumn("document", F.lit(None).cast("string"))):
        with pytest.raises(StoreError, match="integrity"):
            store.append_observations("n", bad)
    assert store.append_observations("n", note)
    fated = cut_rows(spark, text(), text(source_event_id="e2"))
    for bad in (fated.withColumn("session_id", F.lit("x")), fated.withColumn("event_digest", F.sha2("event_digest", 256)), fated.withColumn("event_digest", F.lit("?"))):
        with pytest.raises(StoreError, match="receipt"):
            store.append_harness("h", bad)
    with pytest.raises(StoreError, match="receipt|needs"):
        store.append_observations("h", fated.select("id", "observed_at", "document"))
    assert {r.outcome for r in store.record_harness("h", fated.limit(1)).collect()} == {"recorded"}
    again = cut_rows(spark, text(), text(source_event_id="e2"), at="2024-02-01 00:00:00")
    assert sorted(r.outcome for r in store.record_harness("h2", again).collect()) == ["duplicate", "recorded"]
    changed = cut_rows(spark, text(event_type="u"), at="2024-03-01 00:00:00")
    assert [r.outcome for r in store.record_harness("h3", changed).collect()] == ["identity-conflict"]
    assert store.read("receipts").count() == 2 and store.violations().count() == 0


def cut_rows(spark, *bodies, at=AT):
    judged = quarantine.classify(spark.createDataFrame([(i, f"{i}.json", b) for i, b in enumerate(bodies)], FILE))
    return ledger.harness_observations(ledger.identified(quarantine.valid_events(judged)), F.lit(at).cast("timestamp"), "c").orderBy("id")


def test_opening_verifies_and_migration_adds_tables(spark, tmp_path):
    old = Store(spark, str(tmp_path / "old")).initialize(1)
    with pytest.raises(StoreError, match="migration"):
        old.open()
    assert old.append_observations("n", render.note(spark, "a note", "/w", AT))
    with pytest.raises(StoreError, match="migration"):
        old.append_derivations("d", derivations(spark, derivation(1)))
    assert old.initialize().open().version() == 3 and old.append_derivations("d", derivations(spark, derivation(1)))
    with pytest.raises(StoreError):
        old.migrate()
    with pytest.raises(StoreError):
        old.initialize(2)
    forged = old.read("observations").withColumn("document", F.replace("document", F.lit("a note"), F.lit("x")))
    forged.write.mode("append").parquet(f"{old.root}/observations/batch=n")
    assert old.open(verify=False)
    with pytest.raises(StoreError, match="digest"):
        old.open()
    (tmp_path / "old" / "schemas" / "receipts.ddl").write_text("harness string")
    assert old.schema_faults() == ["columns of receipts"]
    (tmp_path / "old" / "schemas" / "receipts.ddl").unlink()
    assert old.schema_faults() == ["missing receipts"]
    (tmp_path / "old" / "version-3").chmod(0o666)
    assert len(old.unsafe_files()) == 1
    (tmp_path / "link").symlink_to(tmp_path / "old")
    with pytest.raises(StoreError, match="unsafe"):
        Store(spark, str(tmp_path / "link")).open(verify=False)


def test_every_guard_refuses_its_probe(spark, store, monkeypatch):
    ingest_batch(store, one_file(spark), "b1", AT)
    assert store.probes() == [] and store.read("receipts").count() == 1
    monkeypatch.setattr(Store, "_check_edges", lambda *_: None)
    monkeypatch.setattr(Store, "_new_keys", lambda *_: None)
    assert {"self edge", "unknown relation", "repeated receipts", "receipts there already"} <= set(store.probes())


def test_a_file_is_created_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "x"))
    folder.put("a/b.json", "1")
    with pytest.raises(FileThere):
        folder.put("a/b.json", "2")
    assert folder.get("a/b.json") == "1" and folder.names("a") == ["b.json"] and folder.names("none") == [] and folder.get("none") is None


def fill(box: FileInbox, files: dict[str, str]) -> None:
    for name, body in files.items():
        (box.inbox / name).write_text(body)
        (box.inbox / name).chmod(0o600)


class Killed(RuntimeError):
    pass


@pytest.mark.parametrize("step", ["commit", "complete", "after the reason"])
def test_a_run_that_is_killed_between_steps_loses_and_repeats_nothing(spark, store, tmp_path, monkeypatch, step):
    files = {"b.json": text(), "a.json": text(excerpts=[{"kind": "k", "text": "other"}]), "c.json": text(source_event_id="e2"), "d.json": "{", "e.json": ""}
    calls = []

    def kill(*_: object, **__: object) -> None:
        calls.append(1)
        raise Killed

    with pytest.raises(Killed), FileInbox(tmp_path / "state") as box:
        fill(box, files)
        with monkeypatch.context() as patch:
            owner = Store if step == "commit" else FileInbox
            if step == "after the reason":
                patch.setattr("tracewell.sources.inbox.os.rename", kill)
            else:
                patch.setattr(owner, step, kill)
            ingest_inbox(store, box, AT)
    assert calls
    with FileInbox(tmp_path / "state") as box:
        summary = ingest_inbox(store, box, "2024-01-02 00:00:00").collect()[0]
        assert not list(box.inbox.iterdir()) and not list(box.processing.iterdir())
        reasons = {p.read_text() for p in box.quarantine.iterdir() if p.suffix == ".reason"}
        bodies = [p.read_text() for p in box.quarantine.iterdir() if p.suffix == ".json"]
    assert reasons == {"identity-conflict", "invalid-json", "empty-event"} and sorted(bodies) == sorted([files["b.json"], files["d.json"], files["e.json"]])
    assert store.read("observations").count() == 2 == store.read("receipts").count() and store.violations().count() == 0
    assert summary.recorded + summary.duplicate + summary.quarantined <= len(files)


def test_an_inbox_is_loaded_in_claim_order_and_found_empty_afterwards(spark, store, tmp_path):
    with FileInbox(tmp_path / "state") as box:
        assert tuple(ingest_inbox(store, box, AT).collect()[0])[:3] == (0, 0, 0)
        fill(box, {"b.json": text(), "a.json": text(event_type="first"), "c.json": text(event_type="first")})
        summary = ingest_inbox(store, box, AT).collect()[0]
        assert (summary.recorded, summary.duplicate, summary.quarantined, summary.reasons) == (1, 1, 1, {"identity-conflict": 1})
        assert tuple(ingest_inbox(store, box, AT).collect()[0])[:3] == (0, 0, 0)


def test_commands(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "deep").mkdir()

    def run(*argv: str) -> str:
        out = io.StringIO()
        cli.run(list(argv), spark, tmp_path / "deep", out)
        return out.getvalue()

    with pytest.raises(StoreError):
        run("note", "--summary", "x")
    assert "Initialized" in run("init") and "Initialized" in run("init")
    assert "Recorded" in run("note", "--summary", " by hand\tthen ")
    state = tmp_path / cli.HOME / "state"
    with FileInbox(state) as box:
        fill(box, {"a.json": text(), "b.json": "{"})
    assert json.loads(run("ingest", "--json")) == {"recorded": 1, "duplicate": 0, "quarantined": 1, "reasons": {"invalid-json": 1}}
    assert run("ingest").startswith("Ingested 0 recorded, 0 duplicate, 0 quarantined")
    lines = run("observation", "list", "--limit", "5").splitlines()
    assert lines[0] == render.HEADER and len(lines) == 3 and any(x.endswith("by hand\\tthen") for x in lines)
    assert len(json.loads(run("observation", "list", "--json", "--limit", "1"))) == 1
    for bad in (["observation", "list", "--limit", "1001"], ["observation", "list", "--limit", "0"], ["fly"]):
        with pytest.raises(SystemExit):
            run(*bad)
    with pytest.raises(StoreError):
        cli.run(["init"], spark, "/", io.StringIO())
