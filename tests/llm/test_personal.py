from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import personal as p

NAMES = p.Names({p.fold(n): r for n, r in [("Averil", 1), ("Žofka", 1), ("Søryn", 1), ("Tavosh", 2), ("van der Wielke", 2), ("Ó Ferrach", 2), ("Kresnik-Dahl", 2), ("Møllgaard", 2)]})

#: Texts with the pieces marked by brackets and their types in order.
MARKED = [
    ("Reported by ⟦Averil Tavosh⟧, call back on ⟦+17375550148⟧.", "person phone"),
    ('{"who":"⟦Tavosh, Žofka⟧","phone":"⟦(671) 555 0109⟧"}', "person phone"),
    ("Signed-off: ⟦S. Ó Ferrach⟧ <⟦a.b%ops@example.org⟧>", "person email"),
    ("cc: ⟦a_b (at) example.com⟧; contact=⟦x.y+ci [at] corp [dot] z [dot] test⟧;retry", "email email"),
    ("write to ⟦a_b at post dot quern dot example⟧ soon", "email"),
    ("mailto:⟦UPPER52@CORP.TEST⟧ and ⟦m＠example.org⟧", "email email"),
    ("⟦AVERIL C. VAN DER WIELKE⟧ and ⟦søryn møllgaard⟧", "person person"),
    ("tel:⟦462.555.0141⟧ or ⟦020 7946 0252⟧ or ⟦07700 900355⟧ or ⟦+49 (0)30 23125 108⟧ or ⟦0049-30-23125-850⟧ or ⟦+33 1 99 00 85 70⟧", "phone phone phone phone phone phone"),
    ("ssn=⟦979 43 3105⟧ ID no. ⟦161295-95756⟧ ID: ⟦QQ 83 63 70 A⟧ | ⟦YM4180736⟧ drop ⟦912167064⟧ now ⟦984-32-5249⟧", "national_id national_id national_id national_id national_id national_id"),
    ('"I live at ⟦63 Osmund Drive⟧, reach" at ⟦Unit 25, 73 Old Foundry Close⟧.', "address address"),
    ("⟦14c hazelcote st.⟧ is where; ⟦289 avenue du Vieux Lavoir⟧ and ⟦Färberstr. 191⟧, ⟦Am Alten Krug 47⟧, ⟦Obere Mühlgasse 9⟧", "address address address address address"),
    ("epoch 17968380000 came before 17469180000 row 45:18 col 555-1 at line 32, avenue of attack; lane 7 of the build road map", ""),
    ("remote is git@forge.test:infra/x.git see @sampler/core pinned planner@4.1.8 svc-tavosh-03 10.3.1.21 OPS-3871-97 2024-08-12 quota 700-40", ""),
    ("<name redacted> [EMAIL] [PHONE] Averil alone, Tavosh alone; averil.tavosh is no pair; uuid 7d7f01aa-421c-4e76-9a0b-52c1d2e3f4a5", ""),
    ("6 checksums sealed row 45:18 then 99 drive letters", ""),
    ("", ""),
]


@pytest.mark.parametrize("marked, kinds", MARKED)
def test_pieces_and_nothing_else(marked, kinds):
    text = marked.replace("⟦", "").replace("⟧", "")
    expected, at = [], 0
    for i, part in enumerate(marked.split("⟦")):
        inner, _, rest = part.partition("⟧") if i else ("", "", part)
        if inner:
            expected.append((at, at + len(inner)))
        at += len(inner) + len(rest)
    got = p.pieces(text, NAMES)
    assert [(a, b) for _, a, b in got] == expected
    assert [k for k, *_ in got] == kinds.split()
    assert p.pieces(None, NAMES) == []


@pytest.mark.parametrize(
    "text, piece",
    [
        ("I live at Wohnung 4, Lindenstraße 12 now", ("address", "Wohnung 4, Lindenstraße 12")),
        ("at Flat 3, Am Alten Krug 47.", ("address", "Flat 3, Am Alten Krug 47")),
        ("nino QQ 12 3456 C", ("national_id", "QQ 12 3456 C")),
        ("nino QQ1234 56C", ("national_id", "QQ1234 56C")),
        ("nino QQ 8363 70 A", ("national_id", "QQ 8363 70 A")),
        ("write to a_b At post Dot example soon", ("email", "a_b At post Dot example")),
    ],
)
def test_forms_that_no_cheap_test_may_drop(text, piece):
    assert [(kind, text[a:b]) for kind, a, b in p.pieces(text, NAMES)] == [piece]


def tables(spark):
    texts = []
    for i in range(40):
        texts += [f"Reviewer Averil Nakovar sealed {i}", f"Dr. Søryn Tavosh approved {i}", f"Reviewer Žofka Tavosh reviewed {i}", f"Thessaly Møllgaard left the cold buffer {i}", f"warning: cold buffer {i}"]
    texts += ["Ping Thessaly Nakovar about it", "Nakovar, Thessaly wrote", "cold Tavosh"]
    df = spark.createDataFrame([(str(i), "f", t) for i, t in enumerate(texts)] + [("n", "f", None), ("e", "f", "")], "record_key string, field_path string, text string")
    names = spark.createDataFrame([("Averil", "given"), ("Søryn", "given"), ("Žofka", "given"), ("Tavosh", "family"), ("Møllgaard", "family"), (None, "given"), (" ", "family"), ("Averil", "given")], "name string, name_part string")
    return df, names


def test_corpus_discloses_unknown_names_and_no_other_words(spark):
    df, names = tables(spark)
    learned = {r.term: r.role for r in p.disclosing_terms(df, p.known_names(names)).collect()}
    assert learned == {"nakovar": p.FAMILY, "thessaly": p.GIVEN}
    found = p.find(df, p.lexicon(df, names))
    assert found.where("record_key = '200' and pii_type = 'person' and start_pos = 5").count() == 1
    assert found.where("record_key = '201' and start_pos = 0 and end_pos = 17").count() == 1
    assert found.where("record_key in ('202', 'n', 'e')").count() == 0


def test_words_in_shapes_do_not_count_against_a_name(spark):
    df, names = tables(spark)
    inside = [(f"m{i}", "f", f"ask thessaly.nakovar+ci [at] corp [dot] test or come to {i} Old Thessaly Street") for i in range(100)]
    counted = {r.term: (r.role, r.total) for r in p.disclosing_terms(df.unionByName(spark.createDataFrame(inside, df.schema)), p.known_names(names)).collect()}
    alone = {r.term: (r.role, r.total) for r in p.disclosing_terms(df, p.known_names(names)).collect()}
    assert counted == alone and counted["thessaly"] == (p.GIVEN, 42) and counted["nakovar"] == (p.FAMILY, 42)


def test_the_join_for_long_lexica_finds_the_same(spark, monkeypatch):
    df, names = tables(spark)
    carried = sorted(p.find(df, p.lexicon(df, names)).collect())
    monkeypatch.setattr(p, "MAX_CARRIED_TERMS", 1)
    assert sorted(p.find(df, p.lexicon(df, names)).collect()) == carried


def test_sanitised_texts_stay_readable_and_whole(spark):
    df, names = tables(spark)
    extra = df.unionByName(spark.createDataFrame([("x", "f", "Mail a@b.example or Averil Tavosh, 63 Osmund Drive.")], df.schema))
    clean = {r.record_key: r.clean_text for r in p.sanitise(extra, p.lexicon(df, names)).collect()}
    assert len(clean) == extra.count() and clean["x"] == "Mail [EMAIL] or [PERSON], [ADDRESS]." and clean["n"] is None and clean["202"] == "cold Tavosh"
    again = spark.createDataFrame([(k, "f", v) for k, v in clean.items()], df.schema)
    assert p.find(again, p.lexicon(df, names)).count() == 0


def test_sources_and_empty_tables(spark):
    events = spark.createDataFrame([(1, [("k", "a@b.example"), ("k", None)]), (2, None), (3, []), (None, [("k", "x")])], "wire_id long, excerpts array<struct<kind:string,text:string>>")
    assert [tuple(r) for r in p.excerpt_texts(events).collect()] == [("1", "excerpts[0].text", "a@b.example")]
    docs = spark.createDataFrame([("A", '{"payload":{"summary":"s","steps":[{"note":"n"},{"note":null}],"id":"x"}}'), ("B", "{"), ("C", None), (None, "{}"), ("D", '{"payload":"{\\"text\\":\\"t\\"}"}')], "id string, document string")
    assert sorted(tuple(r) for r in p.document_texts(docs).collect()) == [("A", "payload.id", "x"), ("A", "payload.steps[0].note", "n"), ("A", "payload.summary", "s"), ("D", "payload.text", "t")]
    assert p.document_texts(docs, holding=True).count() == 0
    df, names = tables(spark)
    empty = df.limit(0)
    assert p.find(empty, p.lexicon(empty, names)).count() == 0 and p.sanitise(empty, p.lexicon(empty, names.limit(0))).count() == 0


def corpus(spark, *lines):
    texts = [t.format(i=i) for t, n in lines for i in range(n)]
    return spark.createDataFrame([(str(i), "f", t) for i, t in enumerate(texts)], "record_key string, field_path string, text string")


IDS = [("took passport YM41807{i:02d} of {i}", 60), ("passport 979-43-31{i:02d} seen", 60), ("warm buffer {i} was sealed by the planner", 400)]


def test_a_form_that_stands_where_no_other_of_its_type_does_is_refused(spark):
    names = spark.createDataFrame([], "name string, name_part string")
    orders = corpus(spark, *IDS, ("the order 9121670{i:02d} shipped", 99), ("a later order 9121690{i:02d} shipped", 99))
    terms, refused = p.learn(orders, names)
    assert refused == {"national_id:nine"}
    assert p.find(orders, terms, refused).groupBy("pii_type").count().collect() == [("national_id", 120)]
    assert [r.n_replaced for r in p.sanitise(orders, terms, refused).where("clean_text like '%order 912%'").collect()] == [0] * 198
    passports = corpus(spark, *IDS, ("passport 9121670{i:02d} shipped", 99), ("the order {i} shipped", 99))
    terms, refused = p.learn(passports, names)
    assert refused == frozenset() and p.find(passports, terms, refused).count() == 219


def test_forms_hardly_seen_are_decided_by_their_shape(spark):
    one = corpus(spark, ("the order 912167064 shipped", 1), ("call +1 737 555 0148 or mail a@b.example at 63 Osmund Drive", 1))
    terms, refused = p.learn(one, spark.createDataFrame([], "name string, name_part string"))
    assert refused == frozenset()
    assert {r.pii_type for r in p.find(one, terms, refused).collect()} == {"national_id", "phone", "email", "address"}
    assert {(r.form, r.n) for r in p.form_scores(one).collect()} == {("national_id:nine", 1), ("phone:plus", 1), ("email:sign", 1), ("address:drive", 1)}
    assert p.form_scores(one.limit(0)).count() == 0


PARTS = ["a_b", "x.y+c", "@", " At ", " at ", " dot ", "(AT)", "[dot]", ".", "example", "corp.test", " ", ", ", "+1", " 555", "-0148", "(671)", "7375550148", "QQ", " 12 34 56 C", "979-43-3105", "9", "12167064", "id no. ", "ssn=", "63 ", "Osmund ", "Drive", "Flat 2, ", "14c", "bis", " rue", " de la ", "Lindenstraße", " 12", "Am ", "Krug", " 47", "A.", "Averil", " Tavosh", "Tavosh,", "é", "\u00a0", "\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_no_cheap_test_drops_what_its_pattern_matches(text):
    every = re.compile("")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(p, "_MAY_HOLD", every)
        patch.setattr(p, "_MAY_CALL", every)
        patch.setattr(p, "_MAY_IDENTIFY", every)
        patch.setattr(p, "_DIGIT", every)
        patch.setattr(p, "_MAY_END_IN_NUMBER", ("",))
        whole = p.pieces(text, NAMES)
        mails = [m.span() for m in p.EMAIL.finditer(text)]
    assert p.pieces(text, NAMES) == whole
    assert [(a, b) for kind, a, b in p.shapes(text) if kind == "email"] == mails


def test_documents_of_any_depth_are_read(spark):
    deep = '{"payload":{"a":' + '[{"b":' * 300 + '"mail m@example.org"' + "}]" * 300 + "}}"
    (row,) = p.document_texts(spark.createDataFrame([("A", deep)], "id string, document string"), holding=True).collect()
    assert row.text == "mail m@example.org" and row.field_path == "payload.a" + "[0].b" * 300


def test_hot_and_unknown_words_in_the_join_for_long_lexica(spark, monkeypatch):
    df = corpus(spark, ("the Averil Tavosh met the planner {i}", 90), ("the the the {i}", 90))
    names = spark.createDataFrame([("Averil", "given"), ("Tavosh", "family"), ("van der Wielke", "family")], "name string, name_part string")
    monkeypatch.setattr(p, "MAX_CARRIED_TERMS", 1)
    monkeypatch.setattr(p, "_MAP_BITS", 6)
    assert p.find(df, p.lexicon(df, names)).count() == 90
    monkeypatch.setattr(p, "_MAP_BITS", 22)
    assert p.find(df, p.lexicon(df, names)).count() == 90


def test_very_long_text():
    text = "cold buffer " * 50_000 + "Averil Tavosh"
    assert p.pieces(text, NAMES) == [("person", 600_000, 600_013)]
    many = "A. Tavosh a@b.example 020 7946 0252 " * 20_000
    assert [k for k, *_ in p.pieces(many, NAMES)] == ["person", "email", "phone"] * 20_000
