from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from tracewell.llm import spans

ROW = "doc_id long, text string"


def brute(rows: list[tuple], length: int) -> tuple[set, dict]:
    where = defaultdict(set)
    for i, t in rows:
        for a in range(len(t or "") - length + 1):
            where[t[a : a + length]].add(i)
    pairs = {(a, b) for docs in where.values() for a in docs for b in docs if a < b}
    covered = defaultdict(int)
    for i, t in rows:
        marks = bytearray(len(t or ""))
        for a in range(len(t or "") - length + 1):
            if len(where[t[a : a + length]]) > 1:
                marks[a : a + length] = b"\1" * length
        covered[i] = max(covered[i], sum(marks))
    return pairs, covered


def corpus(seed: int, length: int) -> list[tuple]:
    """Texts over few letters with planted spans of just under, at and over the length, in hot and cold groups."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé漢 😀") for _ in range(n))
    planted = [word(n) for n in (length - 1, length, length + 1, 3 * length, length // 2 + 3)]
    rows = []
    for i in range(60):
        parts = [word(rng.randrange(0, 3 * length)) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(1, planted[0] if rng.random() < 0.5 else rng.choice(planted))
        rows.append((i, "".join(parts)))
    return [*rows, (100, rows[0][1]), (101, rows[0][1]), (102, "a" * 5 * length), (103, "b" + "a" * length), (104, "ab" * 2 * length), (105, ""), (106, planted[1][:-1])]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("max_group", [10_000, 3])
def test_exactly_the_pairs_and_parts_that_are_shared(spark, seed, max_group):
    length = 24
    rows = corpus(seed, length)
    docs = spark.createDataFrame([*rows, (200, None), (None, rows[0][1])], ROW).repartition(3)
    found = spans.repeats(docs, length, max_group)
    pairs, covered = brute(rows, length)
    assert {tuple(r) for r in spans.pairs(found).collect()} == pairs
    parts = {r.doc_id: r for r in spans.shared_parts(docs, found).collect()}
    assert {i: r.shared_chars for i, r in parts.items()} == {i: covered[i] for i in parts} and set(parts) == {i for i, _ in rows} | {200}
    assert all(a.end < b.start for r in parts.values() for a, b in zip(r.spans, r.spans[1:]))


def test_join_for_many_prefixes_gives_the_same(spark, monkeypatch):
    rows = corpus(7, 24)
    docs = spark.createDataFrame(rows, ROW)
    monkeypatch.setattr(spans, "MAX_CARRIED", 1)
    assert {tuple(r) for r in spans.pairs(spans.repeats(docs, 24)).collect()} == brute(rows, 24)[0]


def test_every_shared_span_has_a_common_anchor():
    rng = random.Random(5)
    span = "".join(rng.choice("abcdef") for _ in range(150))
    texts = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 400))) + span + "".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 400))) for _ in range(40)]
    which, pos, hashes = spans.anchors(texts, 150)
    inside = [{int(h) for w, p, h in zip(which, pos, hashes) if w == i and t.index(span) <= p <= t.index(span) + 75} for i, t in enumerate(texts)]
    assert set.intersection(*inside)
    assert len(which) < 0.05 * sum(map(len, texts))


def test_window_hashes_tell_windows_apart():
    codes = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 6], np.uint32)
    for n in (1, 2, 3, 4):
        h = spans.window_hashes(codes, n)
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (tuple(codes[i : i + n]) == tuple(codes[j : j + n]))


def test_empty_table_and_one_very_long_text(spark):
    docs = spark.createDataFrame([], ROW)
    found = spans.repeats(docs)
    assert found.count() == 0 and spans.pairs(found).count() == 0 and spans.shared_parts(docs, found).count() == 0
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij ") for _ in range(300_000))
    docs = spark.createDataFrame([(1, long, 0), (2, "x" * 200 + long[1000:1150], 0), (2, "y", 0)], ROW + ", n_chars int")
    found = spans.repeats(docs)
    assert {tuple(r) for r in spans.pairs(found).collect()} == {(1, 2)}
    assert {r.doc_id: r.shared_chars for r in spans.shared_parts(docs, found).collect()} == {1: 150, 2: 150}


def test_large_classes_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "PAIR_BLOCK", 3)
    monkeypatch.setitem(spans.lookup.__globals__, "HOT_ROWS", 5)
    rows = [(0, "a", i, None, None) for i in range(20)] + [(0, "b", i, None, None) for i in (1, 30)] + [(0, "a", 3, None, None), (1, None, 3, 0, 9)]
    got = sorted(tuple(r) for r in spans.pairs(spark.createDataFrame(rows, spans.FOUND)).collect())
    assert got == sorted([(i, j) for i in range(20) for j in range(i + 1, 20)] + [(1, 30)])
    assert spans.pairs(spark.createDataFrame([], spans.FOUND)).count() == 0
