from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import packing, tokens

SIZES, PACKS = "doc_id long, n_tokens long", "pack_name string, capacity_tokens int"


def check(spark, sizes: list[tuple], packs: list[tuple], partitions: int = 4):
    rows = packing.pack(spark.createDataFrame(sizes, SIZES).repartition(partitions), spark.createDataFrame(packs, PACKS)).collect()
    usable = [(d, n) for d, n in sizes if d is not None and n]
    for name, capacity in {p for p in packs if p[0] and p[1] and p[1] > 0}:
        own = [r for r in rows if r.pack_name == name and r.capacity == capacity]
        used: dict = {}
        for r in own:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        assert all(u <= capacity for u in used.values())
        assert sum(used.values()) == sum(n for _, n in usable)
        want = sorted((d, i, i * capacity, min(capacity, n - i * capacity)) for d, n in usable for i in range(math.ceil(n / capacity)))
        assert sorted((r.doc_id, r.piece_no, r.start_token, r.n_tokens) for r in own) == want
    return rows


def test_whole_texts_in_nearly_full_containers(spark):
    rng = random.Random(1)
    sizes = [(i, min(3000, int(rng.expovariate(1 / 200)) + 1)) for i in range(3000)]
    rows = check(spark, sizes, [("short", 256), ("long", 4096)], 6)
    for name, capacity in (("short", 256), ("long", 4096)):
        bins = len({r.container_id for r in rows if r.pack_name == name})
        assert bins <= 1.02 * math.ceil(sum(n for _, n in sizes) / capacity) + 1


def test_items_that_cannot_be_combined(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 40)
    rows = check(spark, [(i, 60 + i % 30) for i in range(300)], [("p", 100)])
    assert len({r.container_id for r in rows}) == 300


def test_nulls_empties_repeats_and_exact_fits(spark):
    check(spark, [(1, 10), (1, 10), (2, 0), (3, None), (None, 5), (4, 100), (5, 200), (6, 201)], [("p", 100), ("p", 100), (None, 5), ("q", None), ("z", 0), ("one", 1)])
    assert check(spark, [], [("p", 10)]) == [] and check(spark, [(1, 5)], []) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_takes_the_tightest_container(sizes):
    fit, left = packing.BestFit(50), []
    for s in sizes:
        fit.add(s, s)
        fitting = [x for x in left if x >= s]
        if fitting:
            left.remove(min(fitting))
            left.append(min(fitting) - s)
        else:
            left.append(50 - s)
        assert sorted(fit.left) == sorted(left)


def test_too_many_packs_are_refused(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 1)], SIZES), spark.createDataFrame([(f"p{i}", 5) for i in range(1001)], PACKS))


def test_token_counts_of_every_kind_of_tokenizer(spark):
    folder = tokens.DEFAULT_TOKENIZER.rsplit("/", 1)[0]
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        df = spark.createDataFrame([(1, "Hello world, hello <|endoftext|>", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, n_tokens string")
        got = {r.doc_id: r.n_tokens for r in tokens.with_tokens(df, path=f"{folder}/{name}").collect()}
        assert got[1] > 5 and got[2] == got[3] == 0
    assert tokens.count_tokens("x y " * 120_000) == 240_001  # "x", " y", " x", ..., and the space at the end


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "word ", " ", "  ", "\n", "12", "3x", "don't", "'s ", "é", "漢字", "😀", "...", "_", "\u00a0", "\x1c", "²"]), max_size=40).map("".join))
def test_texts_are_sized_as_a_whole_however_long(text):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "_STRETCH", 10**9)
        whole = tokens.count_tokens(text)
        for stretch in (1, 2, 5):
            patch.setattr(tokens, "_STRETCH", stretch)
            assert tokens.count_tokens(text) == whole
            assert "".join(tokens._stretches(text)) == text
