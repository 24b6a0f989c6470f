import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wattloom.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=120), st.integers(100, 140))
def test_pack_is_valid_and_no_worse_than_first_fit(sizes, capacity):
    sizes = np.array(sizes, np.int64)
    of = packing.pack(sizes, capacity)
    assert len(of) == len(sizes)
    if not len(sizes):
        return
    fill = np.bincount(of, sizes)
    assert fill.max(initial=0) <= capacity and set(of) == set(range(of.max() + 1))
    assert of.max() + 1 <= len(set(packing.first_fit_decreasing(sizes, capacity)))


def test_search_beats_first_fit():
    rng = np.random.default_rng(3)
    worse = better = 0
    for _ in range(30):
        sizes = rng.integers(150, 420, 90)
        a, b = len(set(packing.first_fit_decreasing(sizes, 1000))), len(set(packing.pack(sizes, 1000)))
        worse, better = worse + (b > a), better + (b < a)
    assert not worse and better


def fill(spark, sizes, targets=(("t", 100),)):
    s = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id long, tokens long, container string")
    t = spark.createDataFrame(list(targets), "target_name string, capacity_tokens int")
    return packing.fill_containers(s, t)


def test_every_text_has_its_container(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 5, 40, 60, 99, 100, 101, 350, 1000]) for _ in range(300)]
    rows = fill(spark, sizes, (("t", 100), ("u", 64), ("u", 64), (None, 9), ("z", 0))).collect()
    for name, capacity in (("t", 100), ("u", 64)):
        of, parts = defaultdict(int), defaultdict(list)
        for r in rows:
            if r.target_name == name:
                of[r.container] += r.tokens
                parts[r.doc_id].append((r.piece, r.tokens))
        assert max(of.values()) <= capacity and set(parts) == set(range(len(sizes)))
        for d, p in parts.items():
            assert sum(n for _, n in p) == sizes[d] and (len(p) == 1 or sizes[d] > capacity)
            assert sorted(k for k, _ in p) == list(range(len(p)))
    assert {r.target_name for r in rows} == {"t", "u"}
    assert all(r.fill <= r.capacity for r in rows)


def test_rounds_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 50)
    rng = random.Random(4)
    sizes = [rng.randrange(10, 70) for _ in range(900)]
    report = packing.fill_report(fill(spark, sizes)).first()
    assert report.tokens == sum(sizes) and report.mean_fill > 0.95


def test_empty(spark):
    assert fill(spark, []).count() == 0 and fill(spark, [1], ()).count() == 0


def test_token_sizes(spark):
    rows = [(1, "two words"), (2, ""), (3, None), (4, "<|endoftext|>"), (None, "x"), (5, "ab " * 200_000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, tokens int")
    got = {r.doc_id: r.tokens for r in packing.token_sizes(df).collect()}
    assert got[1] == 2 and got[2] == 0 and got[4] > 1 and set(got) == {1, 2, 4, 5} and got[5] > 200_000
