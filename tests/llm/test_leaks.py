import random

import numpy as np
from wattloom.llm import leaks

DOC, ITEM = "doc_id long, text string, item_id long", "item_id long, text string, lang string"
VOCAB = [f"{a}{b}" for a in ("stone", "river", "móvil", "grün", "fast", "lamp", "cloud", "wheel") for b in ("", "s", "ig", "ton", "42")]


def sentence(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def test_words():
    t = "> Élan&nbsp;vital, <b>naıve</b> **53.1** km/h\r\n> café &amp; Ünder"
    assert leaks.words(t) == ["elan", "vital", "naıve", "531", "kmh", "cafe", "under"]
    assert leaks.words("if a < b and c > d <!-- x --> <br/>") == ["if", "a", "b", "and", "c", "d"]
    assert leaks.words("a <b " + "x" * 500 + ">c") == ["a", "c"]
    assert leaks.words("") == [] and leaks.words("<>!?") == []


def run_in_common(a, b):
    return leaks.longest_run(a, b)[0]


def test_longest_run():
    assert leaks.longest_run("a b c d".split(), "x b c d y".split()) == (3, 1)
    assert leaks.longest_run([], ["a"]) == (0, 0)


def corpus(seed=1):
    rng = random.Random(seed)
    items = [(k, " ".join(sentence(rng, rng.randrange(14, 60)))) for k in range(40)]
    docs = []
    for d in range(150):
        body = sentence(rng, rng.randrange(0, 80))
        if d % 3 == 0:
            w = rng.choice(items)[1].split()
            n = min(len(w), rng.choice([8, 11, 12, 13, 20, 60]))
            i = rng.randrange(len(w) - n + 1)
            part = w[i : i + n]
            style = d % 5
            if style == 1:
                part = [x.upper() for x in part]
            if style == 2:
                part = [f"<i>{x}</i>," for x in part]
            if style == 3:
                part = [x + ("\n>" if j % 6 == 5 else "") for j, x in enumerate(part)]
            body[len(body) // 2 : len(body) // 2] = part
        docs.append((d, " ".join(body)))
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    docs += [(900, None), (None, items[0][1]), (901, ""), (902, items[0][1]), (902, items[0][1])]
    items = [*items, (77, None), (78, "too short to leak"), (None, "x " * 30)]
    df = leaks.leaks(spark.createDataFrame([(*d, 5) for d in docs], DOC), spark.createDataFrame([(*i, "en") for i in items], ITEM))
    got = {(r.doc_id, r.item_id) for r in df.where("run_words >= 12").collect()}
    expected = {
        (d, i) for d, t in docs if t and d is not None for i, s in items if s and i is not None
        if run_in_common(leaks.words(t), leaks.words(s)) >= 12
    }
    assert got == expected and len(expected) > 15


def searched(docs, items):
    import pandas as pd

    held = leaks.Items(items)
    frame = pd.DataFrame(docs, columns=["doc_id", "text"])
    return sorted(r for x in leaks._search(held, leaks.Anchors(held))(iter([frame])) for r in x.itertuples(index=False, name=None))


def test_regions_do_not_depend_on_their_company(monkeypatch):
    docs, items = corpus(3)
    results = []
    for size in (500, 400_000):
        monkeypatch.setattr(leaks, "CHARS_AT_ONCE", size)
        results.append(searched(docs, items))
    assert results[0] == results[1] and results[0]


def test_items_as_a_table_give_the_same_rows(spark, monkeypatch):
    docs, items = corpus(4)
    docs += [(900, items[1][1]), (900, items[1][1]), (901, None)]
    items = [*items, (3, items[9][1]), (5, items[5][1]), (78, "too short")]
    args = spark.createDataFrame([(*d, 5) for d in docs], DOC), spark.createDataFrame([(*i, "en") for i in items], ITEM)
    rows = []
    for most in (10**6, 0):
        monkeypatch.setattr(leaks, "ITEM_CHARS", most)
        rows.append(sorted(map(tuple, leaks.leaks(*args).collect())))
    assert rows[0] == rows[1] and len(rows[0]) > 30


def test_ten_thousand_items_in_one_scan(spark, capsys):
    """Whatever the number of items, the documents are scanned once and none stay in the plan."""
    rng = random.Random(5)
    items = [(k, " ".join(f"{rng.choice(VOCAB)}{rng.randrange(50)}" for _ in range(20))) for k in range(10_000)]
    docs = [(d, " ".join([*sentence(rng, 30), *items[d * 37][1].split()[3:18], *sentence(rng, 9)])) for d in range(200)]
    df = leaks.leaks(spark.createDataFrame([(*d, 5) for d in docs], DOC), spark.createDataFrame([(*i, "en") for i in items], ITEM))
    df.explain()
    assert capsys.readouterr().out.count("MapInPandas") == 1
    assert {(r.doc_id, r.item_id) for r in df.where("run_words >= 12").collect()} == {(d, d * 37) for d in range(200)}


def test_every_run_of_grams_holds_an_anchor():
    rng = np.random.default_rng(3)
    for window in (1, 2, 7, 50, 300):
        h, counts = rng.integers(0, 40, 200).astype(np.uint64), rng.integers(1, 5, 200)
        at = set(leaks.anchors(h, counts, window).tolist())
        assert all(at & set(range(i, i + window)) for i in range(max(1, 201 - window)))
    assert len(leaks.anchors(h[:0], counts[:0], 3)) == 0


def test_any_single_edit_is_found():
    """A passage as short as any leak comes out with an edit at any of its characters."""
    rng = random.Random(12)
    item = [f"{rng.choice(VOCAB)}{k}" for k in range(16)]
    passage = " ".join(item[2:15])
    docs = []
    for i in range(1, len(passage) - 1):
        for k, cut in enumerate(("", "x", "y")):
            docs.append((len(docs), " ".join(sentence(rng, 5)) + f" {passage[:i]}{cut}{passage[i + (k < 2):]} " + " ".join(sentence(rng, 5))))
    rows = searched(docs, [(1, " ".join(item))])
    assert {r[0] for r in rows} == set(range(len(docs)))


def test_filter_of_a_column_is_that_of_its_keys(spark):
    from wattloom.llm import bloom

    keys = leaks.gram_hashes(np.arange(5000, dtype=np.uint32), 4)
    df = spark.createDataFrame([(int(x),) for x in keys.view(np.int64)], "h long")
    one, two = bloom.of_keys(keys), bloom.of_column(df, "h", len(keys))
    assert (one == two).all() and bloom.passes(one, keys).all()
    strangers = leaks.gram_hashes(np.arange(10**6, 10**6 + 50_000, dtype=np.uint32), 4)
    assert bloom.passes(one, strangers).mean() < 0.05
    assert bloom.size_for(10**12) == bloom.MOST_BITS and not bloom.passes(bloom.of_column(df.limit(0), "h", 0), keys).any()


def test_altered_passages_come_out_as_regions(spark):
    rng = random.Random(6)
    item = sentence(rng, 30)
    altered = [*item[:9], item[9] + "x", *item[10:20]]
    df = leaks.leaks(spark.createDataFrame([(1, " ".join(altered), 1)], DOC), spark.createDataFrame([(5, " ".join(item), "de")], ITEM))
    rows = df.collect()
    assert len(rows) == 1 and rows[0].run_words == 10


def test_very_long_text_and_empty(spark):
    rng = random.Random(9)
    item = " ".join(sentence(rng, 20))
    other = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    text = " ".join([*other, item])
    items = [(k, item if k == 3 else " ".join(sentence(rng, 20))) for k in range(9)]
    df = leaks.leaks(spark.createDataFrame([(1, text, 0)], DOC), spark.createDataFrame([(*i, "") for i in items], ITEM))
    assert [(r.item_id, r.run_words, r.at_word) for r in df.where("run_words >= 12").collect()] == [(3, 20, 120_000)]
    assert leaks.leaks(spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)).count() == 0


def test_hashes_agree_with_equality():
    x = np.array([1, 2, 3, 1, 2, 3, 4], np.uint32)
    h = leaks.gram_hashes(x, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4 and len(leaks.gram_hashes(x[:2], 3)) == 0
    y = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint32)
    for q in (1, 5, 16):
        seen = {}
        for i, v in enumerate(leaks.gram_hashes(y, q).tolist()):
            assert seen.setdefault(tuple(y[i : i + q]), v) == v
        assert len(set(seen.values())) == len(seen)
