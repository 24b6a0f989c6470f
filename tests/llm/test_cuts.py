import random

import numpy as np
import pandas as pd

from wattloom.llm import bloom, cuts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, h string"
SUBJECTS = ["the group from {}", "coach {}", "the file of {}", "load at {}", "the road to {}"]
VERBS = ["averaged {} km on the way", "asked for {} laps of the lake", "raised {} warnings in the log", "stayed quiet for {} minutes"]


def text(rng, n):
    names = lambda: rng.choice("BDGKLMNRSTVZ") + "".join(rng.choice(["ar", "el", "on", "ul", "im"]) for _ in range(3))
    s = [f"{rng.choice(SUBJECTS).format(names())} {rng.choice(VERBS).format(rng.randrange(9, 900))}." for _ in range(n)]
    s = " ".join(x[0].upper() + x[1:] for x in s)
    return s + rng.choice(["", "", "", "\nBack home by dusk", f"\nTotal: {rng.randrange(99)}.{rng.randrange(9)} km", " #ride #week12", "\nTo be continued..."])


def corpus(seed=2, n=1500):
    rng = random.Random(seed)
    rows, truth = [], set()
    for d in range(n):
        t, source = text(rng, rng.randrange(1, 8)), rng.choice(["limited", "free", "free2"])
        if source == "limited" and len(t) > 200:
            t = t[:200]
        elif source == "free" and rng.random() < 0.06:
            t = t[: rng.randrange(20, len(t))] + rng.choice(["", "", "…", "..."])
        else:
            t = t + ""
        rows.append((d, t, rng.choice(["en", "EN ", None]), source, len(t), 1, "x"))
        bare = cuts.strip_tail(t)
        whole = bare.endswith((".", "dusk", " km", "#week12", "continued")) and not t.rstrip().endswith("…")
        if not whole:
            truth.add(d)
    return rows, truth


def test_cuts_are_found(spark):
    rows, truth = corpus()
    scores = cuts.cut_scores(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id for r in scores.where("log_odds > 0").collect()}
    hit = len(got & truth)
    assert hit / len(truth) > 0.93 and hit / len(got) > 0.93
    rates = {r.source: r.rate for r in cuts.rates(scores).collect()}
    assert rates["limited"] > 0.3 and rates["free2"] < 0.05


def test_folding_and_tails():
    assert cuts.strip_tail("abc... \n") == "abc" and cuts.strip_tail("abc…") == "abc" and cuts.strip_tail("ab�") == "ab" and cuts.strip_tail("a. ") == "a."
    assert cuts.fold("near Quaropass 123") == "near \x04 0" and cuts.fold("see #abc9") == "see \x03"
    assert cuts.BROKEN.search("go. …") and cuts.BROKEN.search("go�") and not cuts.BROKEN.search("To be continued...")


def test_hashes_depend_on_the_context_only():
    every = np.full(1 << 10, 2**64 - 1, np.uint64)  # a filter that passes all
    both = [list(cuts.context_hashes(x := cuts._codes(t), cuts.ORDERS, np.arange(len(x)), every)) for t in ("x" * 20 + "the end", "y" * 30 + "the end")]
    a, b = ([h for _, h in v] for v in both)
    ends = cuts.end_hashes(["x" * 20 + "the end", "", "d"], cuts.ORDERS).astype("uint64")
    assert ends[0].tolist() == [int(v[-1]) for v in a] and len(set(ends[:, 0].tolist())) == 3
    assert a[0][-1] == b[0][-1] and a[2][-1] == b[2][-1] and a[-1][-1] != b[-1][-1]


def test_counts_of_contexts_match_brute_force():
    """Every context that ends a text is counted at all its places, whatever the filter lets pass."""
    rng = random.Random(4)
    texts = [text(rng, 3) for _ in range(40)]
    folded = [cuts.fold(cuts.strip_tail(t)) for t in texts]
    ends = cuts.end_hashes(folded, cuts.ORDERS)
    keys = np.unique(ends.astype("uint64"))
    got = pd.concat(cuts._inside(bloom.of_keys(keys))(iter([pd.DataFrame({"text": texts})]))).groupby("h").sum()
    for i, k in ((0, 2), (3, 4), (7, 6), (11, 14)):
        context = ("\x02" * k + folded[i])[-k:]
        spaced = joined = 0
        for t in folded:
            padded = "\x02" * 14 + t
            for e in range(15, len(padded)):
                if padded[:e].endswith(context):
                    spaced, joined = (spaced + 1, joined) if padded[e] in " \n" else (spaced, joined + 1)
        row = got.loc[ends[i, cuts.ORDERS.index(k)]] if ends[i, cuts.ORDERS.index(k)] in got.index else None
        assert (0, 0) == (spaced, joined) if row is None else (row.spaced, row.joined) == (spaced, joined)
    assert got.loc[cuts.PLACES].spaced == sum(t.count(" ") + t.count("\n") for t in texts)


def test_nulls_empty_and_long(spark):
    rows = [(1, None, None, None, 0, 1, "x"), (2, "", None, None, 0, 1, "x"), (3, " ", "en", "s", 1, 1, "x"), (4, "word " * 100_000, "en", "s", 500_000, 1, "x"), (4, "twice", "en", "s", 5, 1, "x"), (4, "twice", "en", "s", 5, 1, "x"), (None, "a b", "en", "s", 3, 1, "x")]
    got = cuts.cut_scores(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and all(r.log_odds is not None for r in got)
    assert cuts.cut_scores(spark.createDataFrame([], SCHEMA)).count() == 0
