"""Text cut off by field limits and broken transfers (problem 10).

A backward character n-gram model: the context is the last characters of a text, of several lengths,
with digits, names, hashtags and addresses folded. Over all documents it is counted how often each
context that ends some text stands at an end and how often text goes on after it. A cut falls
anywhere, so contexts of cut texts are spread like contexts in mid-text; what ends beyond that share
is where writers end. The log-odds of a cut weigh the two, with a prior per source and length group
that is estimated from the data, since a field limit shows in the longest texts of its source.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm import bloom
from wattloom.session import cut_lineage, spread

#: Lengths of the contexts, in folded characters.
ORDERS = (2, 4, 6, 9, 14)
#: Lengths of the contexts that keep names as written, for texts that end within or after a name.
PLAIN_ORDERS = (2, 4, 6)
#: Strength of the shorter context in the longer one, rounds of estimating the shares of cut texts,
#: texts that a group's share leans on, and the share to begin with.
LEAN, ROUNDS, GROUP_LEAN, FIRST_SHARE = 20.0, 4, 10.0, 0.1
#: Expected cuts in a context from which one more end may be chance.
CHANCE_FROM = 0.01
#: One text in so many makes an ending common.
HOT_SHARE = 1000
#: Log-odds of a text whose end carries the sign of a loss itself.
CERTAIN = 20.0
CHARS_AT_ONCE = 400_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

DIGITS = re.compile(r"\d+")
NAME = re.compile(r"[A-ZÀ-Þ](?<=[^\W\d_] .)[\w’']*")
#: Marks of omission, blanks and the sign of a broken character at the end say nothing themselves.
BROKEN = re.compile(r"�\s*$|[.!?]\s*(?:…|\.\.\.)[\s�]*$")


SAYS_NOTHING = "".join(chr(i) for i in range(0x3001) if chr(i).isspace()) + "\ufffd…"


def strip_tail(text: str) -> str:
    """The text without marks of omission, blanks and broken characters at its end."""
    while True:
        text = text.rstrip(SAYS_NOTHING)
        if not text.endswith("..."):
            return text
        text = text[:-3]


def fold(text: str) -> str:
    """Folded text: addresses, hashtags and numbers become one sign each, a capitalised word after
    a word becomes one sign (a name)."""
    if "http" in text:
        text = re.sub(r"https?://(\S*)", lambda m: "\x01" + re.sub(r"\w", "u", m.group(1))[-4:], text)
    if "#" in text:
        text = re.sub(r"#\w+", "\x03", text)
    return NAME.sub("\x04", DIGITS.sub("0", text))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def context_hashes(x: np.ndarray, orders: tuple[int, ...], wanted: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, (places, hashes) of the contexts at the ``wanted`` places that pass the filter. A
    context that ends some text has shorter ones that do, so a place that fails is not looked at again.
    The two sets of orders give different hashes."""
    reach = max(orders)
    padded = np.concatenate((np.zeros(reach, np.uint64), x + np.uint64(1)))  # 0 before the beginning
    at, h, dense = wanted, np.full(len(x), len(orders), np.uint64), True
    for k in range(reach):
        # the character k places back; all places in a row as long as many are left
        h = h * MULTIPLIER + (padded[reach - k : len(padded) - k] if dense else padded[at + (reach - k)])
        if k + 1 in orders:
            v = _mixed(h[at] if dense else h, k)
            kept = bloom.passes(words, v)
            at, h = at[kept], h if dense else h[kept]
            yield at, v[kept]
            if dense and 2 * len(at) < len(x):
                h, dense = h[at], False


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    y = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
    return y ^ (y >> np.uint64(27))


ENDS = "doc_id long, lang string, source string, n_chars long, copy long, sure boolean, name boolean, stop boolean, h array<long>"


def end_hashes(views: list[str], orders: tuple[int, ...]) -> np.ndarray:
    """The hashes of ``context_hashes`` at the last position of each text, one column per order."""
    reach = max(orders)
    pad = "\x02" * reach
    # the last characters suffice: the longest context spans no more
    x = _codes("".join((pad + v)[-reach:] for v in views)).reshape(len(views), reach)
    out, h = [], np.full(len(views), len(orders), np.uint64)
    for k in range(reach):
        h = h * MULTIPLIER + (x[:, reach - 1 - k] + np.uint64(1))
        if k + 1 in orders:
            out.append(_mixed(h, k))
    return np.column_stack(out).astype(np.int64)


def _digest(text: str) -> int:
    """What copies of a text share: they count as one end."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [strip_tail(t) for t in pdf["text"]]
        folded = [fold(t) for t in texts]
        plain = [DIGITS.sub("0", t) for t in texts]
        hashes = np.hstack([end_hashes(folded, ORDERS), end_hashes(plain, PLAIN_ORDERS)])
        yield pd.DataFrame(
            {c: pdf[c] for c in ("doc_id", "lang", "source", "n_chars")}
            | {"copy": [_digest(t) for t in texts], "sure": [bool(BROKEN.search(t)) for t in pdf["text"]], "name": [f.endswith("\x04") for f in folded], "stop": [t.endswith((".", "!", "?")) for t in texts], "h": list(hashes)}
        )


#: The key under which the numbers of blanks and of sentence ends before them are summed.
PLACES = 0


def _inside(words: np.ndarray):
    """(h, spaced, joined) of the contexts in mid-text that pass the filter: how often a blank follows
    and how often not, summed within each piece of a batch; under PLACES the blanks and sentence ends."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pad = np.full(max(ORDERS), 2, np.uint64)

        def flush(texts: list[str], orders: tuple[int, ...]) -> Iterator[pd.DataFrame]:
            pieces = [p for t in texts if len(t) for p in (pad, _codes(t))]
            if not pieces:
                return
            x = np.concatenate(pieces)
            inner = x != 2
            inner[np.cumsum([len(p) for p in pieces])[1::2] - 1] = False  # the ends themselves
            blank = np.r_[(x[1:] == 32) | (x[1:] == 10), False]
            for at, v in context_hashes(x, orders, np.flatnonzero(inner), words):
                for name, where in (("spaced", blank[at]), ("joined", ~blank[at])):
                    keys, n = np.unique(v[where], return_counts=True)
                    yield pd.DataFrame({"h": keys.view(np.int64), "spaced": np.zeros(len(n), np.int64), "joined": np.zeros(len(n), np.int64)} | {name: n})

        def pieces(texts: list[str]) -> Iterator[pd.DataFrame]:
            blanks = sum(t.count(" ") + t.count("\n") for t in texts)
            stops = sum(t.count(a + b) for t in texts for a in ".!?" for b in " \n")
            yield pd.DataFrame({"h": [PLACES], "spaced": [blanks], "joined": [stops]})
            texts = [strip_tail(t) for t in texts]
            plain = [DIGITS.sub("0", t) for t in texts]
            yield from flush([fold(t) if "#" in t or "http" in t else NAME.sub("\x04", p) for t, p in zip(texts, plain, strict=True)], ORDERS)
            yield from flush(plain, PLAIN_ORDERS)

        texts, size = [], 0
        for pdf in batches:
            for text in pdf["text"]:
                texts.append(text)
                size += len(text)
                if size >= CHARS_AT_ONCE:
                    yield from pieces(texts)
                    texts, size = [], 0
        yield from pieces(texts)

    return walk


def _odds(spaced: Column, joined: Column, start: float) -> Column:
    """Log-odds of a cut against an end, without the group's prior: hazards of a cut and of an end
    after the context. A cut has one hazard (``spaced``) at ends of words, where ends of sentences are
    apart, and another (``joined``) elsewhere; the end's is taken from what ends beyond the cuts' share, shorter contexts leaning on
    longer ones."""

    def step(acc: Column, c: Column) -> Column:
        ends = c["ends"] - 1  # without the text itself
        goes_on = c["spaced"] + c["joined"]
        due = spaced * c["spaced"] + joined * c["joined"]
        chance = F.when(due > CHANCE_FROM, 1.0).otherwise(0.0)  # one more may be chance
        more = F.greatest(ends - due - 2 * F.sqrt(due) - chance, F.lit(0.0))
        times = goes_on + ends
        # a context seen nearly as often as the shorter one is the same evidence, not more of it
        base = F.when(times * 2 > acc["times"], acc["base"]).otherwise(acc["h"])
        cut = F.when(goes_on > 0, due / goes_on).otherwise(acc["cut"])
        return F.struct(base.alias("base"), ((more + LEAN * base) / (times + LEAN)).alias("h"), times.alias("times"), cut.alias("cut"))

    first = F.struct(F.lit(start).alias("base"), F.lit(start).alias("h"), F.lit(1e18).alias("times"), joined.alias("cut"))
    chain = lambda a, n: F.aggregate(F.slice(F.col("counts"), a, n), first, step, lambda x: F.ln(x["cut"]) - F.ln(x["h"]))
    folded, plain = chain(1, len(ORDERS)), chain(len(ORDERS) + 1, len(PLAIN_ORDERS))
    return F.when(F.col("sure"), F.lit(CERTAIN)).when(F.col("name"), F.greatest(folded, plain)).otherwise(folded)


def cut_scores(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_chars, log_odds) of every text: above 0 the text is taken as cut.

    Null texts are left out; empty and blank texts have no context and get the log-odds of their
    group. Languages are compared by their first two letters, null ones form their own. Repeated rows
    of one doc_id are judged one by one. Whole texts are counted, whatever their length.
    """
    lang = F.coalesce(F.lower(F.substring(F.trim("lang"), 1, 2)), F.lit("?"))
    texts = documents.where(F.col("text").isNotNull()).select(
        "doc_id", "text", lang.alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.length("text").cast("long").alias("n_chars")
    )
    texts = spread(texts, "doc_id")
    ends = cut_lineage(texts.mapInPandas(_ends, ENDS), "text-ends")
    # contexts with names as written weigh only where a text ends in a name; others need no counts inside
    each = ends.select("copy", "name", "h").distinct().select(F.posexplode("h").alias("order", "h"), "name")
    weighs = F.bool_or(F.col("name") | (F.col("order") < len(ORDERS))).alias("weighs")
    at_end = cut_lineage(each.groupBy("h").agg(F.count("*").alias("ends"), weighs), "contexts")
    sought = at_end.where("weighs")
    words = bloom.of_column(sought, "h", sought.count())
    inside = texts.select("text").mapInPandas(_inside(words), "h long, spaced long, joined long")
    inside = cut_lineage(inside.groupBy("h").agg(F.sum("spaced").alias("spaced"), F.sum("joined").alias("joined")), "mid-text")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
    model = at_end.join(inside, "h", "left").select("h", number("ends"), number("spaced"), number("joined"))
    tops = ends.groupBy("source").agg(F.max("n_chars").alias("top"))
    keyed = ends.withColumn("row", F.monotonically_increasing_id())
    keyed = cut_lineage(keyed, "text-rows")
    # each text has eight contexts, so at most 8 * HOT_SHARE of them end one text in HOT_SHARE or more: these are
    # sent to the tasks, and no crowd of texts with a common ending meets in one
    common = F.col("ends") * HOT_SHARE >= ends.count()
    placed = keyed.select("row", F.posexplode("h").alias("order", "h"))
    hot = placed.join(F.broadcast(model.where(common)), "h", "left")
    counted = hot.where("ends is not null").unionByName(hot.where("ends is null").select("row", "order", "h").join(model.where(~common), "h"))
    counts = (
        counted.groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("order", "spaced", "joined", "ends"))).alias("counts"))
    )  # one list of fixed length per text
    group = F.col("n_chars") >= 0.93 * F.col("top")
    # at which kind of place the text ends, by its longest context that is not rare
    seen = F.try_element_at(F.filter(F.slice("counts", 1, len(ORDERS)), lambda c: c["spaced"] + c["joined"] >= 5), F.lit(-1))
    at_word = F.coalesce(seen["spaced"] * 2 >= seen["spaced"] + seen["joined"], F.lit(False))
    rows = keyed.drop("h", "copy").join(counts, "row").join(tops, "source")
    judged = cut_lineage(
        rows.select("doc_id", "lang", "source", "n_chars", "sure", "name", "stop", group.alias("long"), at_word.alias("at_word"), "counts"), "text-counts"
    )
    n, places = judged.agg(F.count("*"), F.sum("n_chars")).first()
    if not n:
        return judged.select("doc_id", "lang", "source", "n_chars", F.lit(0.0).alias("log_odds"))
    blanks, stops = inside.where(F.col("h") == PLACES).select("spaced", "joined").first()
    # ends of words, ends of sentences, other places; and the share of texts that are cut at each
    at = [max(float(x or 0), 1.0) for x in (blanks - stops, stops, places - blanks)]
    shares = [FIRST_SHARE / 2, FIRST_SHARE / 100, FIRST_SHARE / 2]
    groups = None
    logit = lambda p: F.ln(p / (1 - p))

    def scored(shares: list[float], groups: DataFrame | None) -> DataFrame:
        every = sum(shares)
        word, sentence, other = (x * n / y for x, y in zip(shares, at, strict=True))
        odds = _odds(F.when(F.col("stop"), F.lit(sentence)).otherwise(F.lit(word)), F.lit(other), (1 - every) * n / max(float(places), 1.0))
        if groups is None:
            return judged.withColumn("log_odds", odds)
        prior = logit(F.col("share")) - F.lit(float(np.log(every / (1 - every))))
        return judged.join(groups, ["source", "lang", "long"]).withColumn("log_odds", odds + prior)

    for _ in range(ROUNDS):
        cut = 1 / (1 + F.exp(-F.col("log_odds")))
        kind = F.when(~F.col("at_word"), 2).when(F.col("stop"), 1).otherwise(0)
        parts = scored(shares, groups).groupBy("source", "lang", "long").agg(
            *[F.sum(F.when(kind == k, cut).otherwise(0.0)).alias(f"cut_{k}") for k in range(3)], F.count("*").alias("n")
        )
        sums = cut_lineage(parts.withColumn("cut", F.col("cut_0") + F.col("cut_1") + F.col("cut_2")), "cut-shares")
        whole = sums.agg(*[F.sum(f"cut_{k}") / F.sum("n") for k in range(3)]).first()
        shares = [min(0.3, max(1e-6, float(x))) for x in whole]
        own = F.sum("cut").over(_by("source", "long")) / F.sum("n").over(_by("source", "long"))
        leaned = (F.col("cut") + GROUP_LEAN * own) / (F.col("n") + GROUP_LEAN)
        groups = sums.select("source", "lang", "long", F.least(F.greatest(leaned, F.lit(1e-4)), F.lit(0.999)).alias("share"))
    return scored(shares, groups).select("doc_id", "lang", "source", "n_chars", "log_odds")


def _by(*columns: str):
    return Window.partitionBy(*columns)


def rates(scores: DataFrame) -> DataFrame:
    """(source, texts, cut, rate): how often each source cuts."""
    return scores.groupBy("source").agg(
        F.count("*").alias("texts"), F.count_if(F.col("log_odds") > 0).alias("cut"), F.avg((F.col("log_odds") > 0).cast("double")).alias("rate")
    )
