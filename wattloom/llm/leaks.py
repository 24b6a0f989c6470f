"""Evaluation texts leaking into training text (problem 9).

Texts are reduced to lower-case words without accents, punctuation and markup, joined by one blank.
Of every run of WINDOW character q-grams of a test item the rarest is an anchor; WINDOW is such that
a passage with at most EDITS edits holds an unaltered run of that length, so none escapes. Documents
are searched for anchors; around those that lie in such a run, shared q-grams are counted in
overlapping bands of diagonals. By the q-gram lemma a passage of n characters with at most e edits
shares at least n - q + 1 - e * q of them in one band; regions that reach that bound are verified by
a banded local alignment, many at a time.

Items whose text fits ITEM_CHARS are sent to the tasks, and documents never move. Beyond that the
anchors are a table: documents are scanned once with a filter of bounded size, what passes is joined
with the table, and only documents with a hit meet their items. Both ways give the same rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm import bloom
from wattloom.session import cut_lineage, spread

#: Words in a row that make a leak; q of the q-grams; edits that a region may hold.
LEAST_WORDS, Q, EDITS = 12, 16, 1
#: Characters of items that may be sent to every task (about 60 MB there), and characters of
#: documents that are looked up at once.
ITEM_CHARS, CHARS_AT_ONCE = 8_000_000, 400_000
#: Diagonals of a band: bands lie around the diagonals of hits, and edits move a passage by at most EDITS.
WIDTH = 2 * EDITS + 1
#: Characters on either side of a region in which its words are read.
REACH = 64
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

TAG = re.compile(r"<(?:[/?]?[A-Za-z]|!)[^<>]*>")
MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
NO_WORD = re.compile(r"[^\w\s]+|_+")


def words(text: str) -> list[str]:
    """The words of a text: tags dropped, accents, case, punctuation and line marks removed."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
    return NO_WORD.sub("", text.casefold()).split()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q codes (wrapping products), one per start, by doubling the runs."""
    if len(x) < q:
        return np.empty(0, np.uint64)
    part, size, factor = x.astype(np.uint64) + np.uint64(1), 1, MULTIPLIER
    out, done = np.empty(0, np.uint64), 0
    with np.errstate(over="ignore"):
        while True:
            if q & size:
                out = out[: len(part) - done] * factor + part[done:] if done else part
                done += size
            if done == q:
                return out ^ (out >> np.uint64(29))
            part, size, factor = part[:-size] * factor + part[size:], 2 * size, factor * factor


def least_passage(w: list[str]) -> int:
    """Characters of the shortest run of LEAST_WORDS words; 0 where there is none."""
    sizes = np.cumsum([0] + [len(x) + 1 for x in w])
    return int((sizes[LEAST_WORDS:] - sizes[:-LEAST_WORDS]).min()) - 1 if len(w) >= LEAST_WORDS else 0


def window_of(least: int) -> int:
    """Grams in a row that any passage of ``least`` characters with EDITS edits holds unaltered."""
    return max(1, -(-(least - Q + 1 - EDITS * Q) // (EDITS + 1)))


def anchors(h: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Places of the rarest gram of every run of ``window`` grams (ties by hash, then the last)."""
    if not len(h):
        return np.empty(0, np.int64)
    order = np.lexsort((-np.arange(len(h)), h, counts))
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    runs = np.lib.stride_tricks.sliding_window_view(rank, min(window, len(h)))
    return np.unique(order[runs.min(axis=1)])


class Items:
    """Test items: words, codes, grams end to end, least passages."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.words = [words(t) for _, t in rows]
        self.codes = [codes(" ".join(w)) for w in self.words]
        self.least = np.array([least_passage(w) for w in self.words], np.int64)
        self.window = np.array([window_of(x) for x in self.least.tolist()], np.int64)
        grams = [gram_hashes(c, Q) if n else gram_hashes(c[:0], Q) for c, n in zip(self.codes, self.least.tolist(), strict=True)]
        self.size = np.array([len(g) for g in grams], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.grams = np.concatenate(grams) if grams else np.empty(0, np.uint64)


class Anchors:
    """The anchors of items, sorted by hash, behind a filter."""

    def __init__(self, items: Items):
        keys, back, n = np.unique(items.grams, return_inverse=True, return_counts=True)
        counts = n[back]
        ends = items.first + items.size
        at = [anchors(items.grams[a:b], counts[a:b], w) for a, b, w in zip(items.first, ends, items.window, strict=True)]
        of = np.repeat(np.arange(len(at)), [len(x) for x in at])
        at = np.concatenate(at) if at else np.empty(0, np.int64)
        h = items.grams[items.first[of] + at]
        order = np.argsort(h, kind="stable")
        self.of, self.at = of[order], at[order]
        self.keys, self.begin, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.filter = bloom.of_keys(self.keys)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, place in the item) of every anchor among the hashes."""
        place = np.flatnonzero(bloom.passes(self.filter, h)) if len(self.keys) else np.empty(0, np.int64)
        slot = np.searchsorted(self.keys, h[place]) % max(len(self.keys), 1)
        same = self.keys[slot] == h[place] if len(place) else np.empty(0, bool)
        place, slot = place[same], slot[same]
        n = self.count[slot]
        entry = np.repeat(self.begin[slot] + n - np.cumsum(n), n) + np.arange(n.sum())
        return np.repeat(place, n), self.of[entry], self.at[entry]


class Texts:
    """Cleaned documents end to end with their grams."""

    def __init__(self, chars: list[np.ndarray]):
        glue = np.zeros(Q, np.uint32)
        size = np.array([len(c) for c in chars], np.int64)
        self.chars = chars
        self.first = np.cumsum(size + Q) - size - Q
        self.size = np.maximum(size - Q + 1, 0)
        self.grams = gram_hashes(np.concatenate([p for c in chars for p in (c, glue)]) if chars else glue, Q)


def in_runs(items: Items, texts: Texts, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which hits lie in a run of equal grams on their diagonal that is as long as the item's window."""
    run = np.zeros(len(at), np.int64)
    for step in (1, -1):
        alive, k = np.arange(len(at)), 0 if step == 1 else -1
        while len(alive):
            a = at[alive] + k
            d = a + diagonal[alive]
            inside = (a >= 0) & (a < items.size[item[alive]]) & (d >= 0) & (d < texts.size[text[alive]])
            alive, a, d = alive[inside], a[inside], d[inside]
            same = items.grams[items.first[item[alive]] + a] == texts.grams[texts.first[text[alive]] + d]
            alive = alive[same]
            run[alive] += 1
            alive = alive[run[alive] < items.window[item[alive]]]
            k += step
    return run >= items.window[item]


def regions(items: Items, texts: Texts, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (text, item, band's first diagonal, first and last position in the item) of the regions
    around hits that reach the bound of the q-gram lemma, one for each passage."""
    kept = in_runs(items, texts, text, item, diagonal, at)
    if not kept.any():
        return np.empty((0, 5), np.int64)
    text, item, low, at = text[kept], item[kept], diagonal[kept] - EDITS, at[kept]
    order = np.lexsort((at, low, item, text))
    t, i, b, a = text[order], item[order], low[order], at[order]
    near = items.least[i]  # hits further apart than a passage belong to bands of their own
    new = np.r_[True, (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1]) | (a[1:] - a[:-1] > near[1:])]
    edge = np.flatnonzero(new)
    last = np.r_[edge[1:], len(t)] - 1
    bands = np.column_stack((t[edge], i[edge], b[edge], a[edge], a[last]))
    t, i, low = bands[:, 0], bands[:, 1], bands[:, 2]
    span = items.least[i] - Q + 1  # grams of the shortest passage
    lo = np.maximum(0, bands[:, 3] - span)
    hi = np.minimum(items.size[i], bands[:, 4] + span + 1)
    n = hi - lo
    begin = np.cumsum(n) - n
    of = np.repeat(np.arange(len(bands)), n)
    a = np.arange(n.sum()) - np.repeat(begin - lo, n)
    own = items.grams[items.first[i[of]] + a]
    shared = np.zeros(len(a), bool)
    place, ends = a + low[of], texts.size[t][of]
    base = texts.first[t][of]
    for _ in range(WIDTH):
        inside = (place >= 0) & (place < ends)
        shared |= (texts.grams[np.where(inside, base + place, 0)] == own) & inside
        place += 1
    # shared grams of every stretch as long as the shortest passage
    total = np.r_[0, np.cumsum(shared)]
    j = np.arange(len(a))
    end = np.minimum(j + span[of], np.repeat(begin + n, n))
    enough = np.maximum(1, span - EDITS * Q)[of]
    good = np.flatnonzero(total[end] - total[j] >= enough)
    if not len(good):
        return np.empty((0, 5), np.int64)
    which = of[good]
    first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    final = np.r_[first[1:], len(good)] - 1
    b = which[first]
    counted = total[end[good[final]]] - total[good[first]]
    found = np.column_stack((t[b], i[b], low[b], a[good[first]], a[good[final]] + span[b] - 1 + Q - 1, counted))
    return _ones(found)


def _ones(found: np.ndarray) -> np.ndarray:
    """Of regions in overlapping bands that hold the same passage, the one that shares most."""
    order = np.lexsort((found[:, 2], -found[:, 5], found[:, 1], found[:, 0]))
    kept: list[np.ndarray] = []
    for r in found[order]:
        twin = False
        for k in reversed(kept):
            if k[0] != r[0] or k[1] != r[1]:
                break
            twin = twin or (abs(k[2] - r[2]) < WIDTH and k[3] <= r[4] and r[3] <= k[4] and min(k[4], r[4]) - max(k[3], r[3]) >= r[4] - r[3] - 2 * EDITS)
        if not twin:
            kept.append(r)
    return np.array(kept)[:, :5]


def banded_scores(items: Items, texts: Texts, rows: np.ndarray) -> np.ndarray:
    """Best local alignment of each region within its band of diagonals: a match counts 1, an edit
    costs 2. Regions of similar length are aligned together."""
    scores = np.zeros(len(rows), np.int32)
    span = rows[:, 4] - rows[:, 3] + 1
    order = np.argsort(span, kind="stable")
    for part in np.array_split(order, max(1, len(order) // 2000)):
        if not len(part):
            continue
        long = int(span[part].max()) + 2 * LEAST_WORDS
        lo = np.maximum(0, rows[part, 3] - LEAST_WORDS)
        item = np.zeros((long, len(part)), np.uint32)
        text = np.full((long + WIDTH, len(part)), 0xFFFFFFFF, np.uint32)
        for i, r in enumerate(part):
            t, k, low = rows[r, 0], rows[r, 1], rows[r, 2]
            piece = items.codes[k][lo[i] : lo[i] + span[r] + 2 * LEAST_WORDS]  # its own reach, whatever its company
            item[: len(piece), i] = piece
            a = lo[i] + low
            piece = texts.chars[t][max(0, a) : max(0, a + long + WIDTH)]
            text[max(0, -a) : max(0, -a) + len(piece), i] = piece
        row = np.zeros((WIDTH + 1, len(part)), np.int32)  # the last stays 0
        best = np.zeros(len(part), np.int32)
        for j in range(long):
            here = row[:WIDTH] + np.where(item[j] == text[j : j + WIDTH], np.int32(1), np.int32(-2))
            np.maximum(here, row[1:] - 2, out=here)  # a character of the item more
            np.maximum(here, 0, out=here)
            for d in range(1, WIDTH):  # a character of the text more
                np.maximum(here[d], here[d - 1] - 2, out=here[d])
            row[:WIDTH] = here
            np.maximum(best, here.max(axis=0), out=best)
        scores[part] = best
    return scores


def longest_run(a: list[str], b: list[str]) -> tuple[int, int]:
    """(words, position in a) of the longest run of words that both hold."""
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    best, end, last = 0, 0, {}
    for i, w in enumerate(a):
        now = {}
        for j in places.get(w, ()):
            now[j] = last.get(j - 1, 0) + 1
            if now[j] > best:
                best, end = now[j], i + 1
        last = now
    return best, end - best


SCHEMA = "doc_id long, item_id long, run_words int, at_word int, score int"
COLUMNS = ["doc_id", "item_id", "run_words", "at_word", "score"]


def verified(items: Items, texts: Texts, read: list[list[str]], ids: list[int], hits: tuple[np.ndarray, ...]) -> pd.DataFrame:
    """SCHEMA rows of the pairs whose regions verify."""
    rows = regions(items, texts, *hits)
    scores = banded_scores(items, texts, rows) if len(rows) else np.empty(0, np.int32)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    starts: dict[int, np.ndarray] = {}
    for (t, k, low, first, last), s in zip(rows.tolist(), scores.tolist(), strict=True):
        if s < items.least[k] - 3 * EDITS:  # an edit takes a match and costs 2
            continue
        if t not in starts:
            starts[t] = np.cumsum([0] + [len(w) + 1 for w in read[t]])
        a, b = np.searchsorted(starts[t], (low + first - REACH, low + last + REACH))
        run, at = longest_run(read[t][max(0, a - 1) : b], items.words[k])
        old = best.get((t, k), (0, 0, 0))
        longer = (run, -(at + max(0, a - 1))) > (old[0], -old[1])
        best[t, k] = (run, int(at + max(0, a - 1)), max(s, old[2])) if longer else (*old[:2], max(s, old[2]))
    return pd.DataFrame([(ids[t], int(items.ids[k]), *x) for (t, k), x in best.items()], columns=COLUMNS)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[list[str]], Texts, list]]:
    """(ids, words, texts, rest) of about CHARS_AT_ONCE characters of documents each."""
    ids, read, chars, rest, size = [], [], [], [], 0
    for pdf in batches:
        for i, text, more in zip(pdf["doc_id"], pdf["text"], pdf["hits"] if "hits" in pdf else [None] * len(pdf), strict=True):
            w = words(text)
            if len(w) < LEAST_WORDS:
                continue
            c = codes(" ".join(w))
            ids.append(i)
            read.append(w)
            chars.append(c)
            rest.append(more)
            size += len(c)
            if size >= CHARS_AT_ONCE:
                yield ids, read, Texts(chars), rest
                ids, read, chars, rest, size = [], [], [], [], 0
    if ids:
        yield ids, read, Texts(chars), rest


def _in_texts(texts: Texts, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = np.searchsorted(texts.first, place, side="right") - 1
    return text, place - texts.first[text]


def _search(items: Items, index: Anchors):
    """Documents against items that every task holds."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, read, texts, _ in _parts(batches):
            place, item, at = index.hits(texts.grams)
            text, x = _in_texts(texts, place)
            yield verified(items, texts, read, ids, (text, item, x - at, at))

    return walk


def _item_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k, text in zip(pdf["item"], pdf["text"], strict=True):
            x = Items([(0, text)])
            yield pd.DataFrame({"item": k, "at": np.arange(len(x.grams)), "h": x.grams.view(np.int64), "window": int(x.window[0])})


def _anchors_of(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("at")
    at = anchors(pdf["h"].to_numpy(np.int64).view(np.uint64), pdf["n"].to_numpy(), int(pdf["window"].iloc[0]))
    return pdf.iloc[at][["item", "at", "h"]]


def _emit(filter_words: np.ndarray):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, _, texts, _ in _parts(batches):
            place = np.flatnonzero(bloom.passes(filter_words, texts.grams))
            text, x = _in_texts(texts, place)
            yield pd.DataFrame({"doc_id": np.array(ids, np.int64)[text], "h": texts.grams[place].view(np.int64), "x": x})

    return walk


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with the items they hit: hits are (item_id, item's text, place in the text, place in the item)."""
    for ids, read, texts, rest in _parts(batches):
        known: dict[tuple[int, str], int] = {}
        hits = [
            (t, known.setdefault((h["item_id"], h["item_text"]), len(known)), x - a, a)
            for t, of in enumerate(rest) for h in of for x, a in zip(h["x"], h["at"], strict=True)
        ]
        yield verified(Items(list(known)), texts, read, ids, tuple(np.array(hits, np.int64).reshape(-1, 4).T))


def _by_table(documents: DataFrame, known: DataFrame) -> DataFrame:
    """The search with the anchors as a table; one scan of the documents with a filter, and the documents
    that hit once more."""
    known = cut_lineage(known.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text"), "items")
    grams = cut_lineage(known.mapInPandas(_item_grams, "item long, at long, h long, window long"), "item-grams")
    counted = grams.join(grams.groupBy("h").agg(F.count("*").alias("n")), "h")
    index = cut_lineage(counted.groupBy("item").applyInPandas(_anchors_of, "item long, at long, h long"), "anchors")
    bits = bloom.of_column(index.select("h"), "h", index.count())
    passed = documents.mapInPandas(_emit(bits), "doc_id long, h long, x long")
    pairs = passed.join(index, "h").groupBy("doc_id", "item").agg(F.collect_list("x").alias("x"), F.collect_list("at").alias("at"))
    texts = known.select("item", "item_id", F.col("text").alias("item_text"))
    hits = pairs.join(texts, "item").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item_text", "x", "at")).alias("hits"))
    return documents.join(hits, "doc_id").select("doc_id", "text", "hits").mapInPandas(_verify, SCHEMA)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, run_words, at_word, score) of every document and item with a passage of the
    item of at least LEAST_WORDS words and at most EDITS edits.

    ``run_words`` is the longest run of words that both hold unaltered, ``at_word`` its place in the
    document, ``score`` that of the best alignment. Null texts and ids, and texts and items of fewer
    words, give nothing; repeated documents each come out, repeated items once; whole texts are
    searched whatever their length.
    """
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    known = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    size = known.agg(F.sum(F.length("text"))).first()[0]
    if size is not None and size > ITEM_CHARS:
        return _by_table(rows, known)
    held = Items(sorted(tuple(r) for r in known.collect()))  # at most ITEM_CHARS characters
    return spread(rows, "doc_id").mapInPandas(_search(held, Anchors(held)), SCHEMA)
