"""Filling fixed-capacity containers with whole texts (problem 8).

Texts are sized in tokens of a public tokenizer. Only a text that alone exceeds the capacity is
split: its full pieces fill a container each and what remains is an item like any other. Items are
dealt at random to groups of bounded size, each group is packed first-fit decreasing and improved by
a swap-based local search, and the containers that stay underfull are dealt anew for further rounds,
so what one group cannot fill another can. No task holds more than a group.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.session import cut_lineage, spread

#: Where the vocabularies lie (see their README), and which one counts.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How that vocabulary cuts a text into pieces. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of a group on average; rounds of dealing; the fill from which a container is left alone.
GROUP_ITEMS, ROUNDS, FULL = 1500, 3, 0.985


def token_sizes(documents: DataFrame, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every text that is not null; an empty text has 0 tokens."""
    path = os.path.join(directory, vocabulary)

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": np.array([len(encoding.encode_ordinary(t)) for t in pdf["text"]], np.int64)})

    rows = spread(documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text"), "doc_id")
    return rows.mapInPandas(size, "doc_id long, tokens long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, largest items first, each into the first bin with room."""
    order = np.argsort(-sizes, kind="stable")
    room, bins = np.empty(len(sizes), np.int64), 0
    of = np.empty(len(sizes), np.int64)
    for i in order:
        s = sizes[i]
        fits = np.flatnonzero(room[:bins] >= s)
        if len(fits):
            b = fits[0]
        else:
            b, bins = bins, bins + 1
            room[b] = capacity
        of[i], room[b] = b, room[b] - s
    return of


def improve(sizes: np.ndarray, of: np.ndarray, capacity: int) -> np.ndarray:
    """Local search: from the emptiest bin items move to other bins, one for none, one for one or
    two for one, always the exchange that moves most; each raises the sum of squared fills. A bin
    that empties is gone; the search ends when what is left cannot hold another bin's items or no
    exchange is left from any bin."""
    of = of.copy()
    n = int(of.max()) + 1 if len(of) else 0
    fill = np.bincount(of, sizes, n).astype(np.int64)
    alive, tried = fill > 0, np.zeros(n, bool)
    zero = of[sizes == 0]
    alive[zero] = True
    while True:
        open_bins = np.flatnonzero(alive & ~tried)
        if not len(open_bins):
            break
        b = open_bins[np.argmin(fill[open_bins])]
        others = alive.copy()
        others[b] = False
        free = np.where(others, capacity - fill, 0)
        if free.sum() < fill[b]:  # not even in small parts would it fit elsewhere
            break
        before = fill[b]
        while fill[b] > 0:
            mine = np.flatnonzero(of == b)
            mine = mine[sizes[mine] > 0]
            own = sizes[mine]
            i, j = np.triu_indices(len(own), 1)
            offers = np.r_[own, own[i] + own[j]]
            offer_order = np.argsort(offers, kind="stable")
            sorted_offers = offers[offer_order]
            theirs = np.flatnonzero(others[of] & (free[of] > 0))
            bins = np.flatnonzero(others & (free > 0))
            gone = np.r_[sizes[theirs], np.zeros(len(bins), np.int64)]  # what would come back
            at = np.r_[of[theirs], bins]
            # only bins at least as full gain by taking more
            fuller = fill[at] >= fill[b]
            best = np.searchsorted(sorted_offers, gone + free[at], side="right") - 1
            gain = np.where((best >= 0) & fuller, sorted_offers[np.maximum(best, 0)] - gone, 0)
            k = int(np.argmax(gain)) if len(gain) else 0
            if not len(gain) or gain[k] <= 0:
                break
            offer = offer_order[best[k]]
            give = mine[[offer]] if offer < len(own) else mine[[i[offer - len(own)], j[offer - len(own)]]]
            a = at[k]
            of[give] = a
            if k < len(theirs):
                of[theirs[k]] = b
            fill[a] += gain[k]
            fill[b] -= gain[k]
            free[a] -= gain[k]
        if fill[b] == 0:
            alive[b] = False
            rest = np.flatnonzero((of == b) & (sizes == 0))
            live = np.flatnonzero(alive)
            if len(rest) and len(live):
                of[rest] = live[0]
            elif len(rest):
                alive[b] = True
                break
            tried[:] = False
        else:
            if fill[b] != before:  # what moved may let other bins move again
                tried[:] = False
            tried[b] = True
    return of


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; bins are numbered from 0 without gaps."""
    if not len(sizes):
        return np.empty(0, np.int64)
    of = improve(sizes, first_fit_decreasing(sizes, capacity), capacity)
    return np.unique(of, return_inverse=True)[1].astype(np.int64)


PACKED = "target_name string, capacity int, doc_id long, piece int, tokens long, container string, fill long"


def _packer(round_no: int):
    def pack_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
        sizes, capacity = pdf["tokens"].to_numpy(np.int64), int(pdf["capacity"].iloc[0])
        of = pack(sizes, capacity)
        fill = np.bincount(of, sizes).astype(np.int64)
        name = np.array([f"{key[0]}-{round_no}-{key[1]}-{b}" for b in range(len(fill))], object)
        return pdf[["target_name", "capacity", "doc_id", "piece", "tokens"]].assign(container=name[of], fill=fill[of])

    return pack_group


def fill_containers(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_name, capacity, doc_id, piece, tokens, container, fill): every text in its container.

    ``sizes`` is (doc_id, tokens), ``targets`` (target_name, capacity_tokens). A text within the
    capacity is piece 0 alone; a larger one has pieces 0, 1, ... of the capacity, each in a container
    of its own, and a last piece with the rest. Texts of 0 tokens share a container with others.
    Targets without a name or with a capacity below 1 give no rows, repeated targets count once.
    Every text has its container for each target; ``fill`` is the container's number of tokens.
    """
    known = (
        targets.where(F.col("target_name").isNotNull() & (F.col("capacity_tokens") > 0))
        .groupBy("target_name")
        .agg(F.min("capacity_tokens").cast("int").alias("capacity"))
    )
    rows = [tuple(r) for r in known.collect()]  # a handful of targets
    spark = sizes.sparkSession
    if not rows:
        return spark.createDataFrame([], PACKED)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("target_name"), F.lit(c).alias("capacity")) for n, c in rows])).alias("x")
    each = sizes.select("doc_id", "tokens", pairs).select("doc_id", "tokens", "x.*")
    whole = F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("int")
    each = each.withColumn("whole", whole)
    full = (
        each.where("whole > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
        .select(
            "target_name", "capacity", "doc_id", "piece", F.col("capacity").cast("long").alias("tokens"),
            F.concat_ws("-", "target_name", F.lit("full"), "doc_id", "piece").alias("container"), F.col("capacity").cast("long").alias("fill"),
        )
    )
    rest = F.col("tokens") - F.col("whole").cast("long") * F.col("capacity")
    items = each.withColumn("rest", rest).where("rest > 0 or tokens = 0").select(
        "target_name", "capacity", "doc_id", F.col("whole").alias("piece"), F.col("rest").alias("tokens")
    )
    items = cut_lineage(items, "pack-items")
    done = full
    for k in range(ROUNDS):
        per = dict(items.groupBy("target_name").count().collect())  # one row per target
        groups = F.create_map(*[F.lit(x) for n, c in per.items() for x in (n, max(1, round(c / GROUP_ITEMS)))]) if per else None
        if groups is None:
            break
        dealt = items.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", F.lit(k)), groups[F.col("target_name")]))
        packed = cut_lineage(dealt.groupBy("target_name", "group").applyInPandas(_packer(k), PACKED), "packed")
        if k == ROUNDS - 1 or all(c <= GROUP_ITEMS for c in per.values()):
            done = done.unionByName(packed)
            break
        kept = F.col("fill") >= FULL * F.col("capacity")
        done = done.unionByName(packed.where(kept))
        items = packed.where(~kept).select("target_name", "capacity", "doc_id", "piece", "tokens")
    return done


def fill_report(packed: DataFrame) -> DataFrame:
    """(target_name, containers, tokens, mean_fill, least_containers): how well each target is filled."""
    bins = packed.groupBy("target_name", "capacity", "container").agg(F.sum("tokens").alias("tokens"))
    return bins.groupBy("target_name", "capacity").agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / (F.count("*") * F.first("capacity"))).alias("mean_fill"),
        F.ceil(F.sum("tokens") / F.first("capacity")).alias("least_containers"),
    )
