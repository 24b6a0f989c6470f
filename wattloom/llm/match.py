"""Matching rides across two sources without keys (problem 3).

Every attribute of a ride becomes a fixed bit vector: numbers as overlapping grams of a grid, so
that near numbers share bits, names as hashed character bigrams. Close pairs come from multi-index
hashing: the start and one size of a ride (distance, elapsed or moving time) are read on SUBSTRINGS
shifted grids, and the Gray codes of their cells are the substrings of one long code. Each step that
two rides are apart crosses the boundary of one grid and so changes one bit of one substring; rides
within RADIUS = SUBSTRINGS - 1 bits agree in a substring, and an equi-join on substrings finds them
all. Candidates are verified by their Hamming distance, scored by field-weighted Dice of the vectors,
and the scores become confidences by a logistic curve through scores of true and displaced clocks.
Each ride keeps its mutual best.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.session import cut_lineage

#: Substrings of the code (a power of two), the Hamming radius that they find exactly, and the steps of start and sizes:
#: rides within 300 s and four steps of a size (0.6 % of distance, 1.2 % of time) are at most 7 bits apart.
SUBSTRINGS = 8
RADIUS = SUBSTRINGS - 1
START_STEP = 100.0
SIZE_STEPS = {"log_distance": 0.0015, "log_elapsed": 0.003, "log_time": 0.003}
#: Errors of a device's clock that are tried, in seconds.
CLOCKS = (0, -3600, 3600)
#: A clock so far off matches only by chance; one ride in DECOY_SHARE shows the scores that chance gives.
DISPLACED, DECOY_SHARE = 2 * 86400, 4

#: field: (weight, grid step, grams on either side).
NUMBERS = {
    "start": (3.0, 40.0, 6),
    "log_distance": (3.0, 0.001, 8),
    "log_time": (2.0, 0.0015, 8),
    "log_elapsed": (2.0, 0.002, 8),
    "heart_rate": (2.0, 1.0, 3),
    "power": (2.0, 1.0, 3),
    "climb": (0.5, 0.05, 4),
}
NAME_WEIGHT, CLOCK_FACTOR = 0.5, 0.9
BINS = 50


def _bit(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))


def _or(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))


def number_bits(x: Column, step: float, reach: int) -> Column:
    """64 bits of the grid's grams around a number: consecutive grid points take consecutive bits,
    so near numbers share most of them. Null stays null."""
    at = F.round(x / step).cast("long")
    shift = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at + F.lit(k), F.lit(64)).cast("int"))
    bits = shift(-reach)
    for k in range(-reach + 1, reach + 1):
        bits = bits.bitwiseOR(shift(k))
    return bits


def name_bits(name: Column) -> Column:
    """64 bits of the character bigrams of a name without case; null and blank give null."""
    text = F.concat(F.lit(" "), F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: _bit(F.substring(text, i, F.lit(2))))
    return F.when(F.length(F.trim(name)) > 0, _or(grams))


def encode(rides: DataFrame) -> DataFrame:
    """rides(key, start_s, distance, moving_time, elapsed, heart_rate, power, climb, name) with their
    bit vectors b_*; unknown (null, NaN, not above 0) numbers give null vectors."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.col(c) > 0), F.col(c).cast("double"))
    parts = {
        "start": F.col("start_s").cast("double"), "log_distance": F.ln(known("distance")), "log_time": F.ln(known("moving_time")),
        "log_elapsed": F.ln(known("elapsed")), "heart_rate": known("heart_rate"), "power": known("power"), "climb": F.ln(known("climb")),
    }
    out = rides.select("key", "name", *[c.alias(f) for f, c in parts.items()])
    return out.select(
        "key", *parts, *[number_bits(F.col(f), NUMBERS[f][1], NUMBERS[f][2]).alias(f"b_{f}") for f in parts], name_bits(F.col("name")).alias("b_name")
    )


def one_of_copies(encoded: DataFrame) -> DataFrame:
    """Of rides that are alike in every encoded field, the one of the least key: all others would
    lose every tie to it, so no pair of copies needs to be formed."""
    rest = [c for c in encoded.columns if c != "key"]
    return encoded.groupBy(*rest).agg(F.min("key").alias("key"))


def _gray(x: Column) -> Column:
    return x.bitwiseXOR(F.call_function("shiftright", x, F.lit(1)))


def _substring(start: Column, size: Column, j: Column | int) -> Column:
    """Substring j of the code of a ride at so many steps of start and size: the Gray codes of the two
    cells on grid j, side by side."""
    j = j if isinstance(j, Column) else F.lit(j)
    cell = lambda q: _gray(F.call_function("shiftright", q + j, F.lit(SUBSTRINGS.bit_length() - 1)))
    return F.call_function("shiftleft", cell(start), F.lit(24)).bitwiseXOR(cell(size).bitwiseAND(F.lit((1 << 24) - 1).cast("long")))


def _indexed(df: DataFrame, p: str, *keys: str) -> DataFrame:
    """One row per ride, known size and substring, narrow: (keys, steps, kind, j, code), names after ``p``."""
    at = lambda c, step: F.floor(F.col(c) / step).cast("long")
    kinds = [
        F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("kind"), at(c, step).alias("size"))) for k, (c, step) in enumerate(SIZE_STEPS.items())
    ]
    rows = df.where("start is not null").select(*keys, at("start", START_STEP).alias("at"), F.explode(F.array_compact(F.array(*kinds))).alias("x"))
    rows = rows.select(*keys, "at", "x.kind", "x.size", F.explode(F.sequence(F.lit(0), F.lit(SUBSTRINGS - 1))).alias("j"))
    rows = rows.withColumn("code", _substring(F.col("at"), F.col("size"), F.col("j")))
    return rows.select(*[F.col(c).alias(p + c) for c in rows.columns])


def close_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_key, r_key, r_clock): distinct pairs of encoded rides within RADIUS bits for one of the sizes
    that both know. No pair within it is missed."""
    a, b = _indexed(left, "l_", "key"), _indexed(right, "r_", "key", "clock")
    on = (F.col("l_code") == F.col("r_code")) & (F.col("l_j") == F.col("r_j")) & (F.col("l_kind") == F.col("r_kind"))
    both = [(_substring(F.col("l_at"), F.col("l_size"), j), _substring(F.col("r_at"), F.col("r_size"), j)) for j in range(SUBSTRINGS)]
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in both), F.lit(0))
    first = F.lit(None).cast("int")  # a pair counts at the first substring in which it agrees
    for j, (x, y) in reversed(list(enumerate(both))):
        first = F.when(x == y, F.lit(j)).otherwise(first)
    return a.join(b, on).where((apart <= RADIUS) & (first == F.col("l_j"))).select("l_key", "r_key", "r_clock").distinct()


def dice(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``score``: the weighted mean of the fields' Dice coefficients, over fields known
    on both sides; a clock error that had to be assumed lowers the start's part."""
    total, weights = F.lit(0.0), F.lit(0.0)
    for field, weight in [*((f, w) for f, (w, _, _) in NUMBERS.items()), ("name", NAME_WEIGHT)]:
        a, b = F.col(f"l_b_{field}"), F.col(f"r_b_{field}")
        d = 2.0 * F.bit_count(a.bitwiseAND(b)) / (F.bit_count(a) + F.bit_count(b))
        if field == "start":
            d = d * F.when(F.col("r_clock").isin(0, DISPLACED), 1.0).otherwise(CLOCK_FACTOR)
        both = a.isNotNull() & b.isNotNull()
        total = total + F.when(both, d * weight).otherwise(0.0)
        weights = weights + F.when(both, F.lit(weight)).otherwise(0.0)
    return pairs.withColumn("score", F.try_divide(total, weights))


def calibrate(bins: list[tuple[int, int, int]]) -> tuple[float, float]:
    """(a, b) of confidence = 1 / (1 + exp(-(a + b * score))), by Newton steps over the bins
    (bin, positives, negatives); a weak prior keeps a curve that rises where the bins are few."""
    a, b = -12.0, 20.0
    data = [((i + 0.5) / BINS, p, n) for i, p, n in bins]
    for _ in range(50):
        ga, gb = -(a + 12.0) * 0.01, -(b - 20.0) * 0.01
        haa, hab, hbb = 0.01, 0.0, 0.01
        for x, p, n in data:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            ga += p - (p + n) * q
            gb += x * (p - (p + n) * q)
            w = (p + n) * q * (1 - q)
            haa, hab, hbb = haa + w, hab + w * x, hbb + w * x * x
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(abs(da), abs(db), 1e-9)
        da, db = da * min(1, 10 / size), db * min(1, 10 / size)
        a, b = a + da, b + db
        if size < 1e-6:
            break
    return a, max(b, 1.0)


def match_rides(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """(l_key, r_key, score, confidence): each ride's mutual best with confidence of ``least`` or more.

    ``left`` and ``right`` as for ``encode``, one row per key; ``right``'s clock may be an hour off.
    Rides without a start match nothing, nor do pairs that share neither distance nor either time. Ties go
    to the smaller clock error, then to the lesser key. Every candidate pair is scored. The confidence is
    the share of rides whose best score is no chance, as told by rides with a displaced clock.
    """
    a = cut_lineage(one_of_copies(encode(left)), "rides-left")  # read by the index and by the scores
    decoy = F.pmod(F.xxhash64("key"), F.lit(DECOY_SHARE)) == 0
    tried = F.array(*map(F.lit, CLOCKS))
    clocks = F.when(decoy, F.concat(tried, F.array(*[F.lit(DISPLACED + c) for c in CLOCKS]))).otherwise(tried)
    late = right.withColumn("clock", F.explode(clocks))
    shifted = late.withColumn("start_s", F.col("start_s") + F.col("clock")).withColumn("key", F.struct("key", "clock"))
    b = encode(shifted).withColumn("clock", F.col("key.clock")).withColumn("key", F.col("key.key"))
    b = cut_lineage(one_of_copies(b), "rides-right")
    named = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in df.columns if c.startswith("b_") or c in ("key", "clock")])
    pairs = close_pairs(a, b).join(named(a, "l_"), "l_key").join(named(b, "r_"), ["r_key", "r_clock"])
    scored = dice(pairs).where("score is not null").select("l_key", "r_key", "score", (F.col("r_clock") > DISPLACED // 2).alias("decoy"), F.col("r_clock").alias("clock"))
    error = -F.abs(F.when(F.col("decoy"), F.col("clock") - DISPLACED).otherwise(F.col("clock")))
    scored = scored.groupBy("l_key", "r_key", "decoy").agg(F.max(F.struct("score", error.alias("clock"))).alias("best"))
    order = lambda key, other: Window.partitionBy(key, "decoy").orderBy(F.desc("best"), other)
    ranked = cut_lineage(
        scored.withColumn("l_rank", F.row_number().over(order("l_key", "r_key"))).withColumn("r_rank", F.row_number().over(order("r_key", "l_key"))),
        "ride-pairs",
    )
    bins = (
        ranked.where("r_rank = 1")
        .groupBy(F.least(F.floor(F.col("best.score") * BINS), F.lit(BINS - 1)).alias("bin"))
        .agg(F.count_if(~F.col("decoy")).alias("all"), (DECOY_SHARE * F.count_if("decoy")).alias("chance"))
        .collect()  # at most BINS rows
    )
    x, y = calibrate([(int(r["bin"]), max(0, r["all"] - r["chance"]), min(r["all"], r["chance"])) for r in bins])
    confidence = 1 / (1 + F.exp(-(F.lit(x) + F.lit(y) * F.col("best.score"))))
    mutual = ranked.where("l_rank = 1 and r_rank = 1 and not decoy")
    return mutual.select("l_key", "r_key", F.col("best.score").alias("score"), confidence.alias("confidence")).where(F.col("confidence") >= least)
