"""Quantities recorded in different units (problem 4).

Conversions are edges of a small graph, each an affine function. The shortest composition from
every unit to its quantity's common unit is worked out once, every cycle is checked to return to
where it began, and the values meet their function through an equi-join on the source unit and the
common unit. Where no unit is stated, a recording's unit is the one whose speeds and distances fit
each other and the ride's summary best; that needs one aggregate row per recording only.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (quantity, from unit, to unit, factor, offset): to = from * factor + offset. Exact definitions.
CONVERSIONS = [
    ("speed", "km/h", "m/s", 1 / 3.6, 0.0),
    ("speed", "mph", "km/h", 1.609344, 0.0),
    ("speed", "mph", "m/s", 0.44704, 0.0),
    ("distance", "km", "m", 1000.0, 0.0),
    ("distance", "mi", "km", 1.609344, 0.0),
    ("distance", "mi", "m", 1609.344, 0.0),
    ("position_lat", "semicircles", "degrees", 180.0 / 2**31, 0.0),
    ("position_lat", "dms", "degrees", 1.0, 0.0),
    ("left_right_balance", "percent_x100", "percent", 0.01, 0.0),
    ("left_right_balance", "percent_x1000", "percent_x100", 0.1, 0.0),
    ("left_right_balance", "offset128", "percent", 1.0, -128.0),
]

CANONICAL = {"speed": "m/s", "distance": "m", "position_lat": "degrees", "left_right_balance": "percent"}


class InconsistentUnits(ValueError):
    """Two ways through the graph of conversions give different functions."""


def compose(conversions=CONVERSIONS, canonical=CANONICAL, tolerance: float = 1e-9):
    """[(quantity, source_unit, target_unit, factor, offset, hops)]: shortest way to the common unit.

    Every edge is checked against the shortest ways of its two ends; a disagreement raises
    ``InconsistentUnits``. A unit from which the common unit cannot be reached raises ``ValueError``.
    """
    near: dict[tuple[str, str], list[tuple[str, float, float]]] = {}
    for quantity, a, b, k, c in conversions:
        if not k or not math.isfinite(k) or not math.isfinite(c):
            raise ValueError(f"{a} to {b} of {quantity} has no inverse")
        near.setdefault((quantity, b), []).append((a, k, c))
        near.setdefault((quantity, a), []).append((b, 1 / k, -c / k))
    out = []
    for quantity, goal in canonical.items():
        best = {goal: (1.0, 0.0, 0)}
        queue = deque([goal])
        while queue:
            unit = queue.popleft()
            k0, c0, hops = best[unit]
            # an edge (a, k, c) at `unit` reads: unit = a * k + c
            for a, k, c in near.get((quantity, unit), []):
                if a not in best:
                    best[a] = (k0 * k, k0 * c + c0, hops + 1)
                    queue.append(a)
                ka, ca, _ = best[a]
                if abs(k0 * k - ka) > tolerance * max(1.0, abs(ka)) or abs(k0 * c + c0 - ca) > tolerance * max(1.0, abs(ca)):
                    raise InconsistentUnits(f"{quantity}: a cycle through {a} and {unit} does not close")
        named = {u for q, a, b, _, _ in conversions if q == quantity for u in (a, b)}
        if lost := named - best.keys():
            raise ValueError(f"{quantity}: no way from {sorted(lost)} to {goal}")
        out += [(quantity, unit, goal, k, c, hops) for unit, (k, c, hops) in sorted(best.items())]
    return out


def conversion_table(spark: SparkSession) -> DataFrame:
    """The composed functions as a table; its size is that of the graph, not of any data."""
    schema = "quantity string, source_unit string, target_unit string, factor double, shift double, hops int"
    return spark.createDataFrame(compose(), schema)


def to_canonical(df: DataFrame, *, quantity: str, unit: str, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``value`` in the common unit of its quantity (both named by columns).

    An unknown or null unit or quantity and a null value give null. The table of functions has a
    fixed number of rows (the pairs of units known), so it is broadcast.
    """
    table = conversion_table(df.sparkSession).select(
        F.col("quantity").alias("__q"), F.col("source_unit").alias("__u"), F.col("factor").alias("__k"), F.col("shift").alias("__c")
    )
    joined = df.join(F.broadcast(table), (F.col(quantity) == F.col("__q")) & (F.col(unit) == F.col("__u")), "left")
    return joined.withColumn(out, F.col(value) * F.col("__k") + F.col("__c")).drop("__q", "__u", "__k", "__c")


# --- units that are nowhere stated ---------------------------------------------------------------

#: Spread (natural log) of a part's pace against its ride's, of its speeds against its own
#: distances, and of any ride's pace against the usual one, and that pace in m/s.
PACE_SPREAD, OWN_SPREAD, USUAL_SPREAD, USUAL_MPS = 0.15, 0.04, 0.4, 7.0


def _log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def ride_pace(sessions: DataFrame, activities: DataFrame) -> DataFrame:
    """(activity_id, pace): metres a second of each ride from its summaries, sessions first."""
    a = sessions.where(F.col("activity_id").isNotNull()).select(
        "activity_id", F.try_divide(F.col("total_distance"), F.col("total_timer_time")).alias("p"), F.lit(0).alias("rank")
    )
    b = activities.where(F.col("id").isNotNull()).select(
        F.col("id").alias("activity_id"), F.try_divide(F.col("distance"), F.col("moving_time")).alias("p"), F.lit(1).alias("rank")
    )
    p = F.when((F.col("p") > 0.3) & (F.col("p") < 40), F.col("p"))
    return (
        a.unionByName(b)
        .groupBy("activity_id")
        .agg(F.coalesce(F.avg(F.when(F.col("rank") == 0, p)), F.avg(F.when(F.col("rank") == 1, p))).alias("pace"))
    )


def recording_units(records: DataFrame, pace: DataFrame) -> DataFrame:
    """(activity_id, field_name, unit_name): the unit of each field of each recording.

    Candidates are all pairs of a speed and a distance unit; the pair with the least sum of squared
    log deviations wins: speeds against the ride's pace, distances per second against it, and speeds
    against the recording's own distances per second. Without a summary the usual pace of a ride
    stands in, with a wider spread. A latitude beyond 90 can only be semicircles. Fields null
    throughout give no row; ties go to the common unit; null recordings give none.
    """
    seconds = F.unix_micros("timestamp") / 1e6
    num = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    per = (
        records.where(F.col("activity_id").isNotNull())
        .groupBy("activity_id")
        .agg(
            F.avg(num("speed")).alias("v"),
            F.min(F.when(num("distance").isNotNull(), F.struct(seconds.alias("t"), num("distance").alias("d")))).alias("d0"),
            F.max(F.when(num("distance").isNotNull(), F.struct(seconds.alias("t"), num("distance").alias("d")))).alias("d1"),
            F.max(F.abs(num("position_lat"))).alias("lat"),
        )
        .join(pace, "activity_id", "left")
    )
    lv = _log(F.col("v"))
    ld = _log(F.try_divide(F.col("d1.d") - F.col("d0.d"), F.col("d1.t") - F.col("d0.t")))
    lp = F.coalesce(_log(F.col("pace")), F.lit(math.log(USUAL_MPS)))
    spread = F.when(F.col("pace") > 0, F.lit(PACE_SPREAD)).otherwise(F.lit(USUAL_SPREAD))
    factors = {(q, u): k for q, u, _, k, _, _ in compose()}
    square = lambda x, s: F.coalesce(F.pow(x / s, 2), F.lit(0.0))
    pairs = []
    for i, su in enumerate(["m/s", "km/h", "mph"]):
        for j, du in enumerate(["m", "km", "mi"]):
            a, b = lv + F.lit(math.log(factors["speed", su])), ld + F.lit(math.log(factors["distance", du]))
            cost = square(a - lp, spread) + square(b - lp, spread) + square(a - b, OWN_SPREAD)
            pairs.append(F.struct(cost.alias("cost"), F.lit(3 * i + j).alias("n"), F.lit(su).alias("su"), F.lit(du).alias("du")))
    best = per.withColumn("best", F.array_min(F.array(*pairs)))
    units = F.array(
        F.struct(F.lit("speed").alias("f"), F.when(F.col("v").isNotNull(), F.col("best.su")).alias("u")),
        F.struct(F.lit("distance").alias("f"), F.when(F.col("d0").isNotNull(), F.col("best.du")).alias("u")),
        F.struct(
            F.lit("position_lat").alias("f"),
            F.when(F.col("lat") > 90, "semicircles").when(F.col("lat").isNotNull(), "degrees").alias("u"),
        ),
    )
    return (
        best.select("activity_id", F.explode(units).alias("x"))
        .where("x.u is not null")
        .select("activity_id", F.col("x.f").alias("field_name"), F.col("x.u").alias("unit_name"))
    )


def balance_unit(value: Column) -> Column:
    """The scale of a left share: percent, percent plus 128, or percent times 100 or 1000."""
    x = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return (
        F.when(x.isNull(), F.lit(None))
        .when(x <= 100, "percent")
        .when((x >= 128) & (x <= 228), "offset128")
        .when(x <= 10_000, "percent_x100")
        .otherwise("percent_x1000")
    )


# --- units in text -------------------------------------------------------------------------------

#: Spellings of units once blanks and case are gone. Fixed values.
SPELLINGS = {
    "m/s": ["m/s", "mps", "ms", "m/sec"],
    "km/h": ["km/h", "kph", "kmh", "kmph"],
    "mph": ["mph", "mi/h", "mileperhour", "milesperhour"],
    "m": ["m", "metre", "metres", "meter", "meters"],
    "km": ["km", "kms", "kilometre", "kilometres", "kilometer", "kilometers"],
    "mi": ["mi", "mile", "miles", "mile(s)"],
    "degrees": ["°", "deg", "degrees", "n", "s", "°n", "°s"],
    "semicircles": ["semicircles", "semicircle", "sc"],
}

DMS = r"^\s*(-?\d+)\s*°\s*(\d+)\s*['′]\s*(\d+(?:[.,]\d+)?)\s*(?:\"|″|'')?\s*([NSns]?)\s*$"
QUANTITY = r"^\s*([+-]?\d+(?:[.,]\d+)?)\s*(\D*?)\s*$"


def text_quantity(text: Column) -> Column:
    """struct(number, unit) of a quantity in text; unit null where none is written, both null
    where the text is no quantity. A comma is a decimal comma; S makes a latitude negative."""
    token = F.lower(F.regexp_replace(F.regexp_extract(text, QUANTITY, 2), r"\s", ""))
    unit = F.lit(None).cast("string")
    for name, spelt in SPELLINGS.items():
        unit = F.when(token.isin(spelt), F.lit(name)).otherwise(unit)
    number = F.regexp_replace(F.regexp_extract(text, QUANTITY, 1), ",", ".").try_cast("double")
    number = F.when(token.isin("s", "°s"), -number).otherwise(number)
    part = lambda g: F.regexp_replace(F.regexp_extract(text, DMS, g), ",", ".").try_cast("double")
    south = F.lower(F.regexp_extract(text, DMS, 4)) == "s"
    size = F.abs(part(1)) + part(2) / 60 + part(3) / 3600
    dms = F.when(south | F.regexp_extract(text, DMS, 1).startswith("-"), -size).otherwise(size)
    is_dms = text.rlike(DMS)
    return F.when(is_dms, F.struct(dms.alias("number"), F.lit("dms").alias("unit"))).otherwise(
        F.struct(number.alias("number"), unit.alias("unit"))
    )


def text_units(raw: DataFrame, pace: DataFrame) -> DataFrame:
    """(raw_id, activity_id, field_name, number, unit_name) of every non-null text quantity.

    A value without unit text takes the unit that other values of its recording and field state
    (the most frequent; ties go to the lesser name); where none does, latitudes beyond 90 are
    semicircles, others degrees, and speeds and distances take the unit nearest the ride's pace or,
    for distances, metres when written without decimals and kilometres otherwise. Text that is no
    quantity keeps a null number.
    """
    fields = ["speed", "distance", "position_lat"]
    long = raw.select(
        "raw_id",
        "activity_id",
        F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("t")) for f in fields])).alias("x"),
    ).where("x.t is not null")
    long = long.withColumn("q", text_quantity(F.col("x.t"))).select(
        "raw_id", "activity_id", F.col("x.f").alias("field_name"), F.col("q.number").alias("number"), F.col("q.unit").alias("said"),
        F.col("x.t").rlike("[.,]").alias("decimals"),
    )
    votes = long.groupBy("activity_id", "field_name", "said").agg(
        F.count("*").alias("n"), F.sum("number").alias("total"), F.max(F.abs("number")).alias("top"), F.max("decimals").alias("decimals")
    )
    per = votes.groupBy("activity_id", "field_name").agg(
        F.min(F.when(F.col("said").isNotNull(), F.struct((-F.col("n")).alias("n"), "said"))).alias("won"),
        (F.sum("total") / F.sum("n")).alias("mean"),
        F.max("top").alias("top"),
        F.max("decimals").alias("decimals"),
    )
    per = per.join(pace, "activity_id", "left")
    ratio = F.ln(F.try_divide(F.greatest(F.col("mean"), F.lit(0.01)), F.coalesce(F.col("pace"), F.lit(USUAL_MPS))))
    by_pace = F.when(ratio < math.log(1.5), "m/s").when(ratio < math.log(2.84), "mph").otherwise("km/h")
    guess = (
        F.when(F.col("field_name") == "speed", by_pace)
        .when(F.col("field_name") == "distance", F.when(F.col("decimals"), "km").otherwise("m"))
        .when(F.col("top") > 90, "semicircles")
        .otherwise("degrees")
    )
    # a null recording would not meet itself in a join
    key = F.coalesce(F.col("activity_id"), F.lit(""))
    per = per.select(key.alias("__key"), F.col("field_name").alias("__field"), F.coalesce(F.col("won.said"), guess).alias("of_recording"))
    own = F.when((F.col("field_name") == "position_lat") & (F.abs("number") > 90) & F.col("said").isNull(), "semicircles")
    joined = long.join(per, (key == F.col("__key")) & (F.col("field_name") == F.col("__field")), "left")
    return joined.select(
        "raw_id", "activity_id", "field_name", "number",
        F.coalesce(F.col("said"), own, F.col("of_recording")).alias("unit_name"),
    )
