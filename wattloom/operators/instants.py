"""Mixed timestamp formats and time zones to one UTC instant (problem 5).

Texts are read by shape with built-in expressions. What the text leaves open is estimated from the
data: the order of day and month of each exporting system, the zone of riders without one (the zone
whose history of offsets contradicts fewest of their known offsets and landing times), the epoch of
bare numbers, and which side of a clock change a repeated hour lies on (the order of the
recording). Rows that need no estimate never pass through a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions import timetext as T

#: Bare numbers from here on are milliseconds, and from the second on microseconds.
MILLIS_FROM, MICROS_FROM = 1e11, 1e14
#: Seconds below this (2008) are taken as counted from the device epoch where no ride start helps.
UNIX_FROM = 1_200_000_000
#: Changes of the clock that are looked for, in seconds.
CHANGES = (3600, 1800, 7200)
#: Zones that riders live in, the largest offset from UTC, and the delay up to which a landing speaks for a zone.
REGIONS = ("Africa", "America", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific")
MOST_OFFSET, PROMPT_S = 50400, 6 * 3600


def system_of(file_source: Column) -> Column:
    """The exporting system: what stands before the first ``_`` of a file name."""
    return F.coalesce(F.lower(F.regexp_extract(file_source, r"^([^_]*)", 1)), F.lit(""))


def day_first_by_system(df: DataFrame, system: Column, text: Column, landed: Column) -> DataFrame:
    """(system, day_first): the order in which each system writes day and month between slashes.

    A number above 12 decides; without one, the order that puts fewer starts after their landing;
    then a clock with AM and PM speaks for the month first. One row per system.
    """
    a, b = T.slash_parts(text, 1), T.slash_parts(text, 2)
    one = F.lit(1)
    rows = df.select(system.alias("system"), text.alias("t"), landed.alias("landed"), a.alias("a"), b.alias("b")).where("a is not null")
    late = lambda first: F.sum(
        F.when(F.unix_micros("landed") / 1e6 + 86400 < T.wall_seconds(T.read_time(F.col("t"), F.lit(first))["wall"]), one).otherwise(0)
    )
    votes = rows.groupBy("system").agg(
        F.count_if(F.col("a") > 12).alias("over_a"), F.count_if(F.col("b") > 12).alias("over_b"),
        late(True).alias("late_dm"), late(False).alias("late_md"), F.count_if(F.col("t").rlike("[AaPp]\\.?[Mm]\\.?\\s*$")).alias("halves"),
    )
    return votes.select(
        "system",
        F.when(F.col("over_a") != F.col("over_b"), F.col("over_a") > F.col("over_b"))
        .when(F.col("late_dm") != F.col("late_md"), F.col("late_dm") < F.col("late_md"))
        .otherwise(F.col("halves") == 0)
        .alias("day_first"),
    )


def number_seconds(x: Column, near: Column | None = None) -> Column:
    """Unix seconds of a bare number: micro-, milli- or whole seconds of the Unix epoch, or seconds
    of the device epoch; of the two the one nearer to ``near`` if given, else by size."""
    unit = F.when(F.abs(x) >= MICROS_FROM, 1e6).when(F.abs(x) >= MILLIS_FROM, 1e3).otherwise(1.0)
    device = lambda s: s + T.DEVICE_EPOCH
    by_size = lambda s: s < UNIX_FROM
    nearer = by_size if near is None else lambda s: F.coalesce(F.abs(device(s) - near) < F.abs(s - near), by_size(s))
    return T.let(x / unit, lambda s: F.floor(F.when(nearer(s) & (x == s), device(s)).otherwise(s)).cast("long"))


def _offsets(hours: DataFrame, offset: Callable[[Column, Column], Column]) -> DataFrame:
    """(hour, offset, zones): of each hour the zones by their offset. As many rows as there are distinct
    hours and offsets, whatever the number of riders."""
    names = [z for z in T.known_zones() if z.split("/")[0] in REGIONS]
    zone = F.explode(F.split(F.lit(",".join(names)), ",")).alias("zone")
    every = hours.select("hour", zone).select("hour", "zone", offset(F.col("hour") * 3600, F.col("zone")).alias("offset"))
    return every.groupBy("hour", "offset").agg(F.collect_list("zone").alias("zones"))


def riders_zones(activities: DataFrame, athletes: DataFrame) -> DataFrame:
    """(athlete_id, home): the zone of each rider: the one stated for them, else the estimate.

    The estimate takes, of all known zones, the one whose history of offsets makes the fewest
    violations: rows that have both the UTC and the wall-clock start and another offset between them,
    and rows with only the wall clock that would have started (or, where elapsed_time is known, ended)
    after they landed. Ties go to the zone stated more often by the rider, then to the one that brings
    the wall clocks nearest to their landing, then to the lesser name. Rows that landed more than PROMPT_S
    after the latest possible start say nothing. Only riders without a stated zone are looked at; those
    without any evidence get no row.
    """
    stated = (
        athletes.where(F.col("athlete_id").isNotNull())
        .groupBy("athlete_id")
        .agg(F.min(T.zone_name(F.col("timezone"))).alias("home"))
    )
    home = stated.where("home is not null")
    who = activities.select("athlete_id").where("athlete_id is not null").join(home, "athlete_id", "left_anti")
    if who.isEmpty():  # a look at one column spares the scans of the estimate
        return home
    took = F.col("elapsed_time").cast("double") if "elapsed_time" in activities.columns else F.lit(0.0)
    lost = activities.select(
        "athlete_id", "timezone", "start_date", "start_date_local", F.unix_micros("import_timestamp").alias("landed"),
        F.when(took > 0, took).otherwise(0.0).alias("took"),
    ).where("athlete_id is not null").join(home, "athlete_id", "left_anti")
    read = lost.select(
        "athlete_id", "took", (F.col("landed") / 1e6).alias("landed"), T.zone_name(F.col("timezone")).alias("zone"),
        T.read_time(F.col("start_date"), F.lit(False)).alias("u"), T.read_time(F.col("start_date_local"), F.lit(False)).alias("w"),
    )
    utc = F.coalesce(number_seconds(F.col("u.number")), T.wall_seconds(F.col("u.wall")) - F.coalesce(F.col("u.offset_s"), F.lit(0)))
    read = read.select("athlete_id", "zone", "took", "landed", utc.alias("utc_s"), T.wall_seconds(F.col("w.wall")).alias("wall_s"))
    hour = lambda c: F.floor(F.col(c) / 3600).alias("hour")

    known = (
        read.select("athlete_id", "utc_s", (F.round((F.col("wall_s") - F.col("utc_s")) / 900) * 900).cast("long").alias("offset"))
        .where(F.abs("offset") <= MOST_OFFSET)
        .groupBy("athlete_id", hour("utc_s"), "offset")
        .agg(F.count("*").alias("n"))
    )
    agree = known.join(_offsets(known.select("hour").distinct(), T.zone_offset), ["hour", "offset"]).select("athlete_id", F.explode("zones").alias("zone"), "n")
    # what agrees is taken off, so that zones which agree with nothing need no rows
    marks = agree.select("athlete_id", "zone", (-F.col("n")).alias("wrong"), F.lit(0.0).alias("delay"))

    least = F.col("wall_s") + F.col("took") - F.col("landed")  # a smaller offset puts the ride after its landing
    prompt = (
        read.where("utc_s is null").select("athlete_id", hour("wall_s"), least.alias("least"))
        .where(F.col("least").between(-MOST_OFFSET - PROMPT_S, MOST_OFFSET))
        .groupBy("athlete_id", "hour", (F.ceil(F.col("least") / 900) * 900).alias("least"))
        .agg(F.count("*").alias("n"))
    )
    local = _offsets(prompt.select("hour").distinct(), lambda wall, zone: wall - T.zoned_seconds(T.wall_of(wall), zone))
    weighed = prompt.join(local, "hour").select(
        "athlete_id", F.explode("zones").alias("zone"),
        F.when(F.col("offset") < F.col("least"), F.col("n")).otherwise(0).alias("wrong"), (F.col("n") * (F.col("offset") - F.col("least"))).cast("double").alias("delay"),
    )
    own = read.where("zone is not null").groupBy("athlete_id", "zone").agg(F.count("*").alias("stated"))
    sums = marks.unionByName(weighed).groupBy("athlete_id", "zone").agg(F.sum("wrong").alias("wrong"), F.sum("delay").alias("delay"))
    none = F.lit(0)
    best = (
        sums.join(own, ["athlete_id", "zone"], "full")
        .groupBy("athlete_id")
        .agg(F.min(F.struct(F.coalesce("wrong", none).alias("wrong"), (-F.coalesce("stated", none)).alias("s"), F.coalesce("delay", F.lit(0.0)).alias("delay"), "zone"))["zone"].alias("guess"))
    )
    return home.unionByName(best.select("athlete_id", F.col("guess").alias("home")))


def activity_instants(activities: DataFrame, athletes: DataFrame) -> DataFrame:
    """(row_id, id, athlete_id, zone, utc_s, wall): the start of every activity row.

    ``utc_s`` comes from ``start_date`` where it can be read (without a zone it is UTC), else from
    ``start_date_local`` with its own offset, else with the row's zone, else the rider's, else UTC.
    A trailing Z on ``start_date_local`` is no zone: that column is always the rider's wall clock.
    ``wall`` is the rider's wall clock. Null or unreadable texts give null instants; rows are kept.
    """
    orders = day_first_by_system(
        activities, system_of(F.col("file_source")), F.col("start_date_local"), F.col("import_timestamp")
    ).withColumnRenamed("system", "__sys")
    homes = riders_zones(activities, athletes).withColumnRenamed("athlete_id", "__rider")
    df = activities.select(
        "row_id", "id", "athlete_id", "start_date", "start_date_local", "timezone", "import_timestamp",
        system_of(F.col("file_source")).alias("__s"),
    )
    df = df.join(orders, F.col("__s") == F.col("__sys"), "left").join(homes, F.col("athlete_id") == F.col("__rider"), "left")
    first = F.coalesce(F.col("day_first"), F.lit(False))
    df = df.select(
        "row_id", "id", "athlete_id",
        F.coalesce(T.zone_name(F.col("timezone")), F.col("home"), F.lit("UTC")).alias("zone"),
        T.zone_name(F.col("timezone")).isNotNull().alias("zone_stated"),
        T.read_time(F.col("start_date"), first).alias("u"), T.read_time(F.col("start_date_local"), first).alias("w"),
        F.rtrim(F.col("start_date_local")).rlike("[Zz]$").alias("fake"),
    )
    near = T.wall_seconds(F.col("w.wall"))
    utc = F.coalesce(number_seconds(F.col("u.number"), near), T.wall_seconds(F.col("u.wall")) - F.coalesce(F.col("u.offset_s"), F.lit(0)))
    own = F.when(~F.col("fake"), F.col("w.offset_s"))
    local = F.coalesce(
        number_seconds(F.col("w.number")),
        T.wall_seconds(F.col("w.wall")) - own,
        T.zoned_seconds(F.col("w.wall"), F.col("zone")),
    )
    df = df.withColumn("utc_s", F.coalesce(utc, local))
    wall = F.coalesce(F.col("w.wall"), F.convert_timezone(F.lit("UTC"), F.col("zone"), T.wall_of(F.col("utc_s"))))
    return df.select("row_id", "id", "athlete_id", "zone", "zone_stated", "utc_s", wall.alias("wall"))


def reading_instants(raw: DataFrame, starts: DataFrame) -> DataFrame:
    """(raw_id, activity_id, utc_s) of every raw record.

    Text with an offset or Z holds; bare numbers take the epoch nearer to the ride's start; text
    without a zone is wall clock in the ride's zone, that is a zone stated by an activity row of
    that id (of several the first landed), else the rider's. A repeated wall-clock time is the
    earlier instant until, in order of record_no, the recording's clock has stepped back; from then
    on the later. Only the rows within a repeated hour pass through the window. Records without a
    known ride are read in UTC; unreadable text gives null; rows are kept.
    """
    rides = (
        starts.where(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("__ride"))
        .agg(
            F.min(F.when(F.col("zone_stated"), F.struct("row_id", "zone")))["zone"].alias("z1"),
            F.min(F.struct("row_id", "zone"))["zone"].alias("z2"),
            F.min("utc_s").alias("near"),
        )
    )
    df = raw.select("raw_id", "activity_id", "record_no", "timestamp").join(rides, F.col("activity_id") == F.col("__ride"), "left")
    halves = F.col("timestamp").rlike("[AaPp]\\.?[Mm]\\.?\\s*$")
    df = df.select(
        "raw_id", "activity_id", "record_no", F.coalesce("z1", "z2", F.lit("UTC")).alias("zone"), "near",
        T.read_time(F.col("timestamp"), ~halves).alias("r"),
    )
    fixed = F.coalesce(number_seconds(F.col("r.number"), F.col("near")), T.wall_seconds(F.col("r.wall")) - F.col("r.offset_s"))
    df = df.withColumn("fixed", fixed).withColumn("early", T.zoned_seconds(F.col("r.wall"), F.col("zone")))
    wall_s = T.wall_seconds(F.col("r.wall"))
    gained = F.lit(0)
    for change in reversed(CHANGES):
        again = F.col("early") + change
        gained = F.when(T.zone_offset(again, F.col("zone")) + again == wall_s, F.lit(change)).otherwise(gained)
    df = df.withColumn("gained", F.when(F.col("fixed").isNull() & F.col("early").isNotNull(), gained).otherwise(F.lit(0)))
    plain = df.where("gained = 0").select("raw_id", "activity_id", F.coalesce("fixed", "early").alias("utc_s"))
    by = Window.partitionBy("activity_id", "day").orderBy("record_no", "raw_id")
    twice = df.where("gained > 0").withColumn("day", F.floor(F.col("early") / 86400))
    back = F.coalesce(F.col("early") < F.lag("early").over(by), F.lit(False))
    twice = twice.withColumn("back", back.cast("int")).withColumn("after", F.max("back").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    later = twice.select("raw_id", "activity_id", (F.col("early") + F.when(F.col("after") == 1, F.col("gained")).otherwise(0)).alias("utc_s"))
    return plain.unionByName(later)
