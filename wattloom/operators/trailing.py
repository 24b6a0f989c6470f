"""Rolling totals over trailing periods (problem 6).

Rides are first summed by rider and day, so that what reaches one task for one rider is bounded by
the calendar, however many rides there are. Days are then sorted within partitions, and a queue of
two stacks per period keeps the aggregate of the active window: every day is pushed and popped
once, no inverse is needed, so totals and maxima go the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class MonoidQueue:
    """A first-in first-out queue that knows the combination of all it holds.

    ``combine`` must be associative; it need not be invertible or commutative.
    """

    def __init__(self, combine: Callable, unit):
        self.combine, self.unit = combine, unit
        self.front: list = []  # (value, combination of it and all younger ones of this stack)
        self.back: list = []
        self.back_sum = unit

    def push(self, value) -> None:
        self.back.append(value)
        self.back_sum = self.combine(self.back_sum, value)

    def pop(self) -> None:
        if not self.front:
            total = self.unit
            while self.back:
                total = self.combine(self.back.pop(), total)
                self.front.append(total)
            self.back_sum = self.unit
        self.front.pop()

    def total(self):
        return self.combine(self.front[-1] if self.front else self.unit, self.back_sum)

    def __len__(self) -> int:
        return len(self.front) + len(self.back)


def _join(a: tuple, b: tuple) -> tuple:
    """(load, time, rides, longest ride): sums, and a maximum that has no inverse."""
    return a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] if a[3] >= b[3] else b[3]


def day_totals(rides: DataFrame) -> DataFrame:
    """(athlete_id, day, load, seconds, rides, longest) of rides(athlete_id, day, load, seconds).

    A null load or time counts 0; rides without a rider or a day belong to no series."""
    zero = F.lit(0).cast("long")
    return (
        rides.where(F.col("athlete_id").isNotNull() & F.col("day").isNotNull())
        .groupBy("athlete_id", "day")
        .agg(
            F.sum(F.coalesce(F.col("load").cast("long"), zero)).alias("load"),
            F.sum(F.coalesce(F.col("seconds").cast("long"), zero)).alias("seconds"),
            F.count("*").alias("rides"),
            F.max(F.coalesce(F.col("seconds").cast("long"), zero)).alias("longest"),
        )
    )


def trailing_totals(rides: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One row per rider and calendar day from first to last ride, rest days included.

    For each period of w days ending with the day (cut at the first day): total and mean per day of
    load and time, rides, and the longest ride: load_w, mean_load_w, seconds_w, mean_seconds_w,
    rides_w, longest_w. Input and nulls as in ``day_totals``; an empty table gives no rows.
    """
    days = day_totals(rides).select("athlete_id", F.unix_date("day").alias("n"), "load", "seconds", "rides", "longest")
    schema = "athlete_id string, n int, " + ", ".join(
        f"load_{w} long, mean_load_{w} double, seconds_{w} long, mean_seconds_{w} double, rides_{w} long, longest_{w} long"
        for w in periods
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rider, last, queues, out = None, 0, {}, []
        nothing = (0, 0, 0, 0)

        def step(n: int, value: tuple) -> None:
            row = [rider, n]
            for w, queue in queues.items():
                queue.push(value)
                if len(queue) > w:
                    queue.pop()
                load, seconds, count, longest = queue.total()
                row += [load, load / len(queue), seconds, seconds / len(queue), count, longest]
            out.append(row)

        for pdf in batches:
            columns = [pdf[c].to_numpy() for c in ("athlete_id", "n", "load", "seconds", "rides", "longest")]
            for who, n, *value in zip(*columns, strict=True):
                if who != rider:
                    rider, queues = who, {w: MonoidQueue(_join, nothing) for w in periods}
                else:
                    for rest in range(last + 1, n):
                        step(rest, nothing)
                        if len(out) >= 20_000:
                            yield pd.DataFrame(out, columns=names)
                            out.clear()
                step(int(n), tuple(map(int, value)))
                last = int(n)
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out.clear()
        if out:
            yield pd.DataFrame(out, columns=names)

    walked = days.repartition("athlete_id").sortWithinPartitions("athlete_id", "n").mapInPandas(walk, schema)
    return walked.select("athlete_id", F.date_from_unix_date("n").alias("day"), *names[2:])


def peaks_and_rests(daily: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(athlete_id, day, measure): days at the rider's highest trailing load (none if it is 0), and
    days whose trailing time is 0."""
    rider = Window.partitionBy("athlete_id")  # days of one rider, bounded by the calendar; the walk runs once
    topped = daily.withColumns({f"top_{w}": F.max(f"load_{w}").over(rider) for w in periods})
    marks = [F.when((F.col(f"load_{w}") == F.col(f"top_{w}")) & (F.col(f"top_{w}") != 0), F.lit(f"peak_load_{w}")) for w in periods]
    marks += [F.when(F.col(f"seconds_{w}") == 0, F.lit(f"idle_{w}")) for w in periods]
    return topped.select("athlete_id", "day", F.explode(F.array_compact(F.array(*marks))).alias("measure"))
