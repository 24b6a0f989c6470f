"""Irregular readings onto a regular grid (problem 1).

Readings are first reduced to one row per source and grid period, which is the only shuffle of
the raw rows and combines on the map side. ``lead`` then pairs consecutive periods with a reading
inside bounded time blocks, so that a source holding a third of all rows is many window groups;
what lies between two blocks comes from the blocks' edges. Only missing periods are exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block of periods that one window group may hold.
BLOCK_PERIODS = 1024

KEYS = ["source_id", "field_name"]




def period_means(df: DataFrame, source: str, ts: str, fields: Sequence[str], step_s: int) -> DataFrame:
    """One row per source and period: mean and presence of each field (presence counts any value)."""
    aggs = [F.avg(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))).alias(f"v_{f}") for f in fields]
    at = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(step_s * 1_000_000)) * F.lit(step_s)
    return (
        df.where(F.col(source).isNotNull() & F.col(ts).isNotNull())
        .select(F.col(source).alias("source_id"), at.cast("long").alias("period_start"), *[F.col(f) for f in fields])
        .groupBy("source_id", "period_start")
        .agg(*aggs)
    )


def regular_grid(
    df: DataFrame, *, source: str, ts: str, fields: Sequence[str], step_s: int = 10, max_fill: int = 6
) -> DataFrame:
    """A regular series per source and field: (source_id, field_name, period_start, value, mark).

    ``mark`` is ``measured`` (mean of the period's readings), ``interpolated`` (linear between the
    neighbours, gaps of at most ``max_fill`` periods) or ``missing`` (longer gaps, and the ends from
    the source's first row to the field's first reading and from its last reading to the last row).
    Null sources and null times give no row; nulls and NaN are no readings; a field that is null
    throughout a source gives no rows for it; repeated rows are averaged; an empty table gives an
    empty series; other columns of the input are ignored, whatever their names.
    """
    step = F.lit(step_s).cast("long")
    block_s = F.lit(step_s * BLOCK_PERIODS).cast("long")
    means = period_means(df, source, ts, fields, step_s)
    block = F.floor(F.col("period_start") / block_s)
    long = means.select(
        "source_id",
        "period_start",
        block.alias("block"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"v_{f}").alias("value")) for f in fields])).alias("r"),
    ).select("source_id", "block", "period_start", "r.field_name", "r.value")
    inside = Window.partitionBy("source_id", "block", "field_name").orderBy("period_start")
    read = (
        long.where(F.col("value").isNotNull())
        .withColumn("next_start", F.lead("period_start").over(inside))
        .withColumn("next_value", F.lead("value").over(inside))
    )
    measured = read.select(*KEYS, "period_start", "value", F.lit("measured").alias("mark"))

    # edges of the blocks: first and last period with any row, first and last with a reading
    edges = long.groupBy("source_id", "block", "field_name").agg(
        F.min("period_start").alias("row_from"),
        F.max("period_start").alias("row_to"),
        F.min(F.when(F.col("value").isNotNull(), F.struct("period_start", "value"))).alias("first"),
        F.max(F.when(F.col("value").isNotNull(), F.struct("period_start", "value"))).alias("last"),
    )
    along = Window.partitionBy(*KEYS).orderBy("block")
    whole = Window.partitionBy(*KEYS)
    ends = edges.withColumn("row_from", F.min("row_from").over(whole)).withColumn("row_to", F.max("row_to").over(whole))
    ends = (
        ends.where(F.col("first").isNotNull())
        .withColumn("following", F.lead("first").over(along))
        .withColumn("n", F.row_number().over(along))
    )
    empty = F.lit(None).cast("struct<period_start:bigint,value:double>")
    gaps = (
        read.where(F.col("next_start") > F.col("period_start") + step)
        .select(
            *KEYS,
            F.struct("period_start", "value").alias("a"),
            F.struct(F.col("next_start").alias("period_start"), F.col("next_value").alias("value")).alias("b"),
            (F.col("period_start") + step).alias("lo"),
            (F.col("next_start") - step).alias("hi"),
        )
        .unionByName(
            ends.select(
                *KEYS,
                F.col("last").alias("a"),
                F.col("following").alias("b"),
                (F.col("last.period_start") + step).alias("lo"),
                F.coalesce(F.col("following.period_start") - step, F.col("row_to")).alias("hi"),
            )
        )
        .unionByName(
            ends.where("n = 1").select(
                *KEYS,
                empty.alias("a"),
                F.col("first").alias("b"),
                F.col("row_from").alias("lo"),
                (F.col("first.period_start") - step).alias("hi"),
            )
        )
        .where("lo <= hi")
    )
    run = ((F.col("hi") - F.col("lo")) / step + 1).cast("long")
    # in two steps, so that no gap, however long, becomes one array
    part = F.explode(F.sequence("lo", "hi", block_s)).alias("part")
    parts = gaps.withColumn("run", run).select("*", part)
    inside_part = F.sequence("part", F.least(F.col("hi"), F.col("part") + block_s - step), step)
    filled = parts.withColumn("period_start", F.explode(inside_part))
    share = (F.col("period_start") - F.col("a.period_start")) / (F.col("b.period_start") - F.col("a.period_start"))
    line = F.col("a.value") + share * (F.col("b.value") - F.col("a.value"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    mark = F.when(both & (F.col("run") <= max_fill), "interpolated").otherwise("missing")
    filled = filled.select(*KEYS, "period_start", F.when(mark == "interpolated", line).alias("value"), mark.alias("mark"))
    return measured.unionByName(filled)


def missing_periods(grid: DataFrame) -> DataFrame:
    """The periods of a grid in which no reading fell."""
    return grid.where(F.col("mark") != "measured").select(*KEYS, "period_start")
