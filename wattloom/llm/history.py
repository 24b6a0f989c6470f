"""New batches against everything accepted before (problem 2).

Accepted rides live in a persisted inverted file: each cell holds one rider's rides of one span of
time and one step of distance with their full vectors (start, distance, moving time; nulls kept). A
new ride probes its own cell, then the others in order of their lower bound on the distance, until
the bound passes the nearest match so far or the radius: no nearer match is possible beyond. Matches
are reranked exactly, and only rides that repeat none become heads and are appended to their cells.
Accepted file hashes are persisted beside them in buckets.

Rides of a batch are taken in order of landing, and only heads are matched against, so the same rows
come out however the landed rows are cut into batches. A batch is appended under its own name:
taking it in again, after a failure or by mistake, changes nothing. Cells are partitioned by month,
and a batch reads only the months that it touches.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wattloom.session import cut_lineage, shared_path

#: Scales of the vector: a difference of one scale in any part is a distance of 1, the radius.
START_S, LOG_DISTANCE, LOG_TIME = 300, 0.012, 0.015
MONTH_S = 30 * 86400
#: A task settles the rides of one rider and block of time; it also sees those a margin before and after.
BLOCK_S, MARGIN_S = 6 * 3600, 3600
HASH_BUCKETS = 16

VECTOR = ["rider", "start_s", "distance", "moving_time"]
PAIRS = "key_a long, key_b long"


def file_digests(history: DataFrame) -> DataFrame:
    """(id, digest) of taken-in attempts with a hash.

    A hash is compared without case, blanks or a prefix such as ``sha256:``. Failed attempts, null
    and blank hashes never count.
    """
    digest = F.regexp_replace(F.lower(F.trim(F.col("file_hash"))), r"^[a-z0-9_-]+:\s*|\s", "")
    taken = F.lower(F.trim("status")).isin("success", "warning")
    return history.where(taken).select("id", digest.alias("digest")).where("digest != '' and id is not null")


def ride_vectors(starts: DataFrame, activities: DataFrame) -> DataFrame:
    """(row_id, rider, start_s, distance, moving_time) of rows with a rider and a start.

    Distances and times that are null, NaN or not above 0 are unknown, that is null.
    """
    known = lambda c: F.when(~F.isnan(c) & (c > 0), c)
    size = activities.select(
        "row_id", known(F.col("distance").cast("double")).alias("distance"), known(F.col("moving_time").cast("double")).alias("moving_time")
    )
    return (
        starts.join(size, "row_id")
        .where("row_id is not null and athlete_id is not null and utc_s is not null")
        .select("row_id", F.col("athlete_id").alias("rider"), F.col("utc_s").alias("start_s"), "distance", "moving_time")
    )


class _Kept:
    """A persisted table under ``path``, in folders by ``part`` and then by batch."""

    SCHEMA, PART = "", ""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or shared_path(spark, "accepted")

    def accepted(self, parts: Iterable[int] | None = None, but: str | None = None) -> DataFrame:
        """What lies under the path now, of the given parts, without the batch named ``but``."""
        try:
            kept = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            kept = self.spark.createDataFrame([], self.SCHEMA)
        if parts is not None:
            kept = kept.where(F.col(self.PART).isin(list(parts)))
        return kept if but is None else kept.where(F.col("batch") != but)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Write the rows of a batch; those it wrote before in the same parts are replaced."""
        out = rows.withColumn("batch", F.lit(batch)).hint("rebalance", F.col(self.PART))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.PART, "batch").parquet(self.path)


class FileHashes(_Kept):
    """Accepted file contents: the digest and the first attempt that brought it."""

    SCHEMA = "digest string, id long, bucket int, batch string"
    PART = "bucket"

    def take_in(self, batch: DataFrame, name: str) -> DataFrame:
        """(key_a, key_b): attempts of the batch (id, digest) whose content was accepted before, or came
        earlier in the batch, with the attempt that first brought it; the rest is appended."""
        bucket = F.pmod(F.xxhash64("digest"), F.lit(HASH_BUCKETS)).cast("int")
        first = batch.groupBy("digest").agg(F.min("id").alias("id")).withColumn("bucket", bucket)
        old = self.accepted(but=name).select("bucket", "digest", F.col("id").alias("old_id"))
        heads = cut_lineage(first.join(old, ["bucket", "digest"], "left"), "file-heads")
        self.append(heads.where("old_id is null").select("digest", "id", "bucket"), name)
        keyed = heads.select("digest", F.coalesce("old_id", "id").alias("key_a"))
        return batch.join(keyed, "digest").where("id != key_a").select("key_a", F.col("id").alias("key_b"))


def _month(start: Column) -> Column:
    return F.floor(start / MONTH_S).cast("int")


#: States of a ride: not settled yet, a head, a repeat of one.
OPEN, HEAD, REPEAT = 0, 1, 2
SETTLED = "row_id long, rider string, start_s long, distance double, moving_time double, state int, key_a long"


class _Cells:
    """Inverted cells of one rider and block, in memory: a span of START_S seconds and a step of
    LOG_DISTANCE each; rides of unknown distance have cells of their own."""

    def __init__(self):
        self.spans: dict[int, dict[int | None, list[tuple]]] = {}

    @staticmethod
    def _near(x: float, width: float) -> list[tuple[int, float]]:
        """The cells within one width of x, each with the scaled distance to its nearer edge."""
        c = math.floor(x / width)
        return [(c - 1, x / width - c), (c, 0.0), (c + 1, c + 1 - x / width)]

    def add(self, ride: tuple) -> None:
        _, start, d, _, _ = ride
        span = self.spans.setdefault(math.floor(start / START_S), {})
        span.setdefault(None if d is None else math.floor(d / LOG_DISTANCE), []).append(ride)

    def nearest(self, start: int, d: float | None, m: float | None) -> tuple[int | None, bool]:
        """The nearest head within the radius, the least row of equals, and whether a ride as near as it
        is still open. Cells are probed in order of their lower bound."""
        cells = []
        for c, low in self._near(start, START_S):
            span = self.spans.get(c)
            if span:
                if d is None:
                    cells += [(low, held) for held in span.values()]
                else:
                    cells += [(max(low, b), span[k]) for k, b in [*self._near(d, LOG_DISTANCE), (None, 0.0)] if k in span]
        best, who, doubt = math.inf, None, math.inf
        for low, held in sorted(cells, key=lambda x: x[0]):
            if low > min(best, 1):
                break  # nothing nearer is possible
            for row, s, x, y, state in held:
                far = abs(start - s) / START_S
                if d is not None and x is not None:
                    far = max(far, abs(d - x) / LOG_DISTANCE)
                if m is not None and y is not None:
                    far = max(far, abs(m - y) / LOG_TIME)
                if far > 1:
                    continue
                if state == OPEN:
                    doubt = min(doubt, far)
                elif far < best or (far == best and row < who):
                    best, who = far, row
        return who, doubt < math.inf and doubt <= best


def _settle(rows: list[tuple]) -> Iterator[tuple]:
    """SETTLED rows of one rider and block, in order of landing, accepted heads first. A ride near the
    window's edges, or with an open ride as near as its nearest head, stays open for another round."""
    cells = _Cells()
    for block, accepted, row, rider, start, distance, moving, state, key in rows:
        # unknown numbers arrive as NaN
        d = math.log(distance) if distance == distance else None
        m = math.log(moving) if moving == moving else None
        if not accepted and state == OPEN:
            lo, hi = block * BLOCK_S - MARGIN_S, (block + 1) * BLOCK_S + MARGIN_S
            if start - START_S >= lo and start + START_S < hi:
                who, unsettled = cells.nearest(start, d, m)
                if not unsettled:
                    state, key = (HEAD, row) if who is None else (REPEAT, who)
        if state != REPEAT:
            cells.add((row, start, d, m, state))
        if not accepted and start // BLOCK_S == block:
            yield row, rider, start, distance, moving, state, key


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by rider, block, accepted first and landing; one group of them at a time."""
    names = [x.split()[0] for x in SETTLED.split(", ")]

    held, of, found = [], None, []
    for pdf in batches:
        columns = [pdf[c].tolist() for c in ("block", "accepted", *names)]
        for row in zip(*columns, strict=True):
            at = row[3], row[0]
            if at != of:
                found += _settle(held)
                held, of = [], at
                if len(found) > 20_000:
                    yield pd.DataFrame(found, columns=names)
                    found = []
            held.append(row)
    found += _settle(held)
    if found:
        yield pd.DataFrame(found, columns=names)


class RideCells(_Kept):
    """Accepted rides (heads) with their vectors, by month and batch."""

    SCHEMA = "row_id long, rider string, start_s long, distance double, moving_time double, month int, batch string"
    PART = "month"

    def take_in(self, batch: DataFrame, name: str) -> DataFrame:
        """(key_a, key_b): rides of the batch (vectors) that repeat an accepted ride or an earlier one
        of the batch, with the nearest head; the rest is appended to the cells.

        Accepted rides come before the batch whatever their row_id. Rides with equal vectors are looked
        up once. An empty batch gives no rows.
        """
        ones = batch.groupBy(*VECTOR).agg(F.min("row_id").alias("row_id"))
        reach = F.array_distinct(F.array(_month(F.col("start_s") - BLOCK_S - MARGIN_S), _month(F.col("start_s") + BLOCK_S + MARGIN_S)))
        months = [r[0] for r in batch.select(F.explode(reach).alias("m")).distinct().collect()]  # bounded by the calendar
        heads = self.accepted(months, but=name)
        near = F.sequence(F.floor((F.col("start_s") - MARGIN_S) / BLOCK_S), F.floor((F.col("start_s") + MARGIN_S) / BLOCK_S))
        placed = lambda df, accepted, state, key: df.select(
            F.explode(near).alias("block"), F.lit(accepted).alias("accepted"), "row_id", *VECTOR, state.alias("state"), key.alias("key_a")
        )
        old = placed(heads, True, F.lit(HEAD), F.col("row_id"))
        rows = placed(ones, False, F.lit(OPEN), F.col("row_id"))
        while True:
            walked = (
                rows.unionByName(old)
                .repartition("rider", "block")
                .sortWithinPartitions("rider", "block", F.desc("accepted"), "row_id")
                .mapInPandas(_walk, SETTLED)
            )
            seen = Observation()
            settled = cut_lineage(walked.observe(seen, F.count_if(F.col("state") == OPEN).alias("open")), "ride-settled")
            if not seen.get.get("open"):
                break
            # chains that reach beyond a window need another round; the first open ride always settles
            rows = placed(settled, False, F.col("state"), F.col("key_a"))
        unknown = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c)
        settled = settled.select("row_id", "rider", "start_s", unknown("distance"), unknown("moving_time"), "state", "key_a")
        fresh = settled.where(F.col("state") == HEAD).select("row_id", *VECTOR, _month(F.col("start_s")).alias("month"))
        self.append(fresh, name)
        same = [batch[c].eqNullSafe(settled[c]) for c in VECTOR]
        v = lambda df: F.xxhash64(*[F.coalesce(df[c].cast("string"), F.lit("-")) for c in VECTOR])
        rows = batch.join(settled, [v(batch) == v(settled), *same]).where(batch["row_id"] != settled["key_a"])
        return rows.select(settled["key_a"], batch["row_id"].alias("key_b"))


def _in_batches(keyed: DataFrame, key: str, index: _Kept, batches: int) -> DataFrame:
    """(key_a, key_b) of all rows, taken in as ``batches`` ranges of ``key``, the order of landing."""
    spark = keyed.sparkSession
    lo, hi = keyed.agg(F.min(key), F.max(key)).first()
    found = spark.createDataFrame([], PAIRS)
    if lo is None:
        return found
    step = (hi - lo) // batches + 1
    for i in range(batches):
        a = lo + i * step
        # opened anew for each batch, as by a process of its own
        part = keyed.where((F.col(key) >= a) & (F.col(key) < a + step))
        found = found.unionByName(type(index)(spark, index.path).take_in(part, f"{a:020d}"))
    return found


def same_rides(vectors: DataFrame, batches: int = 3, index: RideCells | None = None) -> DataFrame:
    """(key_a, key_b): rides (vectors) and the accepted ride that they repeat."""
    index = index or RideCells(vectors.sparkSession)
    return _in_batches(cut_lineage(vectors, "ride-vectors"), "row_id", index, batches)


def same_file(history: DataFrame, batches: int = 3, index: FileHashes | None = None) -> DataFrame:
    """(key_a, key_b): taken-in attempts b with the content of a, the first taken-in attempt."""
    index = index or FileHashes(history.sparkSession)
    return _in_batches(cut_lineage(file_digests(history), "file-digests"), "id", index, batches)
