"""Demand-driven stages: results are looked up by key, and only missing inputs are computed.

A stage maps an input frame (key columns, other columns) to value columns. Derived stages take
another stage's result; where their own result is stored, the upstream isn't asked at all. Stochastic
stages get named random streams that depend on the stage's path and the input's key only. A null key is
a key like others. Failed rows (a text in the column ``error``) are never stored. The compute functions work on
frames: Column expressions first, ``mapInPandas`` where nothing built in fits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.rand import path_of, uniform
from brindle.sources.shared import written
from brindle.sources.store import NoStore, same_keys


class Interrupted(RuntimeError):
    """The batch was interrupted before it ended."""


class BatchError(RuntimeError):
    """A row of a batch failed; the message names the first failed input."""


def repeated(params: DataFrame, reps: int, *, ordinal: str | None = None) -> DataFrame:
    """Every row of ``params`` with repetition_index 0..reps-1, parameter-major; no rows for 0.

    ``ordinal`` names the column of ``params`` that numbers its rows; the result's ``ordinal`` follows from it, and
    the job fails if it doesn't fit a long.
    """
    if not 0 <= reps < 1 << 63:
        raise ValueError(f"invalid parameter `reps`: expected in [0, 2**63), got {reps}")
    out = params.withColumn("repetition_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint")))) if 0 < reps <= 10_000 else params.join(params.sparkSession.range(reps).withColumnRenamed("id", "repetition_index"), how="cross")
    return out.withColumn("ordinal", F.col(ordinal).cast("bigint") * F.lit(reps).cast("bigint") + F.col("repetition_index")) if ordinal else out


def get_or_compute(inputs: DataFrame, keys: list[str], store, compute: Callable[[DataFrame], DataFrame], *, valid: Column | None = None) -> DataFrame:
    """``inputs`` (keys and more) with the value columns that ``compute`` gives for each distinct key.

    Stored rows for which ``valid`` is not true count as missing. ``compute`` gets the distinct missing
    inputs and returns the keys and values; a column named ``error``, if any, keeps a row with an error
    from being stored. The store is read for the inputs' keys alone, what is missing is computed once and
    written, and results come from these two tables.
    """
    distinct = inputs.dropDuplicates(keys)
    cached = store.read(keys, among=distinct.select(*keys))
    if cached is not None:
        cached = written(cached if valid is None else cached.where(F.coalesce(valid, F.lit(False))), "hits")
    missing = distinct if cached is None else same_keys(distinct, cached.select(*keys), keys, "left_anti")
    fresh = compute(missing)
    if not isinstance(store, NoStore):
        fresh = written(fresh, "fresh")
        store.append(fresh.where("error is null").drop("error") if "error" in fresh.columns else fresh, keys)
    results = fresh
    if cached is not None:
        if "error" in fresh.columns:
            cached = cached.withColumn("error", F.lit(None).cast(fresh.schema["error"].dataType))
        results = cached.select(*fresh.columns).unionByName(fresh)
    extra = [c for c in inputs.columns if c in results.columns and c not in keys]
    return same_keys(inputs, results.drop(*extra), keys)


@dataclass
class Stage:
    """A named stage: ``function`` maps a frame of inputs to the same frame with value columns added.

    A stochastic stage names its ``streams``; its function gets the frame and a function draw(stream, counter=0)
    that gives a uniform Column. Its inputs are told apart by their keys, so give repetitions a key column.
    """

    name: str
    function: Callable
    keys: list[str]
    store: object = field(default_factory=NoStore)
    upstream: Stage | None = None
    streams: tuple[str, ...] = ()

    @property
    def path(self) -> str:
        names, s = [], self
        while s is not None:
            names.append(s.name)
            s = s.upstream
        return path_of(*reversed(names))

    def _apply(self, rows: DataFrame) -> DataFrame:
        if not self.streams:
            return self.function(rows)
        if len(set(self.streams)) < len(self.streams):
            raise ValueError("streams need different names")
        key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys])

        def draw(stream: str, counter: Column | int = 0) -> Column:
            if stream not in self.streams:
                raise ValueError(f"the stage {self.name} has no stream {stream}")
            return uniform(self.path, stream, key, counter)

        return self.function(rows, draw)

    def run(self, inputs: DataFrame) -> DataFrame:
        """Values for every input row; upstream values are computed for missing keys only."""

        def compute(missing: DataFrame) -> DataFrame:
            rows = missing
            if self.upstream is not None:
                above = self.upstream.run(missing.select(*self.upstream.keys).distinct())
                rows = same_keys(missing, above, self.upstream.keys)
                if "error" in above.columns:  # what failed upstream fails here and isn't computed
                    good = self._apply(rows.where("error is null").drop("error"))
                    good = good if "error" in good.columns else good.withColumn("error", F.lit(None).cast("string"))
                    bad = rows.where("error is not null")
                    dropped = [c for c in rows.columns if c in good.columns and c not in (*self.keys, "error")]
                    return good.drop(*dropped).unionByName(bad.select(*self.keys, "error"), allowMissingColumns=True)
            out = self._apply(rows)
            dropped = [c for c in rows.columns if c in out.columns and c not in self.keys]
            return out.drop(*dropped)

        return get_or_compute(inputs, self.keys, self.store, compute)

    def one(self, spark: SparkSession, **key) -> dict:
        """The values for a single input, given by its columns; a failed one raises BatchError."""
        row = self.run(spark.createDataFrame([tuple(key.values())], list(key))).first().asDict()
        if row.pop("error", None) is not None:
            raise BatchError(f"the input {key} failed")
        return row

    def results(self, inputs: DataFrame) -> DataFrame:
        """``inputs`` with a boolean ``ok``, the values (null where not) and ``error``; every input computed once."""
        out = self.run(inputs)
        out = out if "error" in out.columns else out.withColumn("error", F.lit(None).cast("string"))
        return out.withColumn("ok", F.col("error").isNull())

    def derive(self, name: str, function: Callable, *, params: list[str] | None = None, store=None, streams: tuple[str, ...] = ()) -> Stage:
        """A stage on this one's values; ``params`` are its own key columns, before the upstream's. With ``streams`` it is stochastic."""
        return Stage(name, function, [*(params or []), *self.keys], store or NoStore(), self, tuple(streams))


def stochastic(name: str, function: Callable, keys: list[str], streams: tuple[str, ...], store=None) -> Stage:
    """A stage whose function draws from named streams; ``keys`` hold the parameters and the repetition."""
    return Stage(name, function, keys, store or NoStore(), None, tuple(streams))


def collect_ordered(df: DataFrame, ordinal: str = "ordinal") -> list:
    """Rows on the driver in input order; a row with an error raises BatchError. For results known to be small."""
    if "error" in df.columns:
        bad = df.where("error is not null").orderBy(ordinal).first()
        if bad is not None:
            raise BatchError(f"input {bad[ordinal]}: {bad['error']}")
    return df.orderBy(ordinal).collect()


def serial(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One task, in order."""
    return df.coalesce(1).sortWithinPartitions(ordinal)


def numbered(ordered: DataFrame, name: str = "pos") -> DataFrame:
    """A sorted frame with each row's place from 1 in ``name``: places within the sorted partitions, after the rows of those before. No task holds more than a partition."""
    ordered = ordered.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    rows = written(ordered, "ordered")  # sorted once: both uses below read the same partitions
    size = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = F.broadcast(size.select("_part", "_low", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_skip")))
    return rows.join(before, "_part").withColumn(name, F.col("_id") - F.col("_low") + F.col("_skip") + 1).drop("_id", "_part", "_low", "_skip")


@contextmanager
def in_pool(spark: SparkSession, pool: str):
    """Jobs started inside the block run in this scheduler pool."""
    sc, name = spark.sparkContext, "spark.scheduler.pool"
    before = sc.getLocalProperty(name)
    sc.setLocalProperty(name, pool)
    try:
        yield
    finally:
        sc.setLocalProperty(name, before)


@contextmanager
def interruptible(spark: SparkSession):
    """Yields a function that interrupts all jobs started inside the block; an interrupted job raises Interrupted."""
    tag = f"brindle-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    sc.addJobTag(tag)  # a session's own tags can't be interrupted from other threads
    stopped = []

    def stop() -> None:
        stopped.append(True)
        sc.cancelJobsWithTag(tag)

    try:
        yield stop
    except Exception as e:
        if stopped:
            raise Interrupted("the batch was interrupted") from e
        raise
    finally:
        sc.removeJobTag(tag)


@dataclass
class Progress:
    """Counts of a batch's rows; ``started`` and ``done`` are exact once the job has ended without retries."""

    total: int
    _started: object
    _done: object

    def snapshot(self) -> dict[str, int]:
        started, done = self._started.value, self._done.value
        return {"total": self.total, "started": started, "in_flight": max(0, started - done)}


def track(df: DataFrame, function: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, Progress]:
    """``function`` of ``df`` with counts of the rows that went in and came out, and the counts."""
    sc = df.sparkSession.sparkContext
    started, done = sc.accumulator(0), sc.accumulator(0)

    def counted(frame: DataFrame, into) -> DataFrame:
        def count(batches):
            for b in batches:
                into.add(b.num_rows)
                yield b

        return frame.mapInArrow(count, frame.schema)

    rows = counted(df, started)
    return counted(function(rows) if function else rows, done), Progress(df.count(), started, done)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
