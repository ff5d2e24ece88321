"""Written tables in the folder that the cluster shares, and connected components over them."""

from __future__ import annotations

import gc
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.shared import shared_dir


class Scratch:
    """Parquet tables of one run; lost executors reread them instead of recomputing what made them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/brindle-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[DataFrame] = []

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._brindle_path = path
        self.tables.append(out)
        return out

    def drop_all_but(self, *kept: DataFrame) -> None:
        """Deletes the tables of this run that no later DataFrame reads."""
        for t in [t for t in self.tables if not any(t is k for k in kept)]:
            self.drop(t)

    def release(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of steps whose results are written and whose frames are gone."""
        for _ in range(2):  # frames that Python drops are dropped in the JVM by its own collector, a moment later
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that no later DataFrame reads."""
        self.tables = [t for t in self.tables if t is not df]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._brindle_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def possibly_in(df: DataFrame, keys: DataFrame, key: str, bits: int = 1 << 24, *, inverse: bool = False) -> DataFrame:
    """``df`` without most of the rows whose key is not in ``keys``, so that a join to follow moves few rows.

    The keys' hashes mark a bitmap of ``bits`` bits (2 MB as set), which is what gets broadcast,
    however many keys there are; a row stays if its bit is set, so no row with a key is lost. ``inverse`` gives exactly the other rows.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    number, bit = "_bitmap_number", "_bitmap_bit"
    marks = keys.select(F.bitmap_bucket_number(place).alias(number), F.bitmap_bit_position(place).alias(bit)).groupBy(number).agg(F.bitmap_construct_agg(bit).alias("_bitmap"))
    byte = F.conv(F.hex(F.expr(f"substring(_bitmap, cast({bit} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    tested = df.withColumns({number: F.bitmap_bucket_number(place), bit: F.bitmap_bit_position(place)}).join(F.broadcast(marks), number, "left")
    marked = F.coalesce(byte.bitwiseAND(F.expr(f"cast(shiftleft(1, cast({bit} % 8 as int)) as int)")) != 0, F.lit(False))
    return tested.where(~marked if inverse else marked).select(*df.columns)


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is not in ``keys`` (distinct, only that column); rows with a null key stay.

    Only rows that the bitmap marks are shuffled. The join is an outer one: an anti join would be
    pushed below the bitmap's.
    """
    maybe = possibly_in(df, keys, key).join(keys.withColumn("_found", F.lit(True)), key, "left").where("_found is null")
    return possibly_in(df, keys, key, inverse=True).unionByName(maybe.select(*df.columns))


def _joined(batches):
    """Components of the edges (u, v) of one task."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*parts, strict=True)]), return_inverse=True)
    u, v = at[: len(at) // 2], at[len(at) // 2 :]
    top = np.arange(len(nodes))
    while True:
        a, b = top[u], top[v]
        open_ = a != b
        if not open_.any():
            break
        np.minimum.at(top, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while (top[top] != top).any():
            top = top[top]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[top])], ["node", "component"])


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 40, few: int = 1_000_000) -> DataFrame:
    """(node, component): component is the smallest node reachable. ``edges`` has long columns a and b.

    Up to ``few`` distinct edges (16 bytes each) are joined in one task without a shuffle. Beyond that,
    alternates the large-star and small-star steps until neither changes the edge set. Both are
    one aggregation and one join on edges, so a hub with a third of all edges is never one row
    or one task's group; each round is written, so lineage stays short. Nodes only in null or
    self edges are not returned.
    """
    cur = scratch.write(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    if cur.count() <= few:
        return cur.coalesce(1).mapInArrow(_joined, "node long, component long")
    seen = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        nxt = scratch.write(small, "edges")
        mark = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        scratch.drop(cur)
        cur = nxt
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(
        cur.groupBy(F.col("v").alias("node")).agg(F.first("v").alias("component"))
    )
