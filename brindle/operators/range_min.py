"""Range minima over a table (pos, val) by a sparse table of doubling spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.flow import union_all


def sparse_table(rows: DataFrame, levels: int) -> DataFrame:
    """(k, pos, best): the smallest (val, pos) of the 2**k places from pos, for spans inside the table."""
    cur = rows.select("pos", F.struct("val", "pos").alias("best"))
    out = [cur.withColumn("k", F.lit(0))]
    for k in range(1, levels + 1):
        right = cur.select((F.col("pos") - (1 << (k - 1))).alias("pos"), F.col("best").alias("other"))
        cur = cur.join(right, "pos").select("pos", F.least("best", "other").alias("best"))
        out.append(cur.withColumn("k", F.lit(k)))
    return union_all(out).select("k", "pos", "best")


def range_min(rows: DataFrame, queries: DataFrame, max_span: int) -> DataFrame:
    """(lo, hi, val, pos) of the inclusive ranges (lo, hi); ties go to the first place."""
    levels = max(0, max_span.bit_length() - 1)
    table = sparse_table(rows, levels)
    q = queries.withColumn("k", F.floor(F.log2((F.col("hi") - F.col("lo") + 1).cast("double")) + 1e-9).cast("int"))
    x = q.join(table.select("k", F.col("pos").alias("lo"), F.col("best").alias("b1")), ["k", "lo"])
    y = x.withColumn("r", (F.col("hi") - F.expr("shiftleft(1L, k)") + 1)).join(table.select("k", F.col("pos").alias("r"), F.col("best").alias("b2")), ["k", "r"])
    best = F.least("b1", "b2")
    return y.select("lo", "hi", best["val"].alias("val"), best["pos"].alias("pos"))


def block_range_min(rows: DataFrame, queries: DataFrame, max_span: int, block: int = 16) -> DataFrame:
    """(lo, hi, val, pos) of the inclusive ranges over places 0, 1, ..., by blocks: the ends within their blocks, whole blocks by a sparse table of their minima.

    The table has a row for each block and level, so n / ``block`` x log2(``max_span`` / ``block``) rows. Ties go to the first place.
    """
    packed = rows.groupBy(F.expr(f"pos div {block}").alias("b")).agg(F.array_sort(F.collect_list(F.struct("pos", "val"))).alias("cells"))
    least = lambda cells, lo, hi: F.array_min(F.transform(F.filter(cells, lambda x: (x["pos"] >= lo) & (x["pos"] <= hi)), lambda x: F.struct(x["val"].alias("val"), x["pos"].alias("pos"))))
    q = queries.select("lo", "hi", F.expr(f"lo div {block}").alias("b1"), F.expr(f"hi div {block}").alias("b2"))
    q = q.join(packed.select(F.col("b").alias("b1"), F.col("cells").alias("c1")), "b1").join(packed.select(F.col("b").alias("b2"), F.col("cells").alias("c2")), "b2")
    q = q.select("lo", "hi", (F.col("b1") + 1).alias("first"), (F.col("b2") - 1).alias("last"), F.least(least(F.col("c1"), F.col("lo"), F.col("hi")), least(F.col("c2"), F.col("lo"), F.col("hi"))).alias("ends"))
    minima = packed.select(F.col("b").alias("pos"), F.array_min(F.transform("cells", lambda x: F.struct(x["val"].alias("val"), x["pos"].alias("at")))).alias("val"))
    inner = range_min(minima, q.where("first <= last").select(F.col("first").alias("lo"), F.col("last").alias("hi")).distinct(), max(1, max_span // block + 1))
    found = inner.select(F.col("lo").alias("first"), F.col("hi").alias("last"), F.struct(F.col("val.val").alias("val"), F.col("val.at").alias("pos")).alias("whole"))
    best = F.least("ends", "whole")
    return q.join(found, ["first", "last"], "left").select("lo", "hi", best["val"].alias("val"), best["pos"].alias("pos"))
