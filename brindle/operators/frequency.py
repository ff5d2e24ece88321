"""Counts of values: sparse, dense over a bounded key range, and equal-width histograms.

Every operator is one ``groupBy`` (partial and final hash aggregation) and, for the dense forms,
a join of the few result rows with a ``range`` spine. Null keys and null weights are skipped in
the dense forms; sparse counts keep null as a key, as ``groupBy`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def count_by(df: DataFrame, *keys: str | Column, out: str = "freq", count_type: str = "bigint") -> DataFrame:
    """Rows per distinct key (any groupable type, structs included)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast(count_type).alias(out))


def weighted_by(df: DataFrame, keys: list[str | Column], weight: str | Column, out: str = "freq", count_type: str | None = None) -> DataFrame:
    """Sum of weights per distinct key; a sum that doesn't fit ``count_type`` fails the job."""
    total = F.sum(weight)
    return df.groupBy(*keys).agg((total.cast(count_type) if count_type else total).alias(out))


def sized(df: DataFrame, rows_per_partition: int | None = None) -> DataFrame:
    """``df`` in partitions of about so many rows (default: one for each core), merged without a shuffle where there are more.

    Counting needs no such call; it bounds the number of tasks where rows are few and partitions many.
    """
    if rows_per_partition is None:
        return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))
    if rows_per_partition < 1:
        raise ValueError("rows_per_partition must be positive")
    return df.coalesce(max(1, -(-df.count() // rows_per_partition)))


def running_sums(df: DataFrame, key: str, freq: str, *, out: str = "before", block: int = 1 << 16) -> DataFrame:
    """``df`` with the sum of ``freq`` over all smaller keys (distinct, not negative), 0 for the first.

    Sums run within blocks of keys, in one task each; what the blocks before hold comes from a sum over blocks, of which there
    are key range / ``block``.
    """
    b = F.floor(F.col(key) / block)
    rows = df.withColumn("_block", b)
    totals = rows.groupBy("_block").agg(F.sum(freq).alias("_sum"))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(totals, "_block").withColumn(out, (F.col("_ahead") + F.coalesce(F.sum(freq).over(inside), F.lit(0))).cast("bigint"))
    return found.drop("_block", "_ahead")


def trim_trailing_zeros(df: DataFrame, key: str, freq: str) -> DataFrame:
    """Drops the rows above the largest key whose frequency is not zero; all-zero input gives no rows."""
    last = df.where(F.col(freq) != 0).agg(F.max(key).alias("_last"))
    return df.join(F.broadcast(last), F.col(key) <= F.col("_last")).drop("_last")


def dense_by(df: DataFrame, key: str, upper_bound: int, *, weight: str | None = None, checked: bool = True, out: str = "freq", count_type: str | None = None) -> DataFrame:
    """Count (or sum of ``weight``) for every key in 0..upper_bound, trailing zeros cut.

    ``checked`` fails the job on a key outside the range; otherwise such rows are left out. The
    spine has upper_bound + 1 rows and is generated in parallel. A sum that doesn't fit ``count_type`` fails the job.
    """
    if upper_bound < 0:
        raise ValueError("upper_bound must not be negative")
    k = F.col(key).cast("bigint")
    if checked:
        message = F.concat(F.lit("key out of bounds: "), k.cast("string"), F.lit(f" is not in 0..{upper_bound}"))
        k = F.when((k < 0) | (k > upper_bound), F.raise_error(message).cast("bigint")).otherwise(k)
    rows = df.where(F.col(key).isNotNull())
    agg = F.sum(weight) if weight else F.count(F.lit(1))
    agg = agg.cast(count_type) if count_type else agg
    found = rows.select(k.alias("_k"), *([weight] if weight else [])).groupBy("_k").agg(agg.alias(out))
    kind = found.schema[out].dataType
    zero = F.lit(0).cast(kind)
    spine = df.sparkSession.range(upper_bound + 1).withColumnRenamed("id", key)
    dense = spine.join(found, F.col(key) == F.col("_k"), "left").select(key, F.coalesce(out, zero).alias(out))
    return trim_trailing_zeros(dense, key, out)


def bin_index(value: Column, n_bins: int, low: float, high: float, *, single: bool = False) -> Column:
    """Bin of an equal-width histogram on [low, high]: values below and NaN go to the first bin, above to the last.

    The product is compared in floating point before it is cast, so infinities are safe under
    ANSI casts. ``single`` computes in 32-bit floats.
    """
    if n_bins <= 0:
        raise ValueError("a histogram requires at least one bin")
    if not high > low:
        raise ValueError("a histogram requires max > min")
    if single:
        lit = lambda x: F.lit(x).cast("float")
        import numpy as np

        width = float(np.float32(n_bins) / (np.float32(high) - np.float32(low)))
        x = ((value.cast("float") - lit(low)) * lit(width)).cast("float")
    else:
        x = (value.cast("double") - F.lit(float(low))) * F.lit(n_bins / (high - low))
    return F.when(F.isnan(x), 0).when(x <= 0, 0).when(x >= n_bins - 1, n_bins - 1).otherwise(x.cast("int"))


def histogram(df: DataFrame, value: str, n_bins: int, low: float, high: float, *, weight: str | None = None, out: str = "freq") -> DataFrame:
    """Count (or sum of ``weight``) for each of exactly ``n_bins`` bins; null values are skipped."""
    single = isinstance(df.schema[value].dataType, T.FloatType)
    rows = df.where(F.col(value).isNotNull())
    agg = F.sum(weight) if weight else F.count(F.lit(1))
    found = rows.groupBy(bin_index(F.col(value), n_bins, low, high, single=single).alias("_b")).agg(agg.alias(out))
    zero = F.lit(0).cast(found.schema[out].dataType)
    spine = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(found, F.col("bin") == F.col("_b"), "left").select("bin", F.coalesce(out, zero).alias(out))


def dense_array(df: DataFrame, key: str, freq: str) -> DataFrame:
    """One row with the dense frequencies in key order, for bounds that fit one row."""
    pairs = F.array_sort(F.collect_list(F.struct(key, freq)))
    return df.agg(F.transform(pairs, lambda p: p[freq]).alias(freq))
