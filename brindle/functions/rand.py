"""Counter-based random columns: a draw depends on its stream's name, the input's key and a counter only.

Results don't depend on partitioning, order or which other streams exist; two streams of one
name are the same stream.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SEGMENT = re.compile(r"[A-Za-z0-9-]+\Z")


def stage_id(name: str) -> str:
    """A checked stage name: letters, digits and hyphens."""
    if not _SEGMENT.match(name):
        raise ValueError(f"a stage name needs letters, digits and hyphens only: {name!r}")
    return name


def path_of(*stages: str) -> str:
    """Identity of a derived result: its stages from the last to the first."""
    return "_".join(stage_id(s) for s in reversed(stages))


def uniform(path: str, variable: str, key: Column, counter: Column | int) -> Column:
    """A double in [0, 1) with 52 random bits."""
    n = F.lit(counter) if isinstance(counter, int) else counter
    text = F.concat_ws("|", F.lit(path), F.lit(variable), key.cast("string"), n.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def uniforms(path: str, variables: list[str], key: Column, counter: Column | int = 0) -> dict[str, Column]:
    """One draw for each named stream."""
    return {v: uniform(path, v, key, counter) for v in variables}


def sample_rows(df: DataFrame, key: str, amount: int, path: str, variable: str = "", *, few: int = 100_000, buckets: int = 1 << 16) -> DataFrame:
    """Exactly ``amount`` rows (all, if fewer) without replacement: those with the smallest draws, ties by key.

    Up to ``few`` rows are a top-k. More are found by a histogram of the draws: whole buckets below the one in which the
    amount is reached, and a top-k of that bucket, so no task holds the sample.
    """
    u = uniform(path, variable, F.col(key), 0)
    rows = df.withColumn("_u", u)
    if amount <= few:
        return rows.orderBy("_u", key).limit(amount).drop("_u")
    rows = rows.withColumn("_b", F.floor(F.col("_u") * buckets).cast("int"))
    left = amount
    for r in rows.groupBy("_b").count().orderBy("_b").collect():  # at most ``buckets`` rows
        if r["count"] > left:
            some = rows.where(F.col("_b") == r["_b"]).orderBy("_u", key).limit(left)
            return rows.where(F.col("_b") < r["_b"]).unionByName(some).drop("_u", "_b")
        left -= r["count"]
    return rows.drop("_u", "_b")


def poisson(lam: float, path: str, variable: str, key: Column, max_draws: int = 128) -> Column:
    """Poisson counts by multiplying uniforms until they fall to e**-lam; 0 < lam < 30.

    The job fails if ``max_draws`` draws don't suffice (for lam = 30, a chance below 1e-30).
    """
    if not 0 < lam < 30:
        raise ValueError(f"invalid parameter `lam`: expected in (0, 30), got {lam}")
    stop = F.lit(math.exp(-lam))
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0).alias("k"))

    def step(s: Column, n: Column) -> Column:
        going = s["p"] > stop
        return F.struct(F.when(going, s["p"] * uniform(path, variable, key, n)).otherwise(s["p"]).alias("p"), (s["k"] + going.cast("int")).alias("k"))

    def draws(s: Column, first: int, last: int) -> Column:
        return F.aggregate(F.sequence(F.lit(first), F.lit(last)), s, step)

    def then(s: Column, f) -> Column:
        return F.transform(F.array(s), f)[0]  # names a value, so that it is computed once

    few = min(max_draws, math.ceil(lam + 4 * math.sqrt(lam)))
    end = draws(start, 1, few)
    if few < max_draws:  # a loop doesn't stop when the count is known: only rows that go on have the long one
        end = then(end, lambda s: F.when(s["p"] > stop, draws(s, few + 1, max_draws)).otherwise(s))
    return then(end, lambda s: F.when(s["p"] > stop, F.raise_error(F.lit("too few draws")).cast("int")).otherwise(s["k"] - 1)).cast("bigint")


def ranked_sample(df: DataFrame, group: str, key: str, amount: int, path: str) -> DataFrame:
    """``amount`` rows of each group without replacement."""
    w = Window.partitionBy(group).orderBy(uniform(path, "", F.col(key), 0), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= amount).drop("_r")
