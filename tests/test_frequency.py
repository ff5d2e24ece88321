import math

import pytest
from pyspark.sql import functions as F

from brindle.operators import frequency as fq


def dense(df, key, freq="freq"):
    return [r[freq] for r in df.orderBy(key).collect()]


def test_dense_counts(spark):
    keys = [5, 2, 2, 7, 5, 5, 0, 3]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    counted = [keys.count(k) for k in range(8)]
    for bound in (7, 8, 30):  # what lies above the greatest key is cut
        assert dense(fq.dense_by(df, "k", bound), "k") == counted
    assert dense(fq.dense_by(df, "k", 4, checked=False), "k") == [1, 0, 2, 1]
    with pytest.raises(Exception, match="out of bounds"):
        fq.dense_by(df, "k", 6).collect()


def test_dense_weighted(spark):
    rows = [(4, 10), (2, 7), (4, 5), (6, 1)]
    df = spark.createDataFrame(rows, "k bigint, w bigint")
    assert dense(fq.dense_by(df, "k", 9, weight="w"), "k") == [sum(w for k, w in rows if k == x) for x in range(7)]
    half = spark.createDataFrame([(2, 0.25), (1, 4.0), (2, 0.5)], "k bigint, w double")
    assert dense(fq.dense_by(half, "k", 2, weight="w"), "k") == [0.0, 4.0, 0.75]
    for none in (half.where("k > 5"), half.withColumn("w", F.lit(0.0))):
        assert dense(fq.dense_by(none, "k", 3, weight="w"), "k") == []


def test_sparse(spark):
    rows = [("red", 4), ("blue", 1), ("red", 6), ("green", 9), ("blue", 2)]
    df = spark.createDataFrame(rows, "k string, w bigint")
    assert {r.k: r.freq for r in fq.weighted_by(df, ["k"], "w").collect()} == {"red": 10, "blue": 3, "green": 9}
    pairs = spark.createDataFrame([((8, "u"),), ((8, "u"),), ((8, "v"),), ((9, "u"),)], "k struct<x: int, y: string>")
    assert sorted(r.freq for r in fq.count_by(pairs, "k").collect()) == [1, 1, 2]


def test_histogram(spark):
    def plain(values, n, low, high):
        out = [0] * n
        for v in values:
            x = (v - low) * (n / (high - low))
            out[0 if math.isnan(x) or x <= 0 else min(n - 1, int(min(x, n)))] += 1
        return out

    values = [2.0, 2.5, 3.75, 4.0, 5.5, 9.9, 10.0, 6.125]
    df = spark.createDataFrame([(x,) for x in values], "v double")
    assert dense(fq.histogram(df, "v", 5, 2.0, 10.0), "bin") == plain(values, 5, 2.0, 10.0)
    odd = [-7.0, 2.75, 88.0, math.nan, math.inf, -math.inf]
    frame = spark.createDataFrame([(x,) for x in [*odd, None]], "v double")
    assert dense(fq.histogram(frame, "v", 3, 2.0, 3.0), "bin") == plain(odd, 3, 2.0, 3.0) == [3, 0, 3]
    single = spark.createDataFrame([(x,) for x in values], "v float")
    assert dense(fq.histogram(single, "v", 5, 2.0, 10.0), "bin") == plain(values, 5, 2.0, 10.0)
    assert dense(fq.histogram(df.where("v > 50"), "v", 4, 0.0, 1.0), "bin") == [0] * 4
    w = spark.createDataFrame([(2.2, 8.0), (7.5, 0.5), (9.5, 0.25)], "v double, w double")
    assert dense(fq.histogram(w, "v", 2, 2.0, 10.0, weight="w"), "bin") == [8.0, 0.75]
    for bad, text in (((0, 0.0, 1.0), "at least one bin"), ((2, 1.0, 1.0), "max > min")):
        with pytest.raises(ValueError, match=text):
            fq.histogram(df, "v", *bad)
