import decimal
import functools
import math
import threading
import time
import timeit

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import bits, keys, rand
from brindle.operators import checks, flow
from brindle.operators import frequency as fq
from brindle.operators.simulate import birth_death, population_sizes, simulate_trees
from brindle.sources import store as st
from brindle.streaming import frequency as sf


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], T.StructType([T.StructField("v", kind)])).select(F.lower(F.hex(f(F.col("v")))).alias("k")).first().k


def test_key_bytes(spark):
    for v, want in ((-128, "00"), (-1, "7f"), (0, "80"), (127, "ff")):
        assert one(spark, v, T.ByteType(), lambda c: keys.key_signed(c, 1)) == want
    for v, want in ((-(2**31), "00000000"), (-1, "7fffffff"), (0, "80000000"), (2**31 - 1, "ffffffff")):
        assert one(spark, v, T.IntegerType(), lambda c: keys.key_signed(c, 4)) == want
    for v, want in ((-math.inf, "000fffffffffffff"), (-1.5, "4007ffffffffffff"), (-0.0, "8000000000000000"), (0.0, "8000000000000000"), (1.5, "bff8000000000000"), (math.inf, "fff0000000000000"), (math.nan, "fff8000000000000")):
        assert one(spark, v, T.DoubleType(), lambda c: keys.key_float(c, 8)) == want
    for v, want in ((-math.inf, "007fffff"), (-1.5, "403fffff"), (0.0, "80000000"), (1.5, "bfc00000"), (math.nan, "ffc00000")):
        assert one(spark, v, T.FloatType(), lambda c: keys.key_float(c, 4)) == want
    assert one(spark, 0x0102, T.LongType(), lambda c: keys.key_unsigned(c, 2)) == "0102"
    assert one(spark, True, T.BooleanType(), keys.key_bool) == "01"


def test_key_order(spark):
    rows = [(-1, 2.0), (-1, -3.5), (0, 1.0), (5, -1.0), (5, 7.0)]
    df = keys.with_key(spark.createDataFrame(rows, "a int, b double"), "a", "b")
    assert [(r.a, r.b) for r in df.orderBy("key").collect()] == sorted(rows)


def test_bits(spark):
    r = spark.createDataFrame([(0b1011_0110,)], "x int").select(bits.BitField(2, 3).of(F.col("x")).alias("a"), bits.BitField(4, 4).read(F.col("x")).alias("b"), bits.BitField(0, 4).ones(F.col("x")).alias("c"), bits.nibble(F.col("x"), 0).alias("d"), bits.BitField(1, 2).fill(F.col("x")).alias("e"), bits.BitField(1, 2).clear(F.col("x")).alias("f"), bits.BitField(1, 2).flip(F.col("x")).alias("g"), bits.BitField(4, 2).write(F.col("x"), F.lit(2)).alias("h")).first()
    assert tuple(r) == (0b10100, 0b1011, 2, 0b0110, 0b1011_0110, 0b1011_0000, 0b1011_0000, 0b1010_0110)


def test_poisson_moments(spark):
    r = spark.range(5000).select(rand.poisson(5.0, "m", "v", F.col("id")).alias("n")).agg(F.avg("n").alias("m"), F.var_samp("n").alias("v")).first()
    assert abs(r.m - 5) < 0.2 and abs(r.v - 5) < 0.4
    with pytest.raises(ValueError, match="lam"):
        rand.poisson(30.0, "m", "v", F.col("id"))
    with pytest.raises(ValueError):
        rand.stage_id("a_b")
    assert rand.path_of("trajectory-v1", "summary-v1") == "summary-v1_trajectory-v1"


def test_streams_do_not_depend_on_partitions(spark):
    def draw(n):
        return {r.id: r.u for r in spark.range(100).repartition(n).select("id", rand.uniform("p", "v", F.col("id"), 0).alias("u")).collect()}

    assert draw(1) == draw(7)


def test_rules(spark):
    df = spark.createDataFrame([(-0.1,), (0.5,), (math.nan,), (None,)], "rate double")
    rule = checks.Rule("rate", ((">", 0.0),))
    assert checks.passing(df, rule).count() == 1
    texts = {r.violation for r in checks.violations(df, rule).collect()}
    assert "invalid parameter `rate`: expected > 0.0, got -0.1" in texts and len(texts) == 3
    assert checks.Rule("p", ((">=", 0.0), ("<=", 1.0))).expects == "in [0.0, 1.0]"
    with pytest.raises(checks.InvalidParameter, match="got 1.2"):
        checks.Rule("p", ((">=", 0.0), ("<=", 1.0))).check(1.2)
    with pytest.raises(Exception, match="invalid parameter"):
        checks.enforce(df, rule).collect()


def test_repeated(spark):
    p = spark.createDataFrame([(10, 0), (20, 1)], "param int, n int")
    got = flow.repeated(p, 2, ordinal="n").orderBy("ordinal").collect()
    assert [(r.param, r.repetition_index) for r in got] == [(10, 0), (10, 1), (20, 0), (20, 1)]
    assert flow.repeated(p, 0).count() == 0


def test_memo_computes_missing_keys_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def compute(rows):
        def f(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return rows.mapInArrow(f, rows.schema).select("i", (F.col("i") * 3).alias("v"))

    store = st.ParquetStore(spark, str(tmp_path), "triple-v1")
    inputs = spark.createDataFrame([(i,) for i in (0, 1, 2, 1, 4)], "i bigint")
    assert sorted(r.v for r in flow.get_or_compute(inputs, ["i"], store, compute).collect()) == [0, 3, 3, 6, 12]
    first = calls.value
    flow.get_or_compute(inputs, ["i"], store, compute).collect()
    assert first == 4 and calls.value == first


def test_errors_are_not_stored(spark, tmp_path):
    def compute(rows):
        return rows.select("i", F.when(F.col("i") != 2, F.col("i")).alias("v"), F.when(F.col("i") == 2, "bad").alias("error"))

    store = st.ParquetStore(spark, str(tmp_path), "may-fail")
    got = flow.get_or_compute(spark.range(4).withColumnRenamed("id", "i"), ["i"], store, compute)
    assert {r.i: r.error for r in got.collect()} == {0: None, 1: None, 2: "bad", 3: None}
    assert store.read(["i"]).count() == 3


def test_store_last_write_wins_and_migration(spark, tmp_path):
    a, b = (st.ParquetStore(spark, str(tmp_path), "p", f) for f in ("a-v1", "b-v1"))
    a.append(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), ["k"])
    a.append(spark.createDataFrame([(1, "z")], "k int, v string"), ["k"])
    assert {r.k: r.v for r in a.read(["k"]).collect()} == {1: "z", 2: "y"}
    assert st.copy_store(a, b, ["k"]) == {"migrated": 2, "skipped": 0}
    c = st.ParquetStore(spark, str(tmp_path), "p", "c-v1")
    assert st.transcode_store(a, c, ["k"], lambda d: d.withColumn("refused", F.col("k") == 2)) == {"migrated": 1, "skipped": 1}
    with pytest.raises(st.StoreError):
        st.copy_store(a, a, ["k"])


def test_frames(spark):
    assert st.crc32c(b"123456789") == 0xE3069283
    slow = lambda data: functools.reduce(lambda c, b: (c >> 8) ^ st._CRC32C[(c ^ b) & 255], data, 0xFFFFFFFF) ^ 0xFFFFFFFF
    for n in (0, 1, 63, 64, 65, 2047, 2048, 2049, 5000):
        assert st.crc32c(bytes(k * k % 251 for k in range(n))) == slow(bytes(k * k % 251 for k in range(n)))
    big = b"abc" * 50_000
    for v, algorithm in [(v, a) for v in (b"", b"x", big) for a in st.ALGORITHMS]:
        frame = st.compress_frame(v, st.CompressPolicy(algorithm))
        assert st.read_frame(frame) == (v, "ok")
        assert st.read_frame(frame[:-1] + bytes([frame[-1] ^ 1]))[1] == "checksum"
    assert len(st.compress_frame(big)) < len(big) / 2
    assert st.compress_frame(big, st.CompressPolicy(max_len=10)) is None and st.read_frame(b"")[1] == "empty"
    with pytest.raises(st.CodecError):
        bad = bytes([0x20]) + b"abc"
        st.read_frame(bad + st.crc32c(bad).to_bytes(4, "little"))
    df = spark.createDataFrame([(bytearray(b"abc"),)], "v binary")
    r = df.select(st.unchecked_crc32c(st.checked_crc32c("v")).alias("r"), st.unchecked(st.checked(F.col("v")))[1].alias("s")).first()
    assert r.r.status == "ok" and bytes(r.r.value) == b"abc" and r.s == "ok"


def test_checksums_cost_less_than_a_loop_over_bytes():
    """A last chunk of any length is combined at once; it once took a step of numpy for each of its bytes."""
    data = bytes(k * k % 251 for k in range(2047))

    def loop():
        c = 0xFFFFFFFF
        for b in data:
            c = (c >> 8) ^ st._CRC32C[(c ^ b) & 255]
        return c ^ 0xFFFFFFFF

    assert st.crc32c(data) == loop()
    assert min(timeit.repeat(lambda: st.crc32c(data), number=3, repeat=5)) < min(timeit.repeat(loop, number=3, repeat=5))


def test_bounded_store(spark):
    log = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "k string, t int")
    assert {r.k for r in st.keep_recent(log, "k", "t", 2).collect()} == {"a", "c"}


def test_simulation_is_reproducible(spark):
    p = spark.createDataFrame([(1, 1.0, 0.5, 20, 5), (2, 1.0, 0.1, 10, 1)], "tree_id bigint, birth double, death double, max_cells int, min_survivors int")
    a, b = (sorted(map(tuple, simulate_trees(p.repartition(n), "s").collect()), key=str) for n in (1, 3))
    assert a == b
    assert sum(r[4] for r in a if r[0] == 2) == 10


def test_streaming_counts(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = sf.read_events(spark, str(tmp_path / "in"), src.schema)
    q = sf.running_counts(stream, "event_type").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_type: r.freq for r in spark.table("counts").collect()}
    assert got == {r["event_type"]: r["count"] for r in src.groupBy("event_type").count().collect()}


def test_track_and_interrupt(spark):
    df, progress = flow.track(spark.range(10), lambda rows: rows.where("id % 2 = 0"))
    assert df.count() == 5 and progress.snapshot() == {"total": 10, "started": 10, "in_flight": 5}
    with flow.interruptible(spark) as stop:
        stop()

    def slow(batches):
        time.sleep(60)
        yield from batches

    began = time.time()
    with pytest.raises(flow.Interrupted), flow.interruptible(spark) as stop:
        timer = threading.Timer(3, stop)
        timer.start()
        spark.range(8).mapInArrow(slow, "id bigint").count()
    assert time.time() - began < 40
    with flow.in_pool(spark, "side"):
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "side"
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def counting(spark, function):
    """``function`` of a frame, and how many rows went into it."""
    calls = spark.sparkContext.accumulator(0)

    def run(rows):
        def count(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return function(rows.mapInArrow(count, rows.schema))

    return run, calls


def test_null_keys_and_errors_are_computed_once(spark, tmp_path):
    run, calls = counting(spark, lambda rows: rows.select("i", (F.col("i") + 1).alias("v"), F.when(F.col("i") == 2, "bad").alias("error")))
    store = st.ParquetStore(spark, str(tmp_path), "once")
    inputs = spark.createDataFrame([(1,), (2,), (None,), (1,)], "i bigint")
    for n in (3, 4):  # the failed one again, and nothing else
        got = sorted(((r.i, r.v, r.error) for r in flow.get_or_compute(inputs, ["i"], store, run).collect()), key=str)
        assert got == sorted([(1, 2, None), (1, 2, None), (2, 3, "bad"), (None, None, None)], key=str) and calls.value == n


def test_a_hit_skips_the_upstream_and_its_errors_pass_through(spark):
    up, asked = counting(spark, lambda rows: rows.withColumn("u", F.col("k") * 10).withColumn("error", F.when(F.col("k") == 3, "no three")))
    first = flow.Stage("up-v1", up, ["k"], st.MemoryStore())
    second = first.derive("down-v1", lambda rows: rows.withColumn("v", F.col("u") + F.col("p")), params=["p"], store=st.MemoryStore())
    inputs = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "p bigint, k bigint")
    got = sorted((r.k, r.v, r.error) for r in second.results(inputs.where("k < 3")).collect())
    assert got == [(1, 11, None), (2, 21, None)] and asked.value == 2
    second.run(inputs.where("k < 3")).collect()
    assert asked.value == 2
    failed = second.results(inputs.where("k = 3")).first()
    assert (failed.ok, failed.error, failed.v) == (False, "no three", None)
    assert second.one(spark, p=1, k=2) == {"p": 1, "k": 2, "v": 21}
    with pytest.raises(flow.BatchError):
        second.one(spark, p=2, k=3)
    with pytest.raises(flow.BatchError, match="no three"):
        flow.collect_ordered(second.results(inputs), "p")
    assert [r.k for r in flow.collect_ordered(second.run(inputs.where("k < 3")), "k")] == [1, 2]


def test_streams_of_stages(spark):
    stage = flow.stochastic("draw-v1", lambda rows, draw: rows.withColumns({"a": draw("a"), "b": draw("b"), "a2": draw("a", 1)}), ["k"], ("a", "b"))
    got = {r.k: (r.a, r.b, r.a2) for r in stage.run(spark.range(50).withColumnRenamed("id", "k").repartition(5)).collect()}
    assert got == {r.k: (r.a, r.b, r.a2) for r in stage.run(spark.range(50).withColumnRenamed("id", "k").coalesce(1)).collect()}
    assert len({x for v in got.values() for x in v}) == 150
    with pytest.raises(ValueError, match="no stream c"):
        flow.stochastic("s", lambda rows, draw: rows.withColumn("c", draw("c")), ["k"], ("a",)).run(spark.range(1).withColumnRenamed("id", "k"))


def test_lru_store_refreshes_on_reads(spark):
    store = st.LruStore(2)
    frame = lambda *ks: spark.createDataFrame([(k, k * 2) for k in ks], "k int, v int")
    store.append(frame(1, 2), ["k"])
    assert {r.v for r in store.read(["k"], among=frame(1).select("k")).collect()} == {2}
    store.append(frame(3), ["k"])
    assert {r.k for r in store.read(["k"]).collect()} == {1, 3}
    with pytest.raises(ValueError):
        st.LruStore(0)


def test_encoded_store(spark, tmp_path):
    provider = st.Provider(spark, "parquet", root=str(tmp_path)).with_codec(st.Codec(st.CompressPolicy("zlib", min_len=10, max_len=120)))
    store = provider.bind("p-v1")
    assert store is provider.bind("p-v1")
    rows = spark.createDataFrame([(1, "x" * 40, 1.5), (2, None, None), (3, "y" * 400, 0.1)], "k int, s string, d double")
    with pytest.warns(UserWarning, match="refused"):
        store.append(rows, ["k"])
    again = st.Provider(spark, "parquet", root=str(tmp_path), codec=provider.codec).bind("p-v1")
    assert sorted(tuple(r) for r in again.read(["k"]).collect()) == [(1, "x" * 40, 1.5), (2, None, None)]
    raw = again.store
    raw.append(raw.read(["k"]).where("k = 1").withColumn("frame", F.expr("substring(frame, 2)")), ["k"])
    with pytest.warns(UserWarning, match="corrupt"):
        assert [r.k for r in again.read(["k"]).collect()] == [2]
    raw.append(raw.read(["k"]).where("k = 2").withColumn("frame", F.lit(bytearray(bytes([0x20, 0]) + st.crc32c(bytes([0x20, 0])).to_bytes(4, "little")))), ["k"])
    with pytest.raises(Exception, match="unknown frame version"):
        again.read(["k"])
    with pytest.raises(st.StoreError):
        st.Provider(spark, "tape")


def test_compaction_keeps_the_last_rows(spark, tmp_path):
    store = st.ParquetStore(spark, str(tmp_path), "c-v1")
    for v in ("a", "b", "c"):
        store.append(spark.createDataFrame([(1, v), (None, v)], "k int, v string"), ["k"])
    store.compact(["k"])
    assert store.raw().count() == 2 and {(r.k, r.v) for r in store.read(["k"]).collect()} == {(1, "c"), (None, "c")}


def test_places_in_order_need_no_single_task(spark):
    """A scan of a store was sorted and numbered in one task."""
    from brindle.plans.catalogue import QUERIES

    rows = spark.range(0, 10_000, 1, 8).select((F.col("id") * 7919 % 10_007).alias("k"))
    got = flow.numbered(rows.orderBy("k")).collect()
    assert sorted((r.pos, r.k) for r in got) == list(enumerate(sorted(k * 7919 % 10_007 for k in range(10_000)), 1))
    assert "Coalesce 1" not in QUERIES["store_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_wide_and_unsigned_keys(spark):
    top = decimal.Decimal(2**64 - 1)
    df = spark.createDataFrame([(top,), (decimal.Decimal(2**63),), (decimal.Decimal(0),), (None,)], "u decimal(20,0)")
    got = {r.u: r.k for r in df.select("u", F.hex(keys.key_unsigned(F.col("u"), 8)).alias("k")).collect()}
    assert got == {top: "F" * 16, decimal.Decimal(2**63): "8" + "0" * 15, decimal.Decimal(0): "0" * 16, None: None}
    with pytest.raises(Exception, match="not an unsigned"):
        spark.range(1).select(keys.key_unsigned(F.lit(decimal.Decimal(2**64)), 8)).collect()
    with pytest.raises(Exception, match="wide"):
        keys.with_key(spark.createDataFrame([([1, 2, 3],)], "a array<int>"), "a", array_length=2).collect()


def test_large_samples_come_from_buckets(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    for n in (0, 1, 17, 2999, 3000, 5000):
        a, b = ({r.k for r in rand.sample_rows(df, "k", n, "p", few=few, buckets=16).collect()} for few in (-1, 10**6))
        assert a == b and len(a) == min(n, 3000)


def test_population_sizes_equal_trees(spark):
    p = spark.createDataFrame([(1, 1.0, 0.5, 20, 5), (2, 1.0, 0.1, 10, 1)], "tree_id bigint, birth double, death double, max_cells int, min_survivors int")
    alive = {r.tree_id: r["count"] for r in simulate_trees(p, "s").where("alive").groupBy("tree_id").count().collect()}
    assert {r.tree_id: r.cells for r in population_sizes(p, "s").collect()} == alive
    with pytest.raises(Exception, match="no run of 5"):
        birth_death("s", 1, 1e-9, 1.0, 50, 50, max_attempts=5)


def test_sums_that_do_not_fit_fail(spark):
    df = spark.createDataFrame([(1, 200), (1, 100)], "k int, w int")
    assert fq.weighted_by(df, ["k"], "w", count_type="smallint").first().freq == 300
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        fq.weighted_by(df, ["k"], "w", count_type="tinyint").collect()
    assert fq.sized(spark.range(100).repartition(8), 50).rdd.getNumPartitions() == 2


def test_rules_on_text_columns(spark):
    df = spark.createDataFrame([("b", (1.5,)), ("A", (math.nan,)), (None, None)], "s string, n struct<x: double>")
    assert checks.passing(df, checks.Rule("s", ((">=", "a"),))).count() == 1
    assert checks.passing(df, checks.Rule("n.x", ((">", 0.0),))).count() == 1
