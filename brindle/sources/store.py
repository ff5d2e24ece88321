"""Keyed result tables: Parquet stores by namespace, bounded and encoded stores, checked and compressed value frames, and migration.

A namespace is "{path}__keyfmt-v{n}__{value format}"; a change of meaning needs a new path, a
change of encoding a new format. Appends carry a time and a writer's mark; the last write of a key wins. A null key is a
key like others.
"""

from __future__ import annotations

import json
import time
import uuid
import warnings
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from brindle.functions.keys import ENCODING_VERSION
from brindle.sources.shared import written

ORIGINAL_LIMIT = 1 << 32


class StoreError(RuntimeError):
    """A store can't be opened, read or written."""


class CodecError(ValueError):
    """A value frame is broken in a way that is no plain corruption (unknown version or algorithm)."""


def namespace(path: str, value_format: str) -> str:
    name = f"{path}__keyfmt-v{ENCODING_VERSION}__{value_format}"
    if not 1 <= len(name) <= 255:
        raise StoreError(f"a namespace has 1 to 255 characters, this one {len(name)}")
    return name


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; the result has the keys once."""
    other = right.select(*[F.col(k).alias(f"_key_{k}") if k in keys else F.col(k) for k in right.columns])
    out = left.join(other, reduce(lambda a, b: a & b, [left[k].eqNullSafe(F.col(f"_key_{k}")) for k in keys]), how)
    return out if how == "left_anti" or how == "left_semi" else out.drop(*[f"_key_{k}" for k in keys])


class ParquetStore:
    """Results of one namespace under ``root``, as Parquet files that any executor can read."""

    def __init__(self, spark: SparkSession, root: str, path: str, value_format: str = "parquet-v1"):
        self.spark, self.location = spark, f"{root.rstrip('/')}/{namespace(path, value_format)}"

    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.location)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def raw(self) -> DataFrame | None:
        return self.spark.read.parquet(self.location) if self.exists() else None

    def read(self, keys: list[str], among: DataFrame | None = None) -> DataFrame | None:
        """The last written row of each key; ``among`` (distinct keys) bounds what is read to its keys."""
        rows = self.raw()
        if rows is None:
            return None
        if among is not None:
            rows = same_keys(rows, among, keys, "left_semi")
        rest = [c for c in rows.columns if c not in (*keys, "seq")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])

    def append(self, rows: DataFrame, keys: list[str]) -> None:
        """Rows sorted by key, so that later lookups skip row groups. Writers don't wait for each other: of two that write a key, the later clock wins, then the greater mark."""
        seq = F.struct(F.lit(time.time_ns()).cast("bigint").alias("at"), F.lit(uuid.uuid4().hex).alias("writer"))
        rows.withColumn("seq", seq).sortWithinPartitions(*keys).write.mode("append").parquet(self.location)

    def compact(self, keys: list[str]) -> None:
        """Rewrites the store to one row a key, beside the old files, which go afterwards. No other writer may be at work."""
        rows = self.raw()
        if rows is None:
            return
        rest = [c for c in rows.columns if c not in keys]
        last = written(rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("v")).select(*keys, "v.*"), "compact")
        last.sortWithinPartitions(*keys).write.mode("overwrite").parquet(self.location)

    def scan(self, keys: list[str]) -> DataFrame | None:
        """All rows in key order."""
        rows = self.read(keys)
        return None if rows is None else rows.orderBy(*keys)


class NoStore:
    """Keeps nothing; every result is computed."""

    def read(self, keys, among=None):
        return None

    def append(self, rows, keys):
        return None


class MemoryStore:
    """An unbounded store of this session, shared by all holders of the object: a written table, replaced at each append."""

    def __init__(self):
        self._rows: DataFrame | None = None

    def read(self, keys, among=None):
        return self._rows if among is None or self._rows is None else same_keys(self._rows, among, keys, "left_semi")

    def append(self, rows, keys):
        new = written(rows, "memory")
        self._rows = new if self._rows is None else written(same_keys(self._rows, new.select(*keys), keys, "left_anti").unionByName(new), "memory")


class LruStore:
    """A store of at most ``capacity`` keys, shared by all holders of the object. Reads and writes refresh a key; those not used for longest go first, of equals the greater key."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError(f"invalid parameter `capacity`: expected >= 1, got {capacity}")
        self.capacity, self._rows, self._clock = capacity, None, 0

    def read(self, keys, among=None):
        if self._rows is None:
            return None
        self._clock += 1
        if among is None:
            self._rows = written(self._rows.withColumn("_used", F.lit(self._clock)), "lru")
            return self._rows.drop("_used")
        asked = among.select(*keys).distinct().withColumn("_asked", F.lit(True))
        other = asked.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_asked")
        on = reduce(lambda a, b: a & b, [self._rows[k].eqNullSafe(F.col(f"_key_{k}")) for k in keys])
        marked = self._rows.join(other, on, "left").drop(*[f"_key_{k}" for k in keys])
        marked = written(marked.withColumn("_used", F.when(F.col("_asked"), F.lit(self._clock)).otherwise(F.col("_used"))), "lru")
        self._rows = marked.drop("_asked")
        return marked.where("_asked").drop("_used", "_asked")

    def append(self, rows, keys):
        self._clock += 1
        new = written(rows.withColumn("_used", F.lit(self._clock)), "lru")
        both = new if self._rows is None else same_keys(self._rows, new.select(*keys), keys, "left_anti").unionByName(new)
        self._rows = written(both.orderBy(F.desc("_used"), *keys).limit(self.capacity), "lru")


class Provider:
    """Binds a stage's path to a store: ``kind`` is parquet (under ``root``), memory, lru or none; ``codec`` puts an encoded store over it."""

    def __init__(self, spark: SparkSession, kind: str = "parquet", *, root: str | None = None, capacity: int = 1024, codec: Codec | None = None):
        if kind not in ("parquet", "memory", "lru", "none") or kind == "parquet" and not root:
            raise StoreError(f"no store of kind {kind}" if kind != "parquet" else "a parquet store needs a root")
        self.spark, self.kind, self.root, self.capacity, self.codec = spark, kind, root, capacity, codec
        self._bound: dict[str, object] = {}

    def with_codec(self, codec: Codec) -> Provider:
        return Provider(self.spark, self.kind, root=self.root, capacity=self.capacity, codec=codec)

    def bind(self, path: str):
        """The store of this path; the same object each time, but for ``none``."""
        if path not in self._bound:
            if self.kind == "parquet":
                store = ParquetStore(self.spark, self.root, path, self.codec.value_format if self.codec else "parquet-v1")
            else:
                store = {"memory": MemoryStore, "none": NoStore}[self.kind]() if self.kind != "lru" else LruStore(self.capacity)
            self._bound[path] = EncodedStore(store, self.codec) if self.codec and self.kind != "none" else store
        return self._bound[path]


def keep_recent(log: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """(key, last): the ``capacity`` keys used last, for a bounded store with least-recently-used eviction."""
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("last"))
    return last.orderBy(F.desc("last"), key).limit(capacity)


def keep_recent_by_group(log: DataFrame, group: str, key: str, order: str, capacity: int) -> DataFrame:
    """The same within each group (one bounded store for each)."""
    last = log.groupBy(group, key).agg(F.max(order).alias("last"))
    w = Window.partitionBy(group).orderBy(F.desc("last"), key)
    return last.withColumn("r", F.row_number().over(w)).where(F.col("r") <= capacity).drop("r")


_CRC32C = []
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0x82F63B78 if _c & 1 else 0)
    _CRC32C.append(_c)


_CHUNK = 2048
_TABLE = np.array(_CRC32C, np.uint32)


def _place_tables() -> np.ndarray:
    """[k, b]: what byte b gives if k more bytes follow it."""
    out = np.empty((_CHUNK, 256), np.uint32)
    out[0] = _TABLE
    for k in range(1, _CHUNK):
        out[k] = (out[k - 1] >> np.uint32(8)) ^ _TABLE[out[k - 1] & np.uint32(0xFF)]
    return out


_PLACES: list[np.ndarray] = []


def crc32c(data: bytes) -> int:
    """CRC-32C (Castagnoli). The code is linear, so a chunk's bytes are looked up by their place and combined at once; the state before it is added to its first four bytes."""
    if not _PLACES:
        _PLACES.extend((_place_tables()[::-1].ravel(), np.arange(_CHUNK) * 256))
    places, starts = _PLACES
    raw = np.frombuffer(data, np.uint8)
    c = 0xFFFFFFFF
    for lo in range(0, len(raw), _CHUNK):
        part = raw[lo : lo + _CHUNK]
        n = len(part)
        if n < 64:
            for b in part.tolist():
                c = (c >> 8) ^ _CRC32C[(c ^ b) & 0xFF]
            continue
        at = starts[_CHUNK - n :] + part
        at[:4] = starts[_CHUNK - n : _CHUNK - n + 4] + (part[:4] ^ np.frombuffer(c.to_bytes(4, "little"), np.uint8))
        c = int(np.bitwise_xor.reduce(places[at]))
    return c ^ 0xFFFFFFFF


def checked(value: Column) -> Column:
    """payload || CRC-32 (IEEE, big-endian) as built-in expressions."""
    return F.concat(value, F.unhex(F.lpad(F.hex(F.crc32(value)), 8, "0")))


def unchecked(frame: Column) -> tuple[Column, Column]:
    """(value, status) of a checked frame: ok, truncated or checksum; the value is null unless ok."""
    n = F.octet_length(frame)
    payload = F.substring(frame, F.lit(1), n - 4)
    good = F.unhex(F.lpad(F.hex(F.crc32(payload)), 8, "0")) == F.substring(frame, n - 3, F.lit(4))
    status = F.when(frame.isNull() | (n < 4), "truncated").when(good, "ok").otherwise("checksum")
    return F.when(status == "ok", payload), status


@pandas_udf(T.BinaryType())
def checked_crc32c(value: pd.Series) -> pd.Series:
    """payload || CRC-32C little-endian, for exchange with other systems."""
    return value.map(lambda b: None if b is None else bytes(b) + crc32c(bytes(b)).to_bytes(4, "little"))


@pandas_udf(T.StructType([T.StructField("value", T.BinaryType()), T.StructField("status", T.StringType())]))
def unchecked_crc32c(frame: pd.Series) -> pd.DataFrame:
    def one(b):
        if b is None or len(b) < 4:
            return None, "truncated"
        body = bytes(b[:-4])
        return (body, "ok") if crc32c(body).to_bytes(4, "little") == bytes(b[-4:]) else (None, "checksum")

    return pd.DataFrame([one(b) for b in frame], columns=["value", "status"])


@dataclass(frozen=True)
class CompressPolicy:
    """Values of ``min_len`` bytes or more are tried, and stay compressed if that saves ``min_saved`` of the raw frame; longer ones than ``max_len`` (0: no limit) are refused."""

    algorithm: str = "zstd"
    level: int = 3
    min_len: int = 64 * 1024
    min_saved: float = 0.1
    max_len: int = 0

    def __post_init__(self):
        if self.algorithm not in ALGORITHMS:
            raise CodecError(f"unknown compression {self.algorithm}")


# The numbers of the algorithms in a frame's header.
ALGORITHMS = {"none": 0, "lz4": 1, "zstd": 2, "zlib": 3}


def _compressed(value: bytes, policy: CompressPolicy) -> bytes:
    if policy.algorithm == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=policy.level).compress(value)
    if policy.algorithm == "zlib":
        return zlib.compress(value, policy.level)
    import pyarrow as pa

    return pa.compress(value, codec="lz4_raw", asbytes=True)


def compress_frame(value: bytes, policy: CompressPolicy = CompressPolicy()) -> bytes | None:
    """One frame: a header byte (version and algorithm), the original length if compressed, the payload, CRC-32C; None if the policy refuses the value."""
    if policy.max_len and len(value) > policy.max_len or len(value) >= ORIGINAL_LIMIT:
        return None
    raw = bytes([0x10]) + value
    frame = raw
    if policy.algorithm != "none" and len(value) >= policy.min_len:
        small = bytes([0x10 | ALGORITHMS[policy.algorithm]]) + len(value).to_bytes(4, "little") + _compressed(value, policy)
        if len(small) + 4 <= (len(raw) + 4) * (1 - policy.min_saved):
            frame = small
    return frame + crc32c(frame).to_bytes(4, "little")


def read_frame(frame: bytes | None, *, max_len: int = 0) -> tuple[bytes | None, str]:
    """(value, status): ok, or the corruption found (empty, truncated, checksum, length); other faults raise CodecError."""
    if not frame:
        return None, "empty"
    if len(frame) < 5:
        return None, "truncated"
    if crc32c(frame[:-4]).to_bytes(4, "little") != frame[-4:]:
        return None, "checksum"
    version, algorithm = frame[0] >> 4, frame[0] & 15
    if version != 1:
        raise CodecError(f"unknown frame version {version}")
    if algorithm == 0:
        return frame[1:-4], "ok"
    if algorithm not in (1, 2, 3):
        raise CodecError(f"unknown compression {algorithm}")
    if len(frame) < 9:
        return None, "truncated"
    n = int.from_bytes(frame[1:5], "little")
    if max_len and n > max_len:
        raise CodecError(f"a value of {n} bytes is over the limit of {max_len}")
    try:
        if algorithm == 2:
            import zstandard

            value = zstandard.ZstdDecompressor().decompress(frame[5:-4], max_output_size=n)
        elif algorithm == 3:
            value = zlib.decompress(frame[5:-4])
        else:
            import pyarrow as pa

            value = pa.decompress(frame[5:-4], decompressed_size=n, codec="lz4_raw", asbytes=True)
    except Exception as e:  # the checksum was right, so the writer was wrong
        raise CodecError(f"a payload of compression {algorithm} can't be read: {e}") from e
    return (value, "ok") if len(value) == n else (None, "length")


def framed(value: Column, policy: CompressPolicy = CompressPolicy()) -> Column:
    """Frames of a binary column; null for null and refused values."""

    @pandas_udf(T.BinaryType())
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda b: None if b is None else compress_frame(bytes(b), policy))

    return run(value)


def unframed(frame: Column, *, max_len: int = 0) -> Column:
    """struct<value, status> of frames; faults that are no corruption fail the job."""

    @pandas_udf(T.StructType([T.StructField("value", T.BinaryType()), T.StructField("status", T.StringType())]))
    def run(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_frame(None if b is None else bytes(b), max_len=max_len) for b in v], columns=["value", "status"])

    return run(frame)


@dataclass(frozen=True)
class Codec:
    """Values as JSON text in checked frames (built-in expressions), compressed if there is a policy (one Arrow function)."""

    policy: CompressPolicy | None = None

    @property
    def value_format(self) -> str:
        return "json-v1-checked" if self.policy is None else f"json-v1-{self.policy.algorithm}"

    def encode(self, value: Column) -> Column:
        data = F.encode(F.to_json(value, {"ignoreNullFields": "false"}), "utf-8")
        return checked(data) if self.policy is None else framed(data, self.policy)

    def decode(self, frame: Column, kind: T.StructType) -> tuple[Column, Column]:
        """(value, status): null unless ok."""
        if self.policy is None:
            data, status = unchecked(frame)
        else:
            both = unframed(frame, max_len=self.policy.max_len)
            data, status = both["value"], both["status"]
        return F.when(status == "ok", F.from_json(F.decode(data, "utf-8"), kind)), status


class EncodedStore:
    """A store of encoded values over another one. A corrupt value is a miss, with a warning; a refused one isn't stored."""

    def __init__(self, store, codec: Codec = Codec()):
        self.store, self.codec, self._kind = store, codec, None

    def read(self, keys, among=None):
        rows = self.store.read(keys, among)
        if rows is None:
            return None
        kind = self._kind
        if kind is None:
            first = rows.where("kind is not null").select("kind").first()
            if first is None:
                return None
            kind = T.StructType.fromJson(json.loads(first.kind))
        value, status = self.codec.decode(F.col("frame"), kind)
        out = written(rows.select(*keys, value.alias("v"), status.alias("status")), "decoded")
        bad = out.where("status <> 'ok'").count()
        if bad:
            warnings.warn(f"{bad} corrupt values count as missing", stacklevel=2)
        return out.where("status = 'ok'").select(*keys, "v.*")

    def append(self, rows, keys):
        rest = [c for c in rows.columns if c not in keys]
        self._kind = T.StructType([rows.schema[c] for c in rest])
        out = written(rows.select(*keys, self.codec.encode(F.struct(*rest)).alias("frame"), F.lit(self._kind.json()).alias("kind")), "encoded")
        refused = out.where("frame is null").count()
        if refused:
            warnings.warn(f"{refused} values were refused and not stored", stacklevel=2)
        self.store.append(out.where("frame is not null"), keys)


def copy_store(source: ParquetStore, target: ParquetStore, keys: list[str]) -> dict[str, int]:
    """Copies all keys; both stores must differ. Returns {migrated, skipped}."""
    if source.location == target.location:
        raise StoreError("a store can't be migrated onto itself")
    rows = source.read(keys)
    if rows is None:
        return {"migrated": 0, "skipped": 0}
    target.append(rows, keys)
    return {"migrated": rows.count(), "skipped": 0}


def transcode_store(source: ParquetStore, target: ParquetStore, keys: list[str], recode: Callable[[DataFrame], DataFrame], refused: str = "refused") -> dict[str, int]:
    """Copies through ``recode``, which may mark rows in a boolean column ``refused``; these are skipped and counted."""
    if source.location == target.location:
        raise StoreError("a store can't be migrated onto itself")
    rows = source.read(keys)
    if rows is None:
        return {"migrated": 0, "skipped": 0}
    out = recode(rows)
    if refused not in out.columns:
        out = out.withColumn(refused, F.lit(False))
    n = out.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(refused).cast("bigint")), F.lit(0)).alias("s")).first()
    target.append(out.where(~F.col(refused)).drop(refused), keys)
    return {"migrated": int(n.n - n.s), "skipped": int(n.s)}
