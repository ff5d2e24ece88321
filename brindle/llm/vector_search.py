"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

* Lists: k-means centroids from at most ``max_sample`` vectors (those with the smallest hash of
  their id); every vector is put in the list of its nearest centroid. How many lists a query
  probes is set on the sample: as many as hold ``target_recall`` of the sample's true neighbours.
* Blocks: lists are cut into blocks of about ``block`` vectors and the queries of a list into
  blocks too, by hash, so a list that holds a third of all rows is many tasks. A task
  returns at most k rows for each query.
* Scan: the vectors in a query's lists among a sample of ``floor_sample`` vectors are candidates; the
  k-th best of them is a score the others must reach (none with fewer than k), and those k are
  results whatever the scan finds, so a query has k rows if its lists hold k other vectors.
  Vectors and queries are rotated by one random orthogonal matrix and read in column
  groups. After each group a candidate is abandoned if its squared distance so far,
  scaled to all dimensions, exceeds what the query's k-th best inner product allows by the
  factor (1 + ``epsilon`` / sqrt(dimensions read)); survivors get their exact inner product in
  double precision from the original vectors.

Rows that are null, zero, hold null or non-finite components, or have another length than the
most common one take no part, neither do null ids. Rows that repeat an id count once, with the
best score. Fewer than k candidates: all are returned. Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.tables import Scratch


@dataclass(frozen=True)
class Params:
    k: int = 20
    max_sample: int = 20_000
    max_lists: int = 1024
    target_recall: float = 0.97
    block: int = 4096
    floor_sample: int = 4096
    epsilon: float = 2.1
    groups: int = 4
    seed: int = 5


@dataclass
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int
    sizes: np.ndarray | None = None
    queries: np.ndarray | None = None
    sample: np.ndarray | None = None
    sample_ids: np.ndarray | None = None
    sample_lists: np.ndarray | None = None


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def fit(sample: np.ndarray, n: int, p: Params) -> Index:
    """Centroids, rotation and number of probes from a sample of the n vectors."""
    rng = np.random.default_rng(p.seed)
    d = sample.shape[1]
    rotation, _ = np.linalg.qr(rng.standard_normal((d, d)))
    lists = max(1, min(p.max_lists, int(np.sqrt(n) / 2), len(sample) // 16))
    c = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(10):
        own = _nearest(sample, c)
        count = np.bincount(own, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        fresh = sample[rng.integers(0, len(sample), lists)]
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], fresh)
    own = _nearest(sample, c)
    asked = rng.choice(len(sample), min(256, len(sample)), replace=False)
    s = sample[asked] @ sample.T
    s[np.arange(len(asked)), asked] = -np.inf
    top = np.argpartition(-s, min(p.k, len(sample) - 1) - 1, axis=1)[:, : p.k] if len(sample) > 1 else np.zeros((len(asked), 0), int)
    rank = np.argsort(np.argsort(-(sample[asked] @ c.T), axis=1), axis=1)
    need = np.sort(np.take_along_axis(rank, own[top], 1).ravel()) if top.size else np.zeros(1, int)
    probes = int(need[min(len(need) - 1, int(np.ceil(p.target_recall * len(need))))]) + 1
    return Index(c, rotation, min(lists, probes))


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last, whatever the machine."""
    return np.cumsum(x * q, axis=1)[:, -1] if len(x) else np.zeros(0)


def scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, floor: np.ndarray, rotation: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, vector position, score) of each query's k best in one block, best first.

    ``floor`` is a score that each query's k-th best candidate is known to reach. Column groups are
    read for all pairs while many are alive, and for the living alone once they are few.
    """
    d = x.shape[1]
    xr, qr = x @ rotation, q @ rotation
    cuts = np.unique(np.linspace(0, d, p.groups + 1).astype(int))
    xn, qn = (x * x).sum(1), (q * q).sum(1)
    best_q, best_x, best_s = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
    floor = floor - 1e-9
    slack = [(1 + (p.epsilon / np.sqrt(b) if b < d else 0)) ** 2 * b / d for b in cuts[1:]]
    for lo in range(0, len(x), 512):
        hi = min(lo + 512, len(x))
        allowed = np.maximum(xn[lo:hi, None] + qn[None, :] - 2 * floor[None, :], 0) + 1e-9
        part = np.zeros_like(allowed)
        i = None
        for a, b, s in zip(cuts[:-1], cuts[1:], slack, strict=True):
            if i is None:
                xa, qa = xr[lo:hi, a:b], qr[:, a:b]
                part += (xa * xa).sum(1)[:, None] + (qa * qa).sum(1)[None, :] - 2 * (xa @ qa.T)
                alive = part <= allowed * s
                if b == d or np.count_nonzero(alive) < 0.05 * alive.size:
                    i, j = np.nonzero(alive)
                    far, most = part[i, j], allowed[i, j]
            else:
                far = far + ((xr[lo + i, a:b] - qr[j, a:b]) ** 2).sum(1)
                keep = far <= most * s
                i, j, far, most = i[keep], j[keep], far[keep], most[keep]
        other = ids[lo + i] != qids[j]
        i, j = i[other], j[other]
        score = inner(x[lo + i], q[j])
        all_q, all_x, all_s = np.concatenate([best_q, j]), np.concatenate([best_x, lo + i]), np.concatenate([best_s, score])
        order = np.lexsort((ids[all_x], -all_s, all_q))
        all_q, all_x, all_s = all_q[order], all_x[order], all_s[order]
        first = np.searchsorted(all_q, np.arange(len(q) + 1))
        keep = np.arange(len(all_q)) - first[all_q] < p.k
        best_q, best_x, best_s = all_q[keep], all_x[keep], all_s[keep]
        full = np.flatnonzero(np.diff(first) >= p.k)
        kept = np.searchsorted(best_q, np.arange(len(q) + 1))
        floor[full] = np.maximum(floor[full], best_s[kept[full + 1] - 1] - 1e-9)
    return best_q, best_x, best_s


def floors(q: np.ndarray, qids: np.ndarray, probed: np.ndarray, ix: Index, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k-th best inner product among the sampled vectors of its lists, -inf if they are fewer; and these k best.

    ``probed`` marks the lists of each query. The k best are query positions, ids and scores.
    """
    out = np.full(len(q), -np.inf)
    found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(ix.sample) >= k:
        for lo in range(0, len(q), 512):
            s = q[lo : lo + 512] @ ix.sample.T
            s[~probed[lo : lo + 512][:, ix.sample_lists]] = -np.inf
            s[qids[lo : lo + 512, None] == ix.sample_ids[None, :]] = -np.inf
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(s, top, 1)
            out[lo : lo + 512] = best.min(1)
            row = np.flatnonzero(np.isfinite(best.min(1)))
            of, at = np.repeat(lo + row, k), top[row].ravel()
            for got, v in zip(found, (of, ix.sample_ids[at], inner(ix.sample[at], q[of])), strict=True):
                got.append(v)
    return out, *map(np.concatenate, found)


def _matrix(column, d: int) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def vector_type(vectors: DataFrame, vector_col: str) -> str:
    """Floats stay floats, as they are exact in double precision; all else is held as doubles."""
    return "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int | None]:
    """(vec_id, v) of the rows that take part, and their dimension (None: there are none)."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(vector_type(vectors, vector_col)).alias("v")).where("vec_id is not null").where(ok)
    d = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (rows.where(F.size("v") == d.d), d.d) if d else (rows, None)


def search(vectors: DataFrame, is_query: Column, p: Params = Params(), *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query row by inner product. ``is_query`` is over vec_id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows, d = clean(vectors, id_col, vector_col)
    kind = vector_type(vectors, vector_col)
    empty = "query_id long, rank int, vec_id long, score double"
    if d is None:
        return spark.createDataFrame([], empty)
    got = rows.orderBy(F.xxhash64("vec_id", F.lit(p.seed)), "vec_id").limit(p.max_sample).toArrow()
    sample_ids, once = np.unique(got.column("vec_id").to_numpy(), return_index=True)
    sample = _matrix(got.column("v"), d)[once]
    index = fit(sample, rows.count(), p)
    pick = np.random.default_rng(p.seed).permutation(len(sample))[: p.floor_sample]
    index.sample, index.sample_ids, index.sample_lists = sample[pick], sample_ids[pick], _nearest(sample[pick], index.centroids)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches):
        for b in batches:
            own = _nearest(_matrix(b.column("v"), d), shared.value.centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(own.astype(np.int32)), b.column("v")], ["vec_id", "list", "v"])

    listed = scratch.write(rows.mapInArrow(assign, f"vec_id long, list int, v {kind}"), "lists")
    lists = len(index.centroids)
    index.sizes = np.zeros(lists, np.int64)
    for r in listed.groupBy("list").count().collect():  # at most max_lists rows
        index.sizes[r.list] = r["count"]
    routing = spark.sparkContext.broadcast(index)

    def probe(q):
        """Each query's lists, nearest first, and how many of them it probes."""
        ix = routing.value
        near = np.argsort(-(q @ ix.centroids.T), axis=1, kind="stable")
        enough = np.cumsum(ix.sizes[near], axis=1) > 50 * p.k
        stop = np.where(enough.any(1), enough.argmax(1) + 1, lists)
        return near, np.maximum(stop, ix.probes)

    def start(b):
        q = _matrix(b.column("v"), d)
        near, stop = probe(q)
        probed = np.zeros(near.shape, bool)
        np.put_along_axis(probed, near, np.arange(lists)[None, :] < stop[:, None], 1)
        return near, stop, *floors(q, b.column("vec_id").to_numpy(), probed, routing.value, p.k)

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            near, stop, floor, *_ = start(b)
            for lo in range(0, b.num_rows, 256):
                rows_, cols = np.nonzero(np.arange(lists)[None, :] < stop[lo : lo + 256, None])
                rows_ += lo
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(pa.array(rows_)), pa.array(near[rows_, cols].astype(np.int32)), b.column("v").take(pa.array(rows_)), pa.array(floor[rows_])], ["vec_id", "list", "v", "floor"]
                )

    def sampled(batches):
        for b in batches:
            if b.num_rows:
                *_, j, i, score = start(b)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(j)), pa.array(i), pa.array(score)], ["query_id", "vec_id", "score"])

    queries = listed.where(is_query).select("vec_id", "v")
    asked = queries.mapInArrow(route, f"vec_id long, list int, v {kind}, floor double")
    counts = asked.groupBy("list").agg(F.count("*").alias("q"))
    index.queries = np.zeros(lists, np.int64)
    for r in counts.collect():
        index.queries[r.list] = r.q
    blocks = spark.createDataFrame(
        [(k, int(-(-index.sizes[k] // p.block)), int(-(-index.queries[k] // p.block))) for k in range(lists)], "list int, nv int, nq int"
    )
    blocks = F.broadcast(blocks.where("nv > 0 and nq > 0"))
    h = F.xxhash64("vec_id", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = listed.join(blocks, "list").select("list", F.pmod(h, "nv").cast("int").alias("i"), every("nq").alias("j"), F.lit(0).alias("side"), "vec_id", "v", F.lit(0.0).alias("floor"))
    ask = asked.join(blocks, "list").select("list", every("nv").alias("i"), F.pmod(h, "nq").cast("int").alias("j"), F.lit(1).alias("side"), "vec_id", "v", "floor")

    def run(table):
        t = table.combine_chunks()
        side, ids, x, floor = t.column("side").to_numpy(), t.column("vec_id").to_numpy(), _matrix(t.column("v"), d), t.column("floor").to_numpy()
        xb, qb = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = [[], [], []]
        if len(xb):
            for lo in range(0, len(qb), 512):
                q = qb[lo : lo + 512]
                j, i, s = scan(x[xb], ids[xb], x[q], ids[q], floor[q], shared.value.rotation, p)
                for out, v in zip(found, (ids[q][j], ids[xb][i], s), strict=True):
                    out.append(v)
        cols = [np.concatenate(c) if c else np.zeros(0) for c in found]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    best = base.unionByName(ask).groupBy("list", "i", "j").applyInArrow(run, "query_id long, vec_id long, score double")
    best = best.unionByName(queries.mapInArrow(sampled, "query_id long, vec_id long, score double"))
    once = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
