"""Near-duplicate documents by SetSketch registers, banding, joint estimation and exact checks.

A document's set is its distinct k-word shingles (ASCII lower case, words split at ASCII white
space); with fewer words, the whole sequence is its one shingle. Two documents are linked if the
Jaccard similarity of their sets is at least ``threshold``; a component is what links reach.

* Registers: the minimum of exponential variables over a set, kept as a truncated exponent to
  base ``base``. They merge by maximum and agree with probability close to the Jaccard
  similarity. Bands of ``rows`` registers make candidates; a pair at the threshold shares no
  band with probability (1 - threshold**rows)**bands, 3e-6 as set.
* Documents with equal sets are one class, so copies never meet in pairs. In each band bucket,
  every class is compared with one hub, the class found in the fullest buckets, so a group of
  near copies costs a star. The members of a hub that no link has joined to its largest
  component are then compared with all its members, exactly and in blocks that emit links only;
  no candidate of a bucket is left out.
* A star candidate goes to the exact check unless the joint likelihood of both sketches puts its
  similarity more than ``margin`` below the threshold (about 6 standard errors).

Nulls and odd rows: a null or blank text has an empty set and is linked with nothing; a null
doc_id takes no part, its component is null and it is kept. Repeated rows each get a result row.
Rows are told apart by id and text, so an id with several texts is in the component of each of them, by the row.
Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import textscan
from brindle.llm.tables import Scratch, connected_components, possibly_in, without

_rng = np.random.default_rng(77)


@dataclass(frozen=True)
class Params:
    words: int = 4
    threshold: tuple[int, int] = (80, 100)
    rows: int = 4
    bands: int = 24
    base: float = 1.001
    limit: int = 65534
    margin: float = 0.24
    block: int = 1024
    weight: int = 1_000_000

    @property
    def registers(self) -> int:
        return self.rows * self.bands


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(4242).integers(0, 2**64, (2, 4096), dtype=np.uint64)[:, :n] | np.array([[1], [0]], np.uint64)


def registers(hashes: np.ndarray, begin: np.ndarray, p: Params) -> np.ndarray:
    """SetSketch registers of each non-empty run begin[i]:begin[i + 1], as uint16; repeated hashes change nothing."""
    some = np.flatnonzero(np.diff(begin) > 0)
    out = np.zeros((len(begin) - 1, p.registers), np.uint16)
    if not len(some):
        return out
    mul, add = _multipliers(p.registers)
    at = begin[some]
    low = np.empty((len(some), p.registers), np.uint64)
    for r in range(p.registers):
        low[:, r] = np.minimum.reduceat(hashes * mul[r] + add[r], at)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64)
    k = np.floor(1 - np.log(x) / np.log(p.base))
    # exponents below zero are truncated; the offset centres them for sets up to about e**32
    out[some] = np.clip(k + p.limit // 2 - 1, 0, p.limit + 1).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def joint_jaccard(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs from their registers and set sizes."""
    m = ra.shape[1]
    more, less = (ra > rb).sum(1), (ra < rb).sum(1)
    u = (na / (na + nb)).astype(np.float64)[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0.0, 1.0, 201)[None, :]

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (base - 1) / base) / np.log(base)

    plus, minus = p(u - v * j), p(v - u * j)
    same = np.clip(1 - plus - minus, 1e-12, 1)
    score = more[:, None] * np.log(plus) + less[:, None] * np.log(minus) + (m - more - less)[:, None] * np.log(same)
    return j[np.arange(len(j)), score.argmax(1)]


def _sets(column, words: int):
    """For each text, its sorted distinct shingle hashes."""
    for _, _, raw, at in textscan.blocks(column):
        w = textscan.words(textscan.lower_ascii(raw), at)
        h, begin = textscan.shingles(w.hashes, w.first, words)
        for d in range(len(at) - 1):
            yield np.unique(h[begin[d] : begin[d + 1]])


def sketch(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (null: empty), the registers, packed by band, and the row's key."""

    def run(batches):
        for b in batches:
            sizes, f1, f2, bands = [], [], [], []
            for i, j, raw, at in textscan.blocks(b.column("text"), 400_000):
                w = textscan.words(textscan.lower_ascii(raw), at)
                h, begin = textscan.shingles(w.hashes, w.first, p.words)
                sets = [np.unique(h[begin[d] : begin[d + 1]]) for d in range(j - i)]
                n = np.array([len(s) for s in sets])
                flat = np.concatenate(sets) if sets else h
                begin = np.concatenate([[0], np.cumsum(n)])
                regs = registers(flat, begin, p)
                sums = []
                for c in (0x9FB21C651E98DF25, 0xA0761D6478BD642F):
                    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textscan.mix(flat ^ np.uint64(c)), dtype=np.uint64)])
                    sums.append((s[begin[1:]] - s[begin[:-1]]).view(np.int64))
                sizes.append(n)
                f1.append(np.ma.array(sums[0], mask=n == 0))
                f2.append(np.ma.array(sums[1], mask=n == 0))
                bands.append(regs.view(np.int64))
            if not sizes:
                continue
            mask = np.concatenate([np.ma.getmaskarray(x) for x in f1])
            flat = np.concatenate(bands).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, p.bands, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate([x.data for x in f1]), mask=mask), pa.array(np.concatenate([x.data for x in f2]), mask=mask), lists, b.column("key")],
                ["doc_id", "n_shingles", "f1", "f2", "bands", "key"],
            )

    if p.rows != 4:
        raise ValueError("a band is packed into one long of four 16-bit registers")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row_key().alias("key"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, key long")


def _row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def _plausible(pairs: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """Of the pairs (a, b), those that the joint likelihood doesn't rule out."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("bands").alias(f"bands_{x}"), F.col("n").alias(f"n_{x}"))
    least = p.threshold[0] / p.threshold[1] - p.margin

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            regs = [np.frombuffer(np.ascontiguousarray(t.column(f"bands_{x}").flatten().to_numpy(zero_copy_only=False)), np.uint16).reshape(t.num_rows, -1) for x in "ab"]
            na, nb = (t.column(f"n_{x}").to_numpy(zero_copy_only=False).astype(np.float64) for x in "ab")
            keep = pa.array(joint_jaccard(*regs, na, nb, p.base) >= least)
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], ["a", "b"])

    size_ok = (F.least("n_a", "n_b") * p.threshold[1]) >= (F.greatest("n_a", "n_b") * p.threshold[0])
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(size_ok)
    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the threshold."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))

    def run(batches):
        for t in batches:
            keep = []
            for i, j, _, _ in textscan.blocks(t.column("text_a"), 1_000_000):
                sub = t.slice(i, j - i)
                for x, y in zip(_sets(sub.column("text_a"), p.words), _sets(sub.column("text_b"), p.words), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(p.threshold[1] * both >= p.threshold[0] * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def block_links(left: list[np.ndarray], right: list[np.ndarray], left_comp: np.ndarray, right_comp: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """Exact links between two blocks of sets of different components; for each left set one link to each component."""
    sizes = np.array([len(s) for s in right])
    h = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    found = []
    for i, s in enumerate(left):
        lo, hi = np.searchsorted(h, s, "left"), np.searchsorted(h, s, "right")
        n = hi - lo
        if not n.any():
            continue
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(right))
        ok = (p.threshold[1] * both >= p.threshold[0] * (len(s) + sizes - both)) & (right_comp != left_comp[i])
        at = np.flatnonzero(ok)
        found.extend((i, int(j)) for j in at[np.unique(right_comp[at], return_index=True)[1]])
    return found


def dealt(placed: DataFrame, p: Params) -> DataFrame:
    """The sides of all blocks: hub, rep, comp, n, side (0: left), i and j, from the members (hub, rep, comp, n) of each hub; n is the set's size.

    The members outside a hub's largest component stand on the left, all its members on the right. They are dealt by
    hash into as many blocks as keep a side at about ``p.block`` sets and ``p.weight`` shingles, so long texts don't fill a task.
    """
    sizes = placed.groupBy("hub", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    groups = sizes.groupBy("hub").agg(F.max_by(F.struct("comp", "k", "n"), F.struct("k", "comp")).alias("main"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("many"))
    many = lambda k, n: F.greatest(F.ceil(k / p.block), F.ceil(n / p.weight))
    groups = groups.where("many > 1").select("hub", F.col("main.comp").alias("main"), many(F.col("k"), F.col("n")).alias("right"), many(F.col("k") - F.col("main.k"), F.col("n") - F.col("main.n")).alias("left"))
    rows = placed.join(groups, "hub").withColumn("h", F.xxhash64("rep"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    right = rows.select("hub", "rep", "comp", "n", F.lit(1).alias("side"), every("left").alias("i"), F.pmod("h", "right").alias("j"))
    left = rows.where("comp <> main").select("hub", "rep", "comp", "n", F.lit(0).alias("side"), F.pmod("h", "left").alias("i"), every("right").alias("j"))
    return left.unionByName(right)


def _remaining(members: DataFrame, comp: DataFrame, sizes: DataFrame, texts: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """Exact links (a, b) between the members of each hub (hub, rep) that stand in different components.

    In each group the members outside the largest component meet all members, in blocks; blocks are
    dealt out singly and small groups share tasks.
    """
    placed = members.join(comp, members.rep == comp.node, "left").select("hub", "rep", F.coalesce("component", "rep").alias("comp"))
    placed = scratch.write(placed.join(sizes, "rep"), "members")
    both = scratch.write(dealt(placed, p), "blocks")
    rows, shingles = both.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(1, -(-rows // (2 * p.block)), -(-shingles // (2 * p.weight)))
    both = both.drop("n").withColumn("task", F.pmod(F.xxhash64("hub", "i", "j"), F.lit(tasks))).join(texts.withColumnRenamed("id", "rep"), "rep")

    def run(table):
        found = []
        t = table.combine_chunks()
        cols = {c: t.column(c).to_numpy() for c in ("hub", "i", "j", "side", "rep", "comp")}
        order = np.lexsort((cols["side"], cols["j"], cols["i"], cols["hub"]))
        cols = {c: v[order] for c, v in cols.items()}
        cut = np.flatnonzero((np.diff(cols["hub"]) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0)) + 1
        text = t.column("text").take(pa.array(order))
        for lo, hi in zip([0, *cut], [*cut, len(order)], strict=True):
            mid = lo + int((cols["side"][lo:hi] == 0).sum())
            if mid in (lo, hi):
                continue
            sets = list(_sets(text.slice(lo, hi - lo), p.words))
            for x, y in block_links(sets[: mid - lo], sets[mid - lo :], cols["comp"][lo:mid], cols["comp"][mid:hi], p):
                found.append((int(cols["rep"][lo + x]), int(cols["rep"][mid + y])))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return both.groupBy("task").applyInArrow(run, "a long, b long")


def components(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of ``docs`` (columns doc_id, text)."""
    return _components(docs, p).drop("key")


def _components(docs: DataFrame, p: Params) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    sk = scratch.write(sketch(docs, p), "sketch")
    full = sk.where("f1 is not null and doc_id is not null")
    # a class is a node of its own, by number: an id may stand for several texts. Its first row stands for it.
    grouped = full.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "key")).alias("one"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.write(grouped.select("f1", "f2", F.col("one.doc_id").alias("first_id"), F.col("one.key").alias("key"), "n", "bands", F.monotonically_increasing_id().alias("rep")), "classes")
    banded = classes.select("rep", F.posexplode("bands").alias("i", "v")).select("rep", F.xxhash64("i", "v").alias("bucket"))
    many = banded.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    multi = scratch.write(banded.join(many, "bucket"), "buckets")
    weight = multi.groupBy("rep").agg(F.sum(F.log2("c")).alias("w"))
    hubs = multi.join(weight, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("w", -F.col("rep"))).alias("hub"))
    members = scratch.write(multi.join(hubs, "bucket").where("rep <> hub").select("hub", "rep").distinct(), "stars")
    stars = members.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    need = classes.join(stars.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep").select("key", "rep", "n")
    need = scratch.write(need, "need")
    rows = possibly_in(docs.select(_row_key().alias("key"), "text"), need, "key")
    # an inner join with distinct keys: a semi join would be pushed below the bitmap's
    texts = rows.join(need.drop("n"), "key").groupBy(F.col("rep").alias("id")).agg(F.min("text").alias("text"))
    texts = scratch.write(texts, "texts")
    links = scratch.write(_verified(_plausible(stars, classes, p), texts, p), "links")
    comp = scratch.write(connected_components(links, scratch), "components")
    more = _remaining(members, comp, need.drop("key"), texts, p, scratch)
    comp = scratch.write(connected_components(links.union(more), scratch), "components")
    placed = classes.select("f1", "f2", "first_id", "rep").join(comp, classes.rep == comp.node, "left").select("f1", "f2", "first_id", "component")
    label = placed.where("component is not null").groupBy("component").agg(F.min("first_id").alias("label"))
    rep_of = scratch.write(placed.join(label, "component", "left").select("f1", "f2", F.coalesce("label", "first_id").alias("component_id")), "labels")
    scratch.drop_all_but(sk, rep_of)
    out = sk.select("doc_id", "key", "n_shingles", "f1", "f2").join(rep_of, ["f1", "f2"], "left")
    found = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "key", "n_shingles", found.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, p: Params = Params(words=5)) -> DataFrame:
    """``docs`` without all but the rows of the smallest doc_id of each component; exactly repeated rows of an id become one.

    Shingles have five words, the measure of near-duplicate stages; the query op4 has its own, of four.
    """
    key = "_row"
    while key in docs.columns:
        key += "_"
    rows = docs.withColumn(key, _row_key())
    gone = _components(docs.select("doc_id", "text"), p).where("not kept").select(F.col("key").alias(key)).distinct()
    gone = Scratch(docs.sparkSession).write(gone, "gone")
    rest = without(rows, gone, key)
    twice = rows.where("doc_id is not null").groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    again = possibly_in(rest.where("doc_id is not null"), twice, key).dropDuplicates([key])
    other = possibly_in(rest.where("doc_id is not null"), twice, key, inverse=True)
    return other.unionByName(again).unionByName(rest.where("doc_id is null")).select(*docs.columns)
