"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every byte is removed that a ``length``-byte string covers which also starts elsewhere in the
corpus. Texts are UTF-8 bytes; strings never cross texts.

1. Regions. Each window of ``length`` bytes selects the ``gram``-byte substring with the smallest
   hash (leftmost of equals), so equal windows select equal grams at equal offsets. The windows of
   one gram's place are consecutive; their bytes are a region, aligned at the gram. Grams that occur
   once are dropped: their hashes are counted in one aggregation and the repeated ones marked
   in a bitmap of fixed size.
2. Shards. A task orders the suffixes of its regions (those of texts of about ``shard_bytes`` at a time), aligned
   column by aligned column: from the last column to the first, each round passes over the order and deals
   the rows out to the buckets of their byte in that column (the Burrows-Wheeler step, by one
   counting pass). Rows in the same bucket keep their order, and the common prefix of neighbours
   grows; where a bucket begins, it is cut. No suffix is ever compared or sorted.
   Regions equal from end to end stand next to each other at their first column; one of them goes on, and all of
   them are repeats.
3. Merge. The shards' regions of a gram meet in one task, as an interleave in shard order, which is refined
   by the same rounds. At a column where windows begin, an interval of two or more rows with a common prefix
   of ``length`` bytes is a repeat.

A task holds about ``task_rows`` regions of whole grams. A gram with more than ``most_rows`` different
regions (or a millionth of all, if that is more) has its windows counted by 64-bit hash instead, which needs no meeting
in one task; this is the exact way for grams that no task could hold.

Nulls count as empty texts. Null ids and repeated rows are texts like others, each with a result
row; a repeated row of at least ``length`` bytes is therefore removed whole. Empty tables give an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import textscan
from brindle.llm.tables import Scratch, possibly_in

_U = np.uint64


@dataclass(frozen=True)
class Params:
    length: int = 400
    gram: int = 64
    shard_bytes: int = 40_000_000
    task_rows: int = 30_000
    most_rows: int = 250_000
    bits: int = 1 << 26


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    n = len(values)
    if n < w:
        return values[:0]
    pad = -n % w
    v = np.concatenate([values, np.full(pad, ~_U(0))]).reshape(-1, w)
    left = np.minimum.accumulate(v, axis=1).ravel()
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def regions(raw: np.ndarray, at: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """Document number, place, gram hash, and first and last column (exclusive) of the regions of a block of texts.

    Columns count from the gram's place; a region holds the windows that selected it and nothing else.
    """
    empty = np.zeros(0, np.int64)
    if len(raw) < p.length:
        return empty, empty, empty.view(_U), empty, empty
    s = textscan.prefix_sums(raw)
    i = np.arange(len(raw) - p.gram + 1)
    h = textscan.span_hashes(s, i, i + p.gram)
    low = window_minima((h & ~_U(0xFFFFFFFF)) | i.astype(_U), p.length - p.gram + 1)
    starts = np.arange(len(low))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(low)]
    inside = np.flatnonzero(starts + p.length <= at[doc + 1])
    if not len(inside):
        return empty, empty, empty.view(_U), empty, empty
    place, doc = (low[inside] & _U(0xFFFFFFFF)).astype(np.int64), doc[inside]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([new[1:], [len(inside)]]) - 1
    pos, doc = place[new], doc[new]
    return doc, pos - at[doc], h[pos], inside[new] - pos, inside[last] + p.length - pos


@dataclass
class Repeats:
    """Of each row: its first and last repeated window (columns; none: first > last), and whether an equal row stands before or after it."""

    first: np.ndarray
    last: np.ndarray
    copy: np.ndarray
    twin: np.ndarray
    rounds: int = 0


def refine(raw: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> Repeats:
    """Repeated windows of the rows ``raw[at + lo : at + hi]``, aligned at ``at``, by dealing the rows out column by column.

    The order of the rows at column c is that of their suffixes from c on. ``end[k]`` is the column at which the
    suffixes of the k-th row and of the one before it part. A row enters in front of all at its last column,
    and leaves after its first, or once no other row shares enough with it.
    """
    n = len(at)
    out = Repeats(np.ones(n, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n, bool))
    if not n:
        return out
    out.first[:] = 1 << 30
    out.last[:] = -(1 << 30)
    entry = np.argsort(-hi, kind="stable").astype(np.int32)
    upto = np.searchsorted(-hi[entry], -np.arange(int(hi.max()) + 1), "right")  # rows that end at a column or after it
    order, end, came = np.zeros(0, np.int32), np.zeros(0, np.int32), 0
    for c in range(int(hi.max()) - 1, int(lo.min()) - 1, -1):
        more = int(upto[c + 1]) if c >= 0 else n
        if more > came:
            order = np.concatenate([entry[came:more], order])
            end = np.concatenate([np.full(more - came, c + 1, np.int32), end])
            if came < len(order) and len(order) > more - came:
                end[more - came] = c + 1
            came = more
        if not len(order):
            continue
        out.rounds += 1
        byte = raw[at[order] + c]
        turn = np.argsort(byte, kind="stable")  # a counting pass over one byte a row
        byte = byte[turn]
        cut = byte[1:] != byte[:-1]
        jump = np.flatnonzero((turn[1:] != turn[:-1] + 1) & ~cut)
        dealt = end[turn]
        if len(jump):
            span = np.empty(2 * len(jump), np.int64)
            span[::2], span[1::2] = turn[jump] + 1, turn[jump + 1] + 1
            dealt[jump + 1] = np.minimum.reduceat(np.append(end, np.int32(0)), span)[::2]
        dealt[1:][cut] = c
        dealt[0] = c
        order, end = order[turn], dealt
        if c > 0:
            continue
        best = np.maximum(end, np.append(end[1:], np.int32(c)))
        found = order[best >= c + length]
        out.first[found] = c
        out.last[found] = np.maximum(out.last[found], c)
        first = lo[order]
        leaves = first == c
        if leaves.any():
            k = np.flatnonzero(leaves[1:] & leaves[:-1] & (end[1:] == hi[order[1:]]) & (hi[order[1:]] == hi[order[:-1]])) + 1
            out.copy[order[k]] = True
            out.twin[order[k]] = out.twin[order[k - 1]] = True
        stay = np.flatnonzero(~leaves & (best >= first + length))
        if len(stay) < len(order):
            if len(stay):
                end = np.minimum.reduceat(end[: stay[-1] + 1], np.concatenate([[0], stay[:-1] + 1]))
            else:
                end = end[:0]
            order = order[stay]
    return out


def _batch(names, types, cols):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _shards(docs: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """One row for each different region of a repeated gram in a shard, and the spans (bytes null, lo their length) of regions that a shard holds twice."""

    def grams(batches):
        for b in batches:
            for _, _, raw, at in textscan.blocks(b.column("text"), 300_000):
                gram, n = np.unique(regions(raw, at, p)[2], return_counts=True)
                yield _batch(["gram", "n"], [pa.int64(), pa.int64()], [gram.view(np.int64), n])

    seen = docs.mapInArrow(grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    place = F.pmod("gram", F.lit(p.bits)) + 1
    marks = seen.select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("b")).groupBy("k").agg(F.bitmap_construct_agg("b").alias("bits"))
    bitmap = np.zeros(-(-p.bits // 32768) * 4096, np.uint8)
    for r in marks.toLocalIterator():  # at most bits / 32768 rows of 4 KB, however many grams there are
        bitmap[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def transform(batches):
        marked = shared.value
        blocks: list[np.ndarray] = []  # the texts of blocks with marked grams; regions are places in them
        held: list[tuple[np.ndarray, ...]] = []
        size = rows = 0

        def flush():
            text = np.concatenate(blocks)
            uid, begin, gram, lo, hi, at = (np.concatenate(x) for x in zip(*held, strict=True))
            blocks.clear()
            held.clear()
            _, which, count = np.unique(gram, return_inverse=True, return_counts=True)
            some = np.flatnonzero(count[which] > 1)
            got = refine(text, at[some], lo[some], hi[some], p.length)
            sent = np.ones(len(gram), bool)
            sent[some[got.copy]] = False
            twin = some[got.twin]
            yield _batch(names, types, [np.zeros(len(twin), np.int64), uid[twin], begin[twin], (hi - lo)[twin], [None] * len(twin)])
            sent = np.flatnonzero(sent)
            for k in range(0, len(sent), 8000):
                part = sent[k : k + 8000]
                data = [text[a:z].tobytes() for a, z in zip((at + lo)[part].tolist(), (at + hi)[part].tolist(), strict=True)]
                yield _batch(names, types, [gram[part].view(np.int64), uid[part], begin[part], lo[part], data])

        for b in batches:
            own = b.column("uid").to_numpy()
            for i, _, raw, at in textscan.blocks(b.column("text"), 300_000):
                doc, pos, gram, lo, hi = regions(raw, at, p)
                k = np.mod(gram.view(np.int64), p.bits)
                hit = np.flatnonzero((marked[k >> 3] >> (k & 7).astype(np.uint8)) & 1)
                if not len(hit):
                    continue
                doc, pos, gram, lo, hi = (x[hit] for x in (doc, pos, gram, lo, hi))
                held.append((own[i + doc], pos + lo, gram, lo, hi, size + at[doc] + pos))
                blocks.append(raw)
                size += len(raw)
                rows += len(hit)
                if size + 256 * rows >= p.shard_bytes:
                    yield from flush()
                    size = rows = 0
        if held:
            yield from flush()

    names, types = ["gram", "uid", "begin", "lo", "bytes"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return scratch.write(docs.mapInArrow(transform, "gram long, uid long, begin long, lo int, bytes binary"), "shards")


def repeated_spans(docs: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """uid, start, end of stretches to remove; stretches of one uid may overlap. ``docs`` has uid and text."""
    if not 0 < p.gram < p.length:
        raise ValueError("length must exceed gram")
    shards = _shards(docs, p, scratch)
    twins = shards.where("bytes is null").select("uid", F.col("begin").alias("start"), (F.col("begin") + F.col("lo")).alias("end"))
    rows = shards.where("bytes is not null")
    count = rows.select("gram").count()
    most = max(p.most_rows, count // 1_000_000)
    hot = [r.gram for r in rows.groupBy("gram").count().where(F.col("count") > most).collect()]  # at most a million longs, by ``most``
    is_hot = F.col("gram").isin(hot) if len(hot) < 1000 else None
    if is_hot is None:
        marked = docs.sparkSession.createDataFrame([(g,) for g in hot], "gram long")
        few, many = rows.join(F.broadcast(marked), "gram", "left_anti"), rows.join(F.broadcast(marked), "gram", "left_semi")
    else:
        few, many = rows.where(~is_hot), rows.where(is_hot)
    tasks = max(1, -(-count // p.task_rows))

    def merge(table):
        t = table.combine_chunks()
        raw, at = textscan.string_buffers(t.column("bytes"))
        lo = t.column("lo").to_numpy().astype(np.int64)
        got = refine(raw, at[:-1] - lo, lo, np.diff(at) + lo, p.length)
        k = np.flatnonzero(got.first <= got.last)
        uid, zero = t.column("uid").to_numpy()[k], (t.column("begin").to_numpy() - lo)[k]
        return pa.table({"uid": uid, "start": zero + got.first[k], "end": zero + got.last[k] + p.length})

    merged = few.withColumn("task", F.pmod(F.xxhash64("gram"), F.lit(tasks))).groupBy("task").applyInArrow(merge, "uid long, start long, end long")
    if not hot:
        return twins.unionByName(merged)

    def windows(batches):
        for b in batches:
            raw, at = textscan.string_buffers(b.column("bytes"))
            s = textscan.prefix_sums(raw)
            for r in range(b.num_rows):
                i = np.arange(int(at[r + 1] - at[r]) - p.length + 1)
                h = textscan.span_hashes(s, at[r] + i, at[r] + i + p.length).view(np.int64)
                yield _batch(["window", "uid", "start"], [pa.int64()] * 3, [h, np.full(len(i), b.column("uid")[r].as_py()), b.column("begin")[r].as_py() + i])

    cut = many.mapInArrow(windows, "window long, uid long, start long")
    again = cut.groupBy("window").agg(F.count("*").alias("c")).where("c > 1")
    counted = cut.join(again, "window", "left_semi").select("uid", "start", (F.col("start") + p.length).alias("end"))
    return twins.unionByName(merged).unionByName(counted)


def _kept(batches):
    for b in batches:
        out = [[], [], [], []]
        for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            runs: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in spans or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append([*s])
            keep, at = [], 0
            for a, e in runs:
                keep.append(raw[at:a])
                at = e
            keep.append(raw[at:])
            rest = b"".join(keep)
            for c, v in zip(out, (len(raw), len(raw) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document (columns doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("uid"))
    spans = repeated_spans(rows.select("uid", "text"), p, scratch)
    by_doc = scratch.write(spans.distinct().groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    scratch.drop_all_but(by_doc)
    keys = by_doc.select("uid")
    maybe = possibly_in(rows, keys, "uid").join(by_doc, "uid", "left")
    rest = possibly_in(rows, keys, "uid", inverse=True).withColumn("spans", F.lit(None).cast(by_doc.schema["spans"].dataType))
    both = maybe.select("doc_id", "text", "spans").unionByName(rest.select("doc_id", "text", "spans"))
    return both.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
