"""Benchmark passages in documents, by SimHash of item-sized windows and exact verification.

Texts are compared as lower-case words (runs of ASCII letters and digits and of all bytes above
0x7F) in shingles of ``words`` words, weighted by how often they occur. For an item of m shingles
every window of m consecutive shingles of a document is a candidate place.

1. Gate: a window as similar as the threshold shares a shingle with its item, so windows without
   one are not fingerprinted. Nothing that could qualify is lost here.
2. SimHash: 256 sums of signs over a window's shingles, from running sums. A fingerprint is 8 blocks
   of 32 bits; two within the radius of 63 agree in at least one block up to 7 bits, and in that block
   in at least one byte up to 1 bit. The items of each size stand in one table a byte, under all values within 1 bit of
   theirs; a lookup goes on to the block's distance and then to the whole one, so it returns every
   item within the radius, and about 0.8 % of unrelated pairs get past the blocks. At the threshold (0.8
   weighted Jaccard) the expected distance is 38.7 bits with standard deviation 5.7.
3. Verification: the weighted Jaccard similarity (sum of minima over sum of maxima of counts).

The benchmark is held in each task in groups of items whose texts have at most ``group_bytes``;
a larger benchmark is searched group by group, each over all documents. Documents are read
where they lie, without a shuffle.

Null or blank texts and items match nothing; a text of fewer than ``words`` words has one
shingle, all its words. Repeated document rows give repeated results; items with equal texts each
give a row. A null doc_id or item_id is returned as null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import textscan
from brindle.llm.tables import Scratch, without

_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


@dataclass(frozen=True)
class Params:
    words: int = 5
    threshold: float = 0.8
    radius: int = 63
    group_bytes: int = 16_000_000


WORDS = 4  # of 64 bits
BLOCKS = 8  # of 32 bits
_SALT = np.array([0, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F], np.uint64)


def _signs(h: np.ndarray) -> np.ndarray:
    wide = textscan.mix(h[:, None] ^ _SALT[None, :])
    return np.unpackbits(wide.view(np.uint8).reshape(len(h), 8 * WORDS), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def fingerprints(h: np.ndarray, m: int, starts: np.ndarray) -> np.ndarray:
    """SimHash, as rows of 64-bit words, of the windows of m shingles (or all that there are) at ``starts``."""
    lo, hi = int(starts.min()), min(int(starts.max()) + m, len(h))
    run = np.zeros((hi - lo + 1, 64 * WORDS), np.int32)
    np.cumsum(_signs(h[lo:hi]), axis=0, out=run[1:])
    sums = run[np.minimum(starts + m, hi) - lo] - run[starts - lo]
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)


@dataclass
class SizeClass:
    """Items of one size: their fingerprints and, for each byte, the items by the values within one bit of theirs.

    Table k lists, for value v, the places ``entries[k][first[k][v] : first[k][v + 1]]``.
    """

    items: list[int]
    prints: np.ndarray
    first: list[np.ndarray]
    entries: list[np.ndarray]

    @staticmethod
    def build(items: list[int], prints: np.ndarray) -> SizeClass:
        flips = np.concatenate([[0], 1 << np.arange(8)]).astype(np.uint8)
        first, entries = [], []
        for byte in prints.view(np.uint8).reshape(len(items), -1).T:
            values = (byte[:, None] ^ flips).ravel()
            order = np.argsort(values, kind="stable")
            first.append(np.searchsorted(values[order], np.arange(257)))
            entries.append(np.repeat(np.arange(len(items)), len(flips))[order])
        return SizeClass(items, prints, first, entries)

    def candidates(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """The (window, item position) pairs that agree in a block up to radius / BLOCKS bits."""
        least = radius // BLOCKS
        if least // 4 > 1:
            raise ValueError(f"radius above {BLOCKS * 8 - 1}")
        windows, items = prints.view(np.uint32).reshape(len(prints), -1), self.prints.view(np.uint32).reshape(len(self.items), -1)
        byte = prints.view(np.uint8).reshape(len(prints), -1)
        found = [np.zeros(0, np.int64)]
        for block in range(BLOCKS):
            near = []
            for k in range(4 * block, 4 * block + 4):
                lo, n = self.first[k][byte[:, k]], self.first[k][byte[:, k].astype(np.int64) + 1]
                n = n - lo
                w = np.repeat(np.arange(len(prints)), n)
                i = self.entries[k][np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(w))]
                ok = np.bitwise_count(windows[w, block] ^ items[i, block]) <= least
                near.append(w[ok] * len(self.items) + i[ok])
            found += near
        pair = np.unique(np.concatenate(found))
        return pair // len(self.items), pair % len(self.items)

    def within(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item position) with at most ``radius`` differing bits."""
        out = [], []
        step = max(1, 2_000_000 // len(self.items))
        for lo in range(0, len(prints), step):
            w, i = self.candidates(prints[lo : lo + step], radius)
            near = np.bitwise_count(prints[lo + w] ^ self.prints[i]).sum(1) <= radius
            out[0].append(lo + w[near])
            out[1].append(i[near])
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in out)


@dataclass
class Index:
    params: Params
    ids: list
    shingles: list[np.ndarray]
    counts: list[tuple[np.ndarray, np.ndarray]]
    classes: dict[int, SizeClass]
    keys: np.ndarray
    owners: list[np.ndarray]
    gate: np.ndarray = field(repr=False, default=None)

    @staticmethod
    def build(ids: list, texts: list[str | None], p: Params) -> Index:
        sh, owner_of = [], {}
        for d, h in enumerate(document_shingles(pa.array(texts, pa.string()), p)):
            sh.append(h)
            for s in set(h.tolist()):
                owner_of.setdefault(s, []).append(d)
        by_size: dict[int, list[int]] = {}
        for d, h in enumerate(sh):
            if len(h):
                by_size.setdefault(len(h), []).append(d)
        classes = {}
        for m, items in by_size.items():
            prints = np.concatenate([fingerprints(sh[d], m, np.zeros(1, np.int64)) for d in items])
            classes[m] = SizeClass.build(items, prints)
        keys = np.array(sorted(owner_of), np.uint64)
        gate = np.zeros(1 << 20, bool)
        gate[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return Index(p, ids, sh, [np.unique(h, return_counts=True) for h in sh], classes, keys, [np.array(owner_of[int(k)]) for k in keys], gate)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of shingles that some item has, and their places in ``keys``."""
        pos = np.flatnonzero(self.gate[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(pos) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.searchsorted(self.keys, h[pos])
        k[k == len(self.keys)] = 0
        good = self.keys[k] == h[pos]
        return pos[good], k[good]

    def similarity(self, window: np.ndarray, item: int) -> float:
        s, c = np.unique(window, return_counts=True)
        t, e = self.counts[item]
        _, x, y = np.intersect1d(s, t, assume_unique=True, return_indices=True)
        both = int(np.minimum(c[x], e[y]).sum())
        return both / (len(window) + len(self.shingles[item]) - both)

    def search(self, h: np.ndarray, pos: np.ndarray, key: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first shingle, shingles) of each item's best window, the first of equals."""
        places: dict[int, list[np.ndarray]] = {}
        for at, k in zip(pos.tolist(), key.tolist(), strict=True):
            for m in {len(self.shingles[i]) for i in self.owners[k].tolist()}:
                places.setdefault(m, []).append(at)
        best: dict[int, tuple[float, int, int]] = {}
        for m, at in places.items():
            last = max(0, len(h) - m)
            mark = np.zeros(last + 2, np.int64)
            at = np.unique(np.array(at))
            np.add.at(mark, np.clip(at - m + 1, 0, last), 1)
            np.add.at(mark, np.clip(at, 0, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            cls = self.classes[m]
            w, i = cls.within(fingerprints(h, m, starts), self.params.radius)
            for s, k in zip(starts[w].tolist(), i.tolist(), strict=True):
                item = cls.items[k]
                x = self.similarity(h[s : s + m], item)
                if x >= self.params.threshold and (item not in best or x > best[item][0]):
                    best[item] = (x, s, min(m, len(h) - s))
        return [(i, *b) for i, b in sorted(best.items())]


def document_shingles(column, p: Params):
    for _, _, raw, at in textscan.blocks(column):
        w = textscan.words(textscan.lower_ascii(raw), at, textscan.NOT_LETTER)
        h, begin = textscan.shingles(w.hashes, w.first, p.words)
        for d in range(len(at) - 1):
            yield h[begin[d] : begin[d + 1]]


def find_leaks(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: the best window of each document and item at the threshold or above.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Words count from 0.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("b")).first().b
    groups = max(1, -(-int(size) // p.group_bytes))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for g in range(groups):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(Index.build([r.item_id for r in part], [r.text for r in part], p))

        def run(batches, index=index):
            ix = index.value
            for b in batches:
                found = []
                for i, _, raw, at in textscan.blocks(b.column("text")):
                    w = textscan.words(textscan.lower_ascii(raw), at, textscan.NOT_LETTER)
                    h, begin = textscan.shingles(w.hashes, w.first, p.words)
                    pos, key = ix.hits(h)
                    if not len(pos):
                        continue
                    doc = np.searchsorted(begin, pos, "right") - 1
                    for d in np.unique(doc).tolist():
                        own = doc == d
                        for item, x, s, m in ix.search(h[begin[d] : begin[d + 1]], pos[own] - begin[d], key[own]):
                            n = min(m + p.words - 1, int(w.first[d + 1] - w.first[d]))
                            found.append((b.column("doc_id")[i + d].as_py(), ix.ids[item], x, s, n))
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)],
                    ["doc_id", "item_id", "similarity", "start_word", "n_words"],
                )

        one = rows.mapInArrow(run, "doc_id long, item_id long, similarity double, start_word long, n_words long")
        out = one if out is None else out.unionByName(one)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; rows with a null doc_id stay."""
    bad = find_leaks(docs, benchmark, p).select("doc_id").where("doc_id is not null").distinct()
    return without(docs, Scratch(docs.sparkSession).write(bad, "leaks"), "doc_id")
