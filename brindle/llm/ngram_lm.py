"""A trigram language model in Elias-Fano tries, built and queried shard by shard.

Tokens of a text are its words (ASCII lower case, split at ASCII white space) and one end; two
begin marks stand before the first token. The model interpolates by absolute discounting:
``p(w | u v) = max(c(uvw) - D, 0) / c(uv) + D T(uv) / c(uv) * p(w | v)``, the same one word shorter, and
``p1(w) = (c(w) - D1) / N``, with ``D1 V / N`` for the unknown word; c of a context counts its occurrences, T its
different successors, D is a parameter and D1 is n1 / (n1 + 2 n2) of the word counts. Where a context was never
seen, the shorter one has all the weight. Probabilities and weights are stored in 16-bit codes, rounded down.

A shard is a trie that reads contexts backwards. Level one has contexts v (sorted 64-bit hashes) and their
successors (the first 36 bits of the word's hash); level two has contexts u v under v, and their successors as places among the
successors of v, so these are small numbers. Each level's contexts, its successors and the pointers into them are
monotone (a node's range begins where the one before it ends) and kept as Elias-Fano sequences; a query finds v, then u under
it, w among the successors of v, and that place among those of u v. ``Trie.to_bytes`` is one flat buffer; shards query
theirs in a memory map.

Work is dealt without a vocabulary in any one place. Texts become chunks of about
``chunk_tokens`` tokens, a written table. A chunk sends a shard the trigrams whose middle word belongs there, as a small trie
of its own with training counts in which each word is named once, and the words; the shard adds them up, builds its trie and answers with codes in the order
asked; the chunk's scores follow. A middle word with more than N / ``hot_share`` occurrences (at most ``hot_share``
of them) is spread by the word before it, and its bigrams by their second word. Results don't depend on
the sizes of chunks and shards.

Null texts count as empty (one token, the end). A document with a null id is scored, has a null
held_out and is not learnt from. Repeated rows count and are scored each. An empty table gives an empty result;
columns other than doc_id and text are ignored. Equal 64-bit hashes
count as equal words, equal 36-bit hashes under one context as equal there.
"""

from __future__ import annotations

import mmap
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import textscan
from brindle.llm.tables import Scratch

END = np.uint64(0xE4D0000000000001)
BEGIN = np.uint64(0xBE61000000000003)
BITS = 36
_MASK = np.uint64((1 << BITS) - 1)
CODE_STEPS = 4000
# [8 b + k]: the place of the k-th bit that is not set in byte b
_SELECT0 = np.array([[*[i for i in range(8) if not b >> i & 1], *[0] * 8][:8] for b in range(256)], np.int64).ravel()
_BYTES = np.uint64(0x0101010101010101)  # times a byte: that byte eight times; times eight counts: their running sums


@dataclass(frozen=True)
class Params:
    chunk_tokens: int = 2_000_000
    shard_tokens: int = 1_500_000
    hot_share: int = 1000
    discount: float = 0.75


def to_codes(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities, rounded down; 0 stands for 0."""
    with np.errstate(divide="ignore"):
        c = 1 + np.ceil(-np.log10(np.minimum(p, 1.0)) * CODE_STEPS - 1e-9)
    return np.where(p > 0, np.clip(c, 1, 65535), 0).astype(np.uint16)


def from_codes(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, 10.0 ** (-(c.astype(np.float64) - 1) / CODE_STEPS), 0.0)


def _select0(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th bit that is not set in each 64-bit word, which has more than k of these."""
    u, k = np.uint64, k.astype(np.uint64)
    x = ~word
    x = x - ((x >> u(1)) & (_BYTES * u(0x55)))
    x = (x & (_BYTES * u(0x33))) + ((x >> u(2)) & (_BYTES * u(0x33)))
    upto = ((x + (x >> u(4))) & (_BYTES * u(0x0F))) * _BYTES
    passed = (((k * _BYTES) | (_BYTES * u(0x80))) - upto) & (_BYTES * u(0x80))  # a mark for each byte that ends before the bit
    at = np.bitwise_count(passed).astype(np.uint64) << u(3)
    k = k - (((upto << u(8)) >> at) & u(0xFF))
    return at.astype(np.int64) + _SELECT0[((((word >> at) & u(0xFF)) << u(3)) | k).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence of 64-bit values: low bits packed, high bits in unary, and the zeros before each word of these."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        n = len(values)
        span = int(values[-1]) + 1 if n else 1
        bits = max(0, (span // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits and n:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            v = values & np.uint64((1 << bits) - 1)
            np.add.at(low, word, v << shift)
            over = np.flatnonzero(shift + np.uint64(bits) > 64)
            np.add.at(low, word[over] + 1, v[over] >> (np.uint64(64) - shift[over]))
        up = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(-(-((int(up[-1]) if n else 0) + 2) // 64) * 64, np.uint8)
        marks[up] = 1
        high = np.packbits(marks, bitorder="little").view(np.uint64)
        return EliasFano(n, bits, low, high, np.cumsum(64 - np.bitwise_count(high).astype(np.int64)).astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        v = (self.low[word] >> shift) | ((self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return v & np.uint64((1 << self.low_bits) - 1)

    def _ones_before_zero(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most h; h below the number of zeros."""
        word = np.searchsorted(self.zeros, h, "right")
        left = h - np.where(word > 0, self.zeros[np.maximum(word, 1) - 1].astype(np.int64), 0)
        return word * 64 + _select0(self.high[word], left) - h

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        ones = np.arange(1, len(self.high) + 1) * 64 - self.zeros.astype(np.int64)
        word = np.searchsorted(ones, i, "right")
        left = i - np.where(word > 0, ones[np.maximum(word, 1) - 1], 0)
        top = word * 64 + _select0(~self.high[word], left) - i
        return (top.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value >= x (n if none), and whether it equals x."""
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        top = int(self.zeros[-1])
        h = x >> np.uint64(self.low_bits)
        inside = h < np.uint64(top)
        h = np.where(inside, h, np.uint64(0)).astype(np.int64)
        end = self._ones_before_zero(h)
        lo = np.where(h > 0, self._ones_before_zero(np.maximum(h, 1) - 1), 0)
        hi = end.copy()
        want = x & np.uint64((1 << self.low_bits) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            less = self._low(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        equal = inside & (lo < end)
        equal &= self._low(np.minimum(lo, self.n - 1)) == want
        return np.where(inside, lo, self.n), equal

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.uint64), self.low, self.high, self.zeros]


def _runs(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values and, in 32 bits, the place of each value among them."""
    order = np.argsort(x).astype(np.int32)
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], place


class Trie:
    """Contexts, successors and pointers of two levels as Elias-Fano sequences, with 16-bit probabilities and weights.

    ``seqs``: contexts v; successors of v; where each v's begin; contexts u v; successors of u v as places; where each context's
    places begin. ``codes``: probabilities and, a context each, weights of the shorter context, for both levels.
    """

    KINDS = (np.uint64, np.uint64, np.uint64, np.uint32)

    def __init__(self, seqs: list[EliasFano], codes: list[np.ndarray]):
        self.seqs, self.codes = seqs, codes

    @staticmethod
    def build(v: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray, discount: float) -> Trie:
        """From trigrams with counts above zero, in any order and repeated or not; u and w have ``BITS`` bits."""
        c = count.astype(np.float64)
        one, at1 = _distinct(v)
        high = at1.astype(np.uint64) << np.uint64(BITS)
        two, at2 = _distinct(high | u)
        succ, at_s = _distinct(high | w)
        above, of = (two >> np.uint64(BITS)).astype(np.int64), (succ >> np.uint64(BITS)).astype(np.int64)
        kinds1 = np.bincount(of, minlength=len(one))
        begin1 = _runs(kinds1)
        begin2 = _runs(kinds1[above])
        places, at_p = _distinct(begin2[at2] + at_s - begin1[at1])
        of2 = np.searchsorted(begin2, places, "right") - 1
        n1, n2 = np.bincount(at_s, c, len(succ)), np.bincount(at_p, c, len(places))
        total1, total2 = np.bincount(of, n1, len(one)), np.bincount(of2, n2, len(two))
        kinds2 = np.bincount(of2, minlength=len(two))
        seqs = [EliasFano.build(np.asarray(x).astype(np.uint64)) for x in (one, succ, begin1, two, places, begin2)]
        shares = [np.maximum(n1 - discount, 0) / total1[of], discount * kinds1 / total1, np.maximum(n2 - discount, 0) / total2[of2], discount * kinds2 / total2] if len(one) else [np.zeros(0)] * 4
        return Trie(seqs, [to_codes(x) for x in shares])

    def lookup(self, v: np.ndarray, node_v: np.ndarray, u: np.ndarray, pair_v: np.ndarray, w: np.ndarray, gram_node: np.ndarray, gram_pair: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes of a query trie: contexts v; contexts u under the ``node_v``-th v; successors w of the ``pair_v``-th v; trigrams as pairs of these.

        Returns weights of v, probabilities of w after v, weights of u v, probabilities of the trigrams; 0 for unknown
        successors, the code of 1 for unknown contexts.
        """
        one, succ, begin1, two, places, begin2 = self.seqs
        p1, b1, p2, b2 = self.codes
        whole = to_codes(np.ones(1))[0]

        def pick(codes, at, ok, other):
            return np.where(ok, codes[np.minimum(at, max(len(codes) - 1, 0))], other).astype(np.uint16) if len(codes) else np.full(len(at), other, np.uint16)

        r1, ok1 = one.successor(v)
        r1 = np.where(ok1, r1, 0).astype(np.uint64)
        r2, ok2 = two.successor((r1[node_v] << np.uint64(BITS)) | u)
        s, ok_s = succ.successor((r1[pair_v] << np.uint64(BITS)) | w)
        ok2, ok_s = ok2 & ok1[node_v], ok_s & ok1[pair_v]
        found = np.flatnonzero(ok2[gram_node] & ok_s[gram_pair])
        code = np.zeros(len(gram_node), np.uint16)
        if len(found):
            node, pair = gram_node[found], gram_pair[found]
            place = begin2[r2[node]] + s[pair].astype(np.uint64) - begin1[r1[pair_v[pair]].astype(np.int64)]
            at, ok = places.successor(place)
            code[found] = pick(p2, at, ok, 0)
        return pick(b1, r1.astype(np.int64), ok1, whole), pick(p1, s, ok_s, 0), pick(b2, r2, ok2, whole), code

    def to_bytes(self) -> bytes:
        parts = [x for ef in self.seqs for x in ef.parts()] + self.codes
        head = np.array([len(parts), *[x.nbytes for x in parts]], np.uint64).tobytes()
        return head + b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in parts)

    @staticmethod
    def open(buffer) -> Trie:
        """Over a bytes-like object, such as a memory map of a file that holds ``to_bytes``; nothing is copied."""
        raw = np.frombuffer(buffer, np.uint8)
        n = int(raw[:8].view(np.uint64)[0])
        sizes = raw[8 : 8 + 8 * n].view(np.uint64).astype(np.int64)
        at, parts = 8 + 8 * n, []
        for k, size in enumerate(sizes):
            kind = Trie.KINDS[k % 4] if k < n - 4 else np.uint16
            parts.append(raw[at : at + size].view(kind))
            at += int(size + (-size % 8))
        seqs = [EliasFano(int(parts[k][0]), int(parts[k][1]), *parts[k + 1 : k + 4]) for k in range(0, n - 4, 4)]
        return Trie(seqs, parts[n - 4 :])

    def mapped(self) -> Trie:
        """The same in a memory map."""
        data = self.to_bytes()
        memory = mmap.mmap(-1, len(data))
        memory.write(data)
        return Trie.open(memory)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, byte plane by byte plane, compressed; those of 64 bits called for in ``_unpack`` with 5 bytes lose their upper three."""
    planes = []
    for a in arrays:
        a, width = a if isinstance(a, tuple) else (a, a.itemsize)
        planes.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1)[:, :width].T.tobytes() if len(a) else b"")
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(blob: bytes, *layout: tuple[type, int] | tuple[type, int, int]) -> list[np.ndarray]:
    width = [x[2] if len(x) > 2 else np.dtype(x[0]).itemsize for x in layout]
    size = sum(b * x[1] for b, x in zip(width, layout, strict=True))
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for b, x in zip(width, layout, strict=True):
        wide = np.zeros((x[1], np.dtype(x[0]).itemsize), np.uint8)
        wide[:, :b] = raw[at : at + b * x[1]].reshape(b, x[1]).T
        out.append(wide.view(x[0]).ravel())
        at += b * x[1]
    return out


def _chunks(docs: DataFrame, p: Params) -> DataFrame:
    """Rows of packed chunks: ids, folds and token counts of documents, distinct words, tokens as word numbers."""

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        ids, folds, sizes, tokens = [], [], [], []

        def flush():
            nonlocal n
            h = np.concatenate(tokens)
            words, at = np.unique(h, return_inverse=True)
            size, fold = np.concatenate(sizes), np.concatenate(folds)
            train = int(size[fold == 0].sum())
            # words are numbered by how often they occur, in powers of two, then by hash: the numbers of tokens take fewer bytes
            kind = (63 - np.log2(np.bincount(at)).astype(np.int64)).astype(np.uint8)
            order = np.argsort(kind, kind="stable")
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order), dtype=np.uint32)
            cols = [f"{part}-{n}", len(size), len(words), len(h), train, int((fold == 0).sum()), pa.concat_arrays(ids).to_pylist(), _pack(fold, size.astype(np.uint32), kind[order], _steps(words[order], np.bincount(kind)), number[at])]
            n += 1
            for x in (ids, folds, sizes, tokens):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types, strict=True)], names)

        for b in batches:
            held = b.column("held_out").to_numpy(zero_copy_only=False)
            fold = np.array([2 if x is None else int(x) for x in held], np.uint8)
            for i, j, raw, at in textscan.blocks(b.column("text")):
                w = textscan.words(textscan.lower_ascii(raw), at)
                count = np.diff(w.first) + 1
                last = np.cumsum(count) - 1
                h = np.empty(int(count.sum()), np.uint64)
                is_end = np.zeros(len(h), bool)
                is_end[last] = True
                h[is_end] = END
                h[~is_end] = w.hashes
                ids.append(b.column("doc_id").slice(i, j - i))
                folds.append(fold[i:j])
                sizes.append(count)
                tokens.append(h)
                if sum(map(len, tokens)) >= p.chunk_tokens:
                    yield flush()
        if tokens:
            yield flush()

    names = ["chunk", "docs", "words", "tokens", "train_tokens", "train_docs", "ids", "body"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return docs.mapInArrow(run, "chunk string, docs long, words long, tokens long, train_tokens long, train_docs long, ids array<long>, body binary")


class _Chunk:
    def __init__(self, row: dict):
        self.name, self.ids = row["chunk"], row["ids"]
        n, w, t = row["docs"], row["words"], row["tokens"]
        self.fold, size, kind, words, at = _unpack(row["body"], (np.uint8, n), (np.uint32, n), (np.uint8, w), (np.uint64, w), (np.uint32, t))
        words = _from_steps(words, np.bincount(kind))
        order = np.argsort(words, kind="stable")  # merges the few sorted runs
        self.words = words[order]
        place = np.empty(w, np.int32)
        place[order] = np.arange(w, dtype=np.int32)
        self.size = size.astype(np.int64)
        self.token = place[at]
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.train = np.repeat(self.fold == 0, self.size)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.token[self.train], minlength=len(self.words))

    def deal(self, hot: np.ndarray, shards: int) -> _Dealt:
        return _Dealt(self, hot, shards)


class _Dealt:
    """A chunk's words, bigrams and trigrams in the order of the shards they belong to.

    Per shard: contexts v (``vs``), contexts u v (``nodes``), pairs v w (``pairs``), trigrams (``grams``) as a node and a pair, and
    the bigrams (``bigs``) of hot words. ``cuts`` has where each shard's begin.
    """

    def __init__(self, c: _Chunk, hot: np.ndarray, shards: int):
        i32 = np.int32  # numbers within a chunk; keys of two or three of them are made as longs and dropped at once
        w = len(c.words)
        base = w + 1
        hashes = np.append(c.words, BEGIN)
        is_hot = np.isin(hashes, hot)
        v, u = np.full(len(c.token), w), np.full(len(c.token), w)
        v[1:] = c.token[:-1]
        v[c.first[:-1]] = w
        u[2:] = c.token[:-2]
        u[c.first[:-1]] = w
        u[c.first[:-1][c.size > 1] + 1] = w
        v *= base
        u += v
        node, at_node = _distinct(u)
        del u
        v += c.token
        big, at_big = _distinct(v)
        del v
        key = at_node * np.int64(base) + c.token
        gram, at_gram = _distinct(key)
        del key
        first = np.empty(len(gram), i32)
        first[at_gram[::-1]] = np.arange(len(at_gram) - 1, -1, -1, dtype=i32)
        first_node, gram_big, gram_word = at_node[first], at_big[first], (gram % base).astype(i32)
        self.big_all = np.bincount(at_big[c.train], minlength=len(big)).astype(i32)
        del at_node, at_big, gram, first
        node_v, node_u = (node // base).astype(i32), (node % base).astype(i32)
        del node
        hv, hu = hashes[node_v], hashes[node_u]
        shard = (np.where(is_hot[node_v], textscan.mix(hv ^ (hu & np.uint64(1023))), hv) % np.uint64(shards)).astype(i32)
        del hv, hu
        order = np.argsort(shard, kind="stable").astype(i32)
        place = np.empty(len(order), i32)
        place[order] = np.arange(len(order), dtype=i32)
        self.node_shard, node_v, node_u = shard[order], node_v[order], node_u[order]
        gram_node = place[first_node]
        pair, gram_pair = _distinct(self.node_shard[gram_node] * np.int64(len(big)) + gram_big)
        order = np.lexsort((gram_pair, gram_node)).astype(i32)
        place = np.empty(len(order), i32)
        place[order] = np.arange(len(order), dtype=i32)
        self.gram_node, self.gram_pair, self.gram_word = gram_node[order], gram_pair[order], gram_word[order]
        self.at_gram = place[at_gram]
        del at_gram, gram_node, gram_pair, gram_word, gram_big, first_node, order, place
        self.count = np.bincount(self.at_gram[c.train], minlength=len(self.gram_node)).astype(i32)
        self.pair_shard, self.pair_big = (pair // len(big)).astype(i32), (pair % len(big)).astype(i32)
        del pair
        big_v, big_w = (big // base).astype(i32), (big % base).astype(i32)
        del big
        # contexts v of each shard: those of its nodes, which are those of its pairs
        self.v, self.node_v = _distinct(self.node_shard * np.int64(base) + node_v)
        self.pair_in_v = np.searchsorted(self.v, self.pair_shard * np.int64(base) + big_v[self.pair_big]).astype(i32)
        self.v_shard, self.v_hash = self.v // base, hashes[self.v % base]
        self.v_hot = is_hot[self.v % base]
        self.v_own = ~self.v_hot & (self.v % base < w)
        self.word_is_v = np.zeros(w, np.uint8)
        self.word_is_v[(self.v % base)[self.v_own]] = 1
        self.node_u, self.pair_w, self.hashes = node_u, big_w[self.pair_big], hashes
        self.n_node, self.n_pair, self.n_big = len(node_u), len(self.pair_big), len(big_v)
        own = np.flatnonzero(is_hot[big_v])
        hb, hw = hashes[big_v[own]], hashes[big_w[own]]
        shard = (textscan.mix(hb ^ (hw & np.uint64(1023)) ^ np.uint64(0x5B)) % np.uint64(shards)).astype(i32)
        order = np.argsort(shard, kind="stable")
        self.big, self.big_shard, self.big_v, self.big_w = own[order].astype(i32), shard[order], hb[order], hw[order]
        self.big_count = self.big_all[self.big]
        self.word_shard = (c.words % np.uint64(shards)).astype(np.int64)
        self.word_order = np.argsort(self.word_shard, kind="stable")
        ends = np.arange(shards + 1)
        self.cuts = {
            "words": np.searchsorted(self.word_shard[self.word_order], ends),
            "v": np.searchsorted(self.v_shard, ends),
            "node": np.searchsorted(self.node_shard, ends),
            "pair": np.searchsorted(self.pair_shard, ends),
            "gram": np.searchsorted(self.node_shard[self.gram_node], ends),
            "big": np.searchsorted(self.big_shard, ends),
        }

    def part(self, name: str, s: int) -> slice:
        return slice(int(self.cuts[name][s]), int(self.cuts[name][s + 1]))


SIZES = ("w", "v", "n", "p", "g", "b", "x", "d")


def _sizes(d: _Dealt, s: int) -> list[int]:
    """As in ``SIZES`` up to the contexts that are no words of the shard."""
    sizes = [d.part(x, s).stop - d.part(x, s).start for x in ("words", "v", "node", "pair", "gram", "big")]
    return [*sizes, int((~d.v_own[d.part("v", s)]).sum())]


def _short(h: np.ndarray) -> np.ndarray:
    """The first ``BITS`` bits of word hashes, in the order of these."""
    return h >> np.uint64(64 - BITS)


def _steps(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Differences within runs of the given sizes, the first of each run as it is; small where runs are sorted and long."""
    out = x.copy()
    out[1:] -= x[:-1]
    first = _runs(sizes.astype(np.int64))[sizes > 0]
    out[first] = x[first]
    return out


def _from_steps(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The inverse of ``_steps``, up to bits that were not kept."""
    sizes = sizes.astype(np.int64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return total[1:] - np.repeat(total[_runs(sizes)], sizes)


def _rows(batches):
    for b in batches:
        for r in range(b.num_rows):
            yield {n: b.column(n)[r].as_py() for n in b.schema.names}


def score(docs: DataFrame, p: Params = Params(), *, held_out_mod: int = 7, held_out_remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document (columns doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.crc32(F.col("doc_id").cast("string")) % held_out_mod == held_out_remainder).alias("held_out"))
    chunks = scratch.write(_chunks(rows, p), "chunks")
    total = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "train_tokens", "train_docs")]).first()
    n, n_docs = int(total.train_tokens), int(total.train_docs)
    shards = max(1, -(-int(total.tokens) // p.shard_tokens))
    least = max(1, n // p.hot_share)

    def count_words(batches):
        for row in _rows(batches):
            c = _Chunk(row)
            count = c.word_counts()
            used = np.flatnonzero(count > 0)
            own = (c.words[used] % np.uint64(shards)).astype(np.int64)
            used = used[np.argsort(own, kind="stable")]
            cut = np.searchsorted(np.sort(own), np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cut)).tolist():
                m = used[cut[s] : cut[s + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([len(m)], pa.int64()), pa.array([_pack(c.words[m], count[m].astype(np.uint32))], pa.binary())], ["shard", "n", "body"])

    def sum_words(table):
        w, c = zip(*[_unpack(r["body"], (np.uint64, r["n"]), (np.uint32, r["n"])) for r in _rows(table.to_batches())], strict=True)
        words, at = np.unique(np.concatenate(w), return_inverse=True)
        count = np.bincount(at, np.concatenate(c).astype(np.float64)).astype(np.int64)
        hot = count > least
        return pa.table({"v": pa.array([len(words)], pa.int64()), "n1": pa.array([int((count == 1).sum())], pa.int64()), "n2": pa.array([int((count == 2).sum())], pa.int64()), "hot": pa.array([words[hot].view(np.int64).tolist()], pa.list_(pa.int64())), "hot_n": pa.array([count[hot].tolist()], pa.list_(pa.int64()))})

    stats = chunks.mapInArrow(count_words, "shard long, n long, body binary").groupBy("shard").applyInArrow(sum_words, "v long, n1 long, n2 long, hot array<long>, hot_n array<long>")
    stats = scratch.write(stats, "words")
    scratch.release()
    s = stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v", "n1", "n2")]).first()
    v, d1 = int(s.v), (s.n1 / (s.n1 + 2 * s.n2) if s.n1 else 0.5)
    hot = {r.h & (2**64 - 1): r.c for r in stats.select(F.explode(F.arrays_zip(F.col("hot").alias("h"), F.col("hot_n").alias("c"))).alias("r")).select("r.h", "r.c").collect()}
    if n_docs > least:
        hot[int(BEGIN)] = n_docs
    hot.pop(int(END), None)
    hot_words = np.array(sorted(hot), np.uint64)
    hot_count = np.array([hot[int(h)] for h in hot_words], np.float64)
    unknown = d1 * v / n if n else 1.0

    def layout(r):
        return ((np.uint64, r["w"]), (np.uint32, r["w"]), (np.uint64, r["x"]), (np.uint32, r["v"]), (np.uint32, r["v"]), (np.uint32, r["n"]), (np.uint32, r["n"]), (np.uint32, r["p"]), (np.uint32, r["g"]), (np.uint32, r["g"]), (np.uint64, r["b"]), (np.uint64, r["b"], 5), (np.uint32, r["b"]), (np.uint8, r["w"]), (np.uint8, r["v"]), (np.uint64, r["d"], 5))

    def opened(r):
        """A message's arrays, with words, contexts and short hashes as they were."""
        a = _unpack(r["body"], *layout(r))
        a[0] = np.cumsum(a[0], dtype=np.uint64) * np.uint64(shards) + np.uint64(r["shard"])
        vs = np.empty(r["v"], np.uint64)
        own = a[14].astype(bool)
        vs[own], vs[~own] = a[0][a[13].astype(bool)], a[2]
        a[2] = vs
        short = np.cumsum(a.pop(), dtype=np.uint64) & _MASK
        a[5], a[7] = short[_from_steps(a[5], a[3])], short[_from_steps(a[7], a[4])]
        return a

    def messages(c):
        d = c.deal(hot_words, shards)
        local = c.word_counts()
        nodes_of_v, pairs_of_v = np.bincount(d.node_v, minlength=len(d.v)), np.bincount(d.pair_in_v, minlength=len(d.v))
        grams_of_node = np.bincount(d.gram_node, minlength=d.n_node)
        begin = _runs(pairs_of_v)
        rel = d.gram_pair - begin[d.node_v[d.gram_node]]
        seen, place = np.zeros(len(d.hashes), bool), np.empty(len(d.hashes), np.uint32)
        for s in range(shards):
            size = _sizes(d, s)
            if not any(size):
                continue
            m, pv, pn, pp, pg, pb = d.word_order[d.part("words", s)], *(d.part(x, s) for x in ("v", "node", "pair", "gram", "big"))
            u32 = lambda x: x.astype(np.uint32)
            # a word's short hash is sent once; contexts and successors are places among these
            seen[d.node_u[pn]] = seen[d.pair_w[pp]] = True
            named = np.flatnonzero(seen)
            seen[named] = False
            place[named] = np.arange(len(named), dtype=np.uint32)
            u, w = _steps(place[d.node_u[pn]], nodes_of_v[pv]), _steps(place[d.pair_w[pp]], pairs_of_v[pv])
            short = np.diff(_short(d.hashes[named]), prepend=np.uint64(0))
            words = np.diff(c.words[m] // np.uint64(shards), prepend=np.uint64(0))  # the remainder is the shard
            body = _pack(words, u32(local[m]), d.v_hash[pv][~d.v_own[pv]], u32(nodes_of_v[pv]), u32(pairs_of_v[pv]), u, u32(grams_of_node[pn]), w, u32(rel[pg]), u32(d.count[pg]), d.big_v[pb], (_short(d.big_w[pb]), 5), u32(d.big_count[pb]), d.word_is_v[m], d.v_own[pv].astype(np.uint8), (short, 5))
            cols = [s, c.name, *size, len(named), body]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cols, ask_types, strict=True)], ask_names)

    def ask(batches):
        for row in _rows(batches):
            yield from messages(_Chunk(row))  # nothing of a chunk stays while the next one is dealt

    ask_names = ["shard", "chunk", *SIZES, "body"]
    ask_types = [pa.int64(), pa.string(), *[pa.int64()] * len(SIZES), pa.binary()]
    ask_schema = "shard long, chunk string, w long, v long, n long, p long, g long, b long, x long, d long, body binary"

    def answer(table):
        asked = [(r, opened(r)) for r in ({k: x for k, x in row.items()} for row in _rows(table.to_batches()))]
        for r, _ in asked:
            r.pop("body")
        shard = asked[0][0]["shard"]
        words, at = _distinct(np.concatenate([a[0] for _, a in asked]))
        count = np.bincount(at, np.concatenate([a[1] for _, a in asked]).astype(np.float64), len(words))
        shape, learnt = [], []
        for r, (_, _, vs, nu, nw, u, ng, w, rel, c, *_) in asked:
            node_v, pair_v = np.repeat(np.arange(r["v"]), nu), np.repeat(np.arange(r["v"]), nw)
            gram_node = np.repeat(np.arange(r["n"]), ng)
            gram_pair = _runs(nw.astype(np.int64))[node_v[gram_node]] + rel
            shape.append((vs, node_v, u, pair_v, w, gram_node, gram_pair))
            k = np.flatnonzero(c)
            learnt.append((vs[node_v[gram_node[k]]], u[gram_node[k]], w[gram_pair[k]], c[k]))
        trie = Trie.build(*(np.concatenate(x) for x in zip(*learnt, strict=True)), p.discount).mapped()
        del learnt
        # bigrams of hot words: their context's count is known, its weight is summed over shards
        hv, hw = (np.concatenate([a[k] for _, a in asked]) for k in (10, 11))
        rank = np.searchsorted(hot_words, hv).astype(np.uint64) if len(hv) else np.zeros(0, np.uint64)
        bigs, at_b = np.unique((rank << np.uint64(BITS)) | hw, return_inverse=True)
        big_count = np.bincount(at_b, np.concatenate([a[12] for _, a in asked]).astype(np.float64), len(bigs)) if len(hv) else np.zeros(0)
        of = (bigs >> np.uint64(BITS)).astype(np.int64)
        big_code = to_codes(np.maximum(big_count - p.discount, 0) / np.maximum(hot_count[of], 1)) if len(bigs) else np.zeros(0, np.uint16)
        kinds = np.bincount(of[big_count > 0], minlength=len(hot_words))
        out, lo = [], 0
        for (r, a), x in zip(asked, shape, strict=True):
            i = np.searchsorted(words, a[0])
            back1, prob2, back2, prob3 = trie.lookup(*x)
            # where the whole context is here, both levels come as one: a trigram's own probability and the weight of p1
            vs, node_v, _, _, _, gram_node, gram_pair = x
            whole = ~np.isin(vs, hot_words)[node_v]
            deep = from_codes(back2)
            both = to_codes(from_codes(prob3) + deep[gram_node] * from_codes(prob2)[gram_pair])
            prob3 = np.where(whole[gram_node], both, prob3)
            back2 = np.where(whole, to_codes(deep * from_codes(back1)[node_v]), back2)
            out.append((r["chunk"], shard, *[r[k] for k in SIZES], _pack(count[i].astype(np.uint64), back2, prob3, big_code[at_b[lo : lo + r["b"]]])))
            lo += r["b"]
        k = np.flatnonzero(kinds)
        out.append((None, shard, len(k), *[0] * (len(SIZES) - 1), _pack(hot_words[k], kinds[k].astype(np.int64))))
        types = [pa.string(), *[pa.int64()] * (1 + len(SIZES)), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["chunk", "shard", *SIZES, "body"])

    asked = chunks.mapInArrow(ask, ask_schema)
    answers = scratch.write(asked.groupBy("shard").applyInArrow(answer, "chunk string, shard long, w long, v long, n long, p long, g long, b long, x long, d long, body binary"), "answers")
    del asked
    scratch.release()

    def spread_kinds(batches):
        for r in _rows(batches):
            keys, kinds = _unpack(r["body"], (np.uint64, r["w"]), (np.int64, r["w"]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kinds)], ["v", "kinds"])

    shared = answers.where("chunk is null").mapInArrow(spread_kinds, "v long, kinds long").groupBy("v").agg(F.sum("kinds").alias("kinds")).collect()
    kinds = {r.v & (2**64 - 1): r.kinds for r in shared}  # one for each hot word
    hot_back = from_codes(to_codes(np.array([p.discount * kinds.get(int(h), 0) for h in hot_words]) / np.maximum(hot_count, 1))) if len(hot_words) else np.zeros(0)

    def finish(left, right):
        out = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
        got = {r["shard"]: r for r in _rows(right.to_batches())}
        for row in _rows(left.to_batches()):
            c = _Chunk(row)
            d = c.deal(hot_words, shards)
            count = np.zeros(len(c.words))
            back, prob, big = np.ones(d.n_node), np.zeros(len(d.gram_node)), np.zeros(d.n_big)
            for s, r in got.items():
                total, weight, own, pb = _unpack(r["body"], (np.uint64, r["w"]), (np.uint16, r["n"]), (np.uint16, r["g"]), (np.uint16, r["b"]))
                m = d.word_order[d.part("words", s)]
                count[m] = total
                back[d.part("node", s)], prob[d.part("gram", s)] = from_codes(weight), from_codes(own)
                big[d.big[d.part("big", s)]] = from_codes(pb)
            p1 = from_codes(to_codes(np.where(count > 0, (count - d1) / max(n, 1), unknown)))
            shorter = p1[d.gram_word]
            spread = np.flatnonzero(d.v_hot[d.node_v[d.gram_node]])
            if len(spread):
                rank = np.searchsorted(hot_words, d.v_hash[d.node_v[d.gram_node[spread]]])
                shorter[spread] = big[d.pair_big[d.gram_pair[spread]]] + hot_back[rank] * shorter[spread]
            prob = np.log10(np.maximum(prob + back[d.gram_node] * shorter, 1e-300))
            base = np.log10((count + 1) / (n + v + 1))
            at0 = c.first[:-1]
            out["doc_id"] += c.ids
            out["held_out"] += [None if f == 2 else bool(f) for f in c.fold.tolist()]
            out["n_tokens"] += c.size.tolist()
            out["n_known"] += np.add.reduceat((count > 0)[c.token].astype(np.int64), at0).tolist()
            out["train_tokens"] += [n] * len(c.size)
            out["base_score"] += np.add.reduceat(base[c.token], at0).tolist()
            out["score"] += np.add.reduceat(prob[d.at_gram], at0).tolist()
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True)], names=list(out))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(answers.where("chunk is not null").groupBy("chunk")).applyInArrow(finish, schema)
