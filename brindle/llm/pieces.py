"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text is encoded as the model does it: spaces become the meta symbol, one is put in front, and
the symbols of each stretch are merged by agenda. The agenda holds adjacent pairs that form a
piece, best score first, then leftmost; a popped pair whose parts have changed since is stale and
ignored. With dropout p, a popped pair is skipped if its keyed hash is below p: a hash of the
seed, the text's key, the stretch's number in the text, the pair's piece and its place in the
stretch. The skipped pair stays split unless another merge makes it a new pair. With p = 0 the
result is the model's own encoding.

Merges never cross from other text into a meta symbol, so stretches are independent. Every
occurrence of a stretch draws its own skips, within and across texts, so the number of its
segmentations has no bound but dropout's own; any recomputed task gives the same ids. A task keeps a bounded
table of stretches that it has met before, with the pairs that are popped if nothing is skipped, and the ids that this gives.
An occurrence hashes those pairs; if none is skipped, the ids stand. All other occurrences of a slice
of texts, first ones among them, run their own agendas side by side, one pop of each in a round of numpy operations, so no
result is ever taken from another occurrence's draws.

Characters without a piece become the byte pieces of their UTF-8 form; so does a literal meta
symbol in the text, which makes decoding exact for every text. Null texts give null ids and
decode to null; an empty text gives no ids.
"""

from __future__ import annotations

import heapq
import re
from array import array
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import textscan

META = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_MASK = (1 << 64) - 1
_NONE = 1 << 60
_SHORT = 48
_NO_PAIR = (1 << 24) - 1
_SEEN = 1 << 21
_STRETCH = re.compile(f"{META}*[^{META}]*")


def _hash(*values: int) -> int:
    x = 0x9E3779B97F4A7C15
    for v in values:
        x = ((x ^ (v & _MASK)) * 0xBF58476D1CE4E5B9) & _MASK
        x ^= x >> 29
        x = (x * 0x94D049BB133111EB) & _MASK
        x ^= x >> 32
    return x


@dataclass(frozen=True)
class Params:
    dropout: float = 0.1
    seed: int = 20240601
    cache: int = 250_000


@dataclass
class Codec:
    """The pieces of a model file with BPE scores, held as plain tables."""

    ids: dict[str, int]
    scores: list[float]
    pieces: list[str]
    byte_of: dict[int, int]
    byte_id: list[int]
    unknown: int
    params: Params

    def __post_init__(self):
        places = {x: n for n, x in enumerate(sorted({-self.scores[k] for k in self.ids.values()}))}
        self._rank = {x: places[-self.scores[k]] for x, k in self.ids.items()}
        self._limit = min(int(self.params.dropout * 2**64), _MASK)
        self._tables()
        self._clear()
        self._bytes = [bytes((self.byte_of[i],)) if i in self.byte_of else x.replace(META, " ").encode() for i, x in enumerate(self.pieces)]

    @staticmethod
    def load(model: bytes, params: Params = Params()) -> Codec:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        if m.trainer_spec.model_type != 2 or m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.add_dummy_prefix:
            raise ValueError("only BPE models with the identity normaliser, kept white space and a dummy prefix are supported")
        ids, byte_of, byte_id = {}, {}, [-1] * 256
        for i, p in enumerate(m.pieces):
            if p.type == 1:
                ids[p.piece] = i
                if META in p.piece.lstrip(META):
                    raise ValueError("a piece holds a meta symbol after other text")
            elif p.type == 6:
                byte_of[i] = int(p.piece[3:5], 16)
                byte_id[byte_of[i]] = i
        if min(byte_id) < 0:
            raise ValueError("the model has no byte pieces")
        return Codec(ids, [p.score for p in m.pieces], [p.piece for p in m.pieces], byte_of, byte_id, m.trainer_spec.unk_id, params)

    def _tables(self) -> None:
        """An open-addressed table of all pairs of pieces that form a piece, and the piece of each character."""
        pairs = [(self.ids[x[:k]], self.ids[x[k:]], self._rank[x], i) for x, i in self.ids.items() for k in range(1, len(x)) if x[:k] in self.ids and x[k:] in self.ids]
        left, right, rank, into = (np.array(v, np.int64) for v in zip(*pairs, strict=True)) if pairs else [np.zeros(0, np.int64)] * 4
        keys = (left << 32) | right
        self._bits = max(4, (4 * len(keys)).bit_length())
        # a key and its value, rank << 32 | piece, side by side; a free slot has the key -1 and the rank _NO_PAIR
        self._pair = np.tile(np.array([-1, _NO_PAIR << 32], np.int64), 1 << self._bits)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self._pair[2 * slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self._pair[2 * slot[put]], self._pair[2 * slot[put] + 1] = keys[put], (rank[put] << 32) | into[put]
            todo = np.setdiff1d(todo, put)
            slot[todo] = (slot[todo] + 1) & ((1 << self._bits) - 1)
        self._char = np.full(0x110000, -1, np.int32)
        for x, i in self.ids.items():
            if len(x) == 1:
                self._char[ord(x)] = i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).view(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NO_PAIR: none) and piece of the pairs of pieces; negative pieces pair with nothing."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        got = self._pair.take(2 * slot)
        on = np.flatnonzero((got != keys) & (got != -1))
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << self._bits) - 1)
            got = self._pair.take(2 * slot[on])
            on = on[(got != keys[on]) & (got != -1)]
        value = self._pair.take(2 * slot + 1)
        return (value >> 32).astype(np.int32), value.astype(np.int32)

    def _clear(self) -> None:
        """Forgets all stretches."""
        self._known: dict[str | None, int] = {}
        self._seen = bytearray()
        self._events, self._out = array("Q"), array("i")
        self._event_at, self._out_at = array("q", [0]), array("q", [0])

    def _state(self, ids: tuple[int, ...]) -> int:
        """A new entry of the table with these ids and nothing to skip."""
        self._out.extend(ids)
        self._event_at.append(len(self._events))
        self._out_at.append(len(self._out))
        return len(self._out_at) - 2

    def _learn(self, parts: list[str | None]) -> None:
        """Puts short stretches into the table: their pairs in the order in which they are popped, and their ids."""
        if None in parts:
            self._known[None] = self._state(tuple(self.byte_id[b] for b in META.encode()))
        short = [x for x in parts if x is not None and len(x) <= _SHORT]
        if not short:
            return
        ids, size, events, many = self._side_by_side(short, None)
        first = len(self._out_at) - 1
        self._known.update(zip(short, range(first, first + len(short)), strict=True))
        for flat, of, upto, n in ((self._out, ids.astype(np.int32), self._out_at, size), (self._events, events, self._event_at, many)):
            upto.extend(array("q", (len(flat) + np.cumsum(n)).astype(np.int64).tobytes()))
            flat.extend(array(flat.typecode, of.tobytes()))

    def merge(self, s: str, key: int) -> tuple[int, ...]:
        """Ids of one occurrence of a stretch."""
        return self._by_scan(s, key) if len(s) <= _SHORT else self._by_agenda(s, key)

    def _skip(self, key: int, event: int) -> bool:
        """The keyed hash of a merge: of the occurrence's key, the pair's rank and its place."""
        x = ((key ^ (event * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & _MASK
        x = ((x ^ (x >> 32)) * 0x94D049BB133111EB) & _MASK
        return (x ^ (x >> 29)) < self._limit

    def _skips(self, keys: np.ndarray, events: np.ndarray) -> np.ndarray:
        x = events * np.uint64(0x9E3779B97F4A7C15)
        x ^= keys
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        return x < np.uint64(self._limit)

    def _ids(self, symbols) -> tuple[int, ...]:
        out: list[int] = []
        for x in symbols:
            k = self.ids.get(x)
            if k is not None:
                out.append(k)
            else:
                out.extend(self.byte_id[b] for b in x.encode())
        return tuple(out)

    def _trace(self, s: str, skips: tuple[int, ...]) -> tuple[list[int], tuple[int, ...]]:
        """The popped pairs of a short stretch (rank and place) if those numbered ``skips`` are skipped, and the ids.

        The agenda is a list: the best score is searched, the leftmost of equals taken.
        """
        rank, none = self._rank.get, _NONE
        sym, at, events = list(s), list(range(len(s))), []
        agenda = [rank(a + b, none) for a, b in zip(sym, sym[1:], strict=False)]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            events.append((best << 32) | at[i])
            if len(events) - 1 in skips:
                agenda[i] = none
                continue
            del at[i + 1]
            sym[i] = both = sym[i] + sym[i + 1]
            del sym[i + 1], agenda[i]
            if i:
                agenda[i - 1] = rank(sym[i - 1] + both, none)
            if i < len(agenda):
                agenda[i] = rank(both + sym[i + 1], none)
        return events, self._ids(sym)

    def _by_scan(self, s: str, key: int) -> tuple[int, ...]:
        """One occurrence of a short stretch, without the table of states."""
        skips: tuple[int, ...] = ()
        while True:
            events, ids = self._trace(s, skips)
            after = skips[-1] + 1 if skips else 0
            skip = next((n for n in range(after, len(events)) if self._skip(key, events[n])), None) if self._limit else None
            if skip is None:
                return ids
            skips += (skip,)

    def _by_agenda(self, s: str, key: int) -> tuple[int, ...]:
        """The same with a heap of (score, place), for long stretches."""
        ranks = self._rank
        n = len(s)
        sym: list[str | None] = list(s)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n:
                both = sym[i] + sym[j]
                k = ranks.get(both)
                if k is not None:
                    heapq.heappush(agenda, (k, i, both))

        for i in range(n - 1):
            offer(i)
        while agenda:
            k, i, both = heapq.heappop(agenda)
            if sym[i] is None:
                continue
            j = nxt[i]
            if j >= n or len(sym[i]) + len(sym[j]) != len(both) or sym[i] + sym[j] != both:
                continue
            if self._limit and self._skip(key, (k << 32) | i):
                continue
            sym[i], sym[j] = both, None
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
                offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return self._ids(x for x in sym if x is not None)

    def encode(self, text: str | None, key: int = 0) -> list[int] | None:
        if text is None:
            return None
        return self.encode_all([text], [key])[0].tolist()

    def _stretches(self, text: str) -> list[str | None]:
        """The stretches of a text, None for a literal meta symbol."""
        out: list[str | None] = []
        for n, part in enumerate(text.split(META)):
            if n:
                out.append(None)
            out += _STRETCH.findall((part if n else META + part).replace(" ", META))
            if not out[-1] and out[-1] is not None:
                out.pop()
        return out

    def encode_all(self, texts: list[str | None], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the number of ids of each (0 for null and empty texts)."""
        if len(self._out_at) > self.params.cache or len(self._events) + len(self._out) > 16 * self.params.cache:
            self._clear()
        parts: list[str | None] = []
        ends, seeds = [0], []
        for text, key in zip(texts, keys, strict=True):
            if text:
                parts += self._stretches(text)
            ends.append(len(parts))
            seeds.append(_hash(self.params.seed, key))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        ends = np.array(ends)
        size = np.diff(ends)
        number = np.arange(len(parts)) - np.repeat(ends[:-1], size)
        draw = textscan.mix(np.repeat(np.array(seeds, np.uint64), size) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        known = self._known
        state = np.fromiter(map(known.get, parts, repeat(-1)), np.int64, len(parts))
        lacking = np.flatnonzero(state < 0)
        new = [parts[k] for k in lacking.tolist()]
        self._learn(self._worth_learning(new))
        state[lacking] = list(map(known.get, new, repeat(-1)))
        own = state < 0
        for k, x in zip(lacking.tolist(), new, strict=True):  # long ones, by an agenda of their own
            if x is not None and len(x) > _SHORT:
                state[k], own[k] = self._state(self._by_agenda(x, int(draw[k]))), False
        at = np.frombuffer(self._out_at, np.int64)
        begin, n = at[state], at[state + 1] - at[state]
        ids = np.frombuffer(self._out, np.int32)
        if self._limit:
            at = np.frombuffer(self._event_at, np.int64)
            first, many = at[state], at[state + 1] - at[state]
            many[own] = 0
            row = np.repeat(np.arange(len(parts), dtype=np.int32), many)
            event = np.frombuffer(self._events, np.uint64).take(np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(row)))
            own[row[self._skips(np.repeat(draw, many), event)]] = True
            drawn = np.flatnonzero(own)
            new, size, _, _ = self._side_by_side([parts[k] for k in drawn.tolist()], draw[drawn])
            begin[drawn] = len(ids) + np.cumsum(size) - size
            n[drawn] = size
            ids = np.concatenate([ids, new])
        upto = np.concatenate([[0], np.cumsum(n)])
        return ids[np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])], np.diff(upto[ends])

    def _worth_learning(self, new: list[str | None]) -> list[str | None]:
        """Of the stretches that the table lacks, one of each that occurs again; first occurrences only leave a mark.

        A mark is a byte by hash: a collision puts a stretch into the table early, and no ids depend on that.
        """
        if not self._limit:
            return list(dict.fromkeys(new))
        if not self._seen:
            self._seen = bytearray(_SEEN)
        seen, again = self._seen, {}
        for x in new:
            k = hash(x) & (_SEEN - 1)
            if seen[k] or x is None:
                again[x] = None
            else:
                seen[k] = 1
        return list(again)

    def _side_by_side(self, parts: list[str], draw: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of short stretches, each by its own agenda, and how many; without draws also the popped pairs (rank and place), and how many."""
        size = np.array([len(x) for x in parts], np.int64)
        point = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        char = self._char[point]
        char = np.where(char < 0, len(self.pieces) + point.astype(np.int32), char)
        at = np.cumsum(size) - size
        got: list[tuple[np.ndarray, ...]] = []
        for lo, hi in ((0, 6), (6, 9), (9, 12), (12, 16), (16, 24), (24, _SHORT)):
            rows = np.flatnonzero((size > lo) & (size <= hi))
            for k in range(0, len(rows), 8_000):
                pick = rows[k : k + 8_000]
                got.append((pick, *self._agendas(char, at[pick], size[pick], None if draw is None else draw[pick], hi)))

        def placed(flat, n):
            order = np.concatenate([g[0] for g in got])
            count, begin = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
            n, flat = np.concatenate(n), np.concatenate(flat)
            count[order], begin[order] = n, np.cumsum(n) - n
            return flat[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(len(flat))], count

        if not got:
            return np.zeros(0, np.int32), np.zeros(len(parts), np.int64), np.zeros(0, np.uint64), np.zeros(len(parts), np.int64)
        ids, count = placed([g[1] for g in got], [g[2] for g in got])
        other = np.flatnonzero(ids >= len(self.pieces))
        if len(other):  # characters without a piece become their bytes
            point, which = np.unique(ids[other] - len(self.pieces), return_inverse=True)
            coded = [[self.byte_id[b] for b in chr(x).encode()] for x in point.tolist()]
            long = np.array([len(x) for x in coded])[which]
            many = np.ones(len(ids), np.int64)
            many[other] = long
            begin = np.cumsum(many) - many
            wide = np.repeat(ids, many)
            wide[np.repeat(begin[other] - np.cumsum(long) + long, long) + np.arange(long.sum())] = np.concatenate([coded[k] for k in which.tolist()])
            count = np.diff(np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(count)])])
            ids = wide
        return ids, count, *(placed([g[3] for g in got], [g[4] for g in got]) if draw is None else (None, None))

    def _agendas(self, char: np.ndarray, at: np.ndarray, size: np.ndarray, draw: np.ndarray | None, width: int) -> tuple[np.ndarray, ...]:
        """One agenda for each column of ``width`` places; in a round each pops its best pair, the leftmost of equals, and skips or merges it."""
        n = len(at)
        place = np.arange(width, dtype=np.int32)[:, None]
        inside = place < size
        # one row more at either end holds no symbol, so that the first and the last have neighbours that pair with nothing
        sym = np.full((width + 2, n), -1, np.int32)
        sym[1:-1] = np.where(inside, char[np.where(inside, at + place, 0)], -1)
        none = np.int32(_NO_PAIR * 64)  # and what is above it: no pair
        pair, made = np.full((width + 2, n), none, np.int32), np.zeros((width + 2, n), np.int32)
        rank, into = self._pairs(sym[1:-2].ravel(), sym[2:-1].ravel())
        pair[1:-2], made[1:-2] = rank.reshape(width - 1, n) * 64 + place[:-1], into.reshape(width - 1, n)
        cell = np.arange((width + 2) * n, dtype=np.int32)
        nxt, prev, row_of = cell + np.int32(n), cell - np.int32(n), np.repeat(np.arange(-1, width + 1, dtype=np.int32), n)
        pairs, syms, mades = pair[1:width], sym.ravel(), made.ravel()
        flat = pair.ravel()
        live = np.arange(n)
        popped: list[tuple[np.ndarray, np.ndarray]] = [(live[:0], np.zeros(0, np.uint64))]
        while True:
            best = pairs.min(0)[live] if 2 * len(live) > n else pairs[:, live].min(0)
            go = best < none
            if not go.all():
                live, best = live[go], best[go]
                if not len(live):
                    break
            i = best & np.int32(63)
            event = ((best >> 6).astype(np.uint64) << np.uint64(32)) | i.astype(np.uint64)
            x = (i + 1) * np.int64(n) + live
            if draw is None:
                popped.append((live, event))
            else:
                skip = self._skips(draw[live], event)
                flat[x[skip]] = none
                x, i = x[~skip], i[~skip]
            both, j = mades[x], nxt[x]
            after, before = nxt[j], prev[x]
            syms[x], syms[j], flat[j] = both, -1, none
            nxt[x], prev[after] = after, x
            rank, into = self._pairs(np.concatenate([both, syms[before]]), np.concatenate([syms[after], both]))
            m = len(x)
            flat[x], mades[x] = rank[:m] * 64 + i, into[:m]
            flat[before], mades[before] = rank[m:] * 64 + row_of[before], into[m:]
        done = sym[1:-1]
        done = done.T
        kept = done >= 0
        row, event = (np.concatenate(x) for x in zip(*popped, strict=True))
        return done[kept].astype(np.int32), kept.sum(1), event[np.argsort(row, kind="stable")], np.bincount(row, minlength=n)

    def decode(self, ids: list[int] | None) -> str | None:
        """The exact text that was encoded, whatever the dropout was."""
        if ids is None:
            return None
        table = self._bytes
        text = b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def read_model(spark, path: str) -> bytes:
    """A model file by Spark's reader (any store) or, for a path without a scheme, from the driver's disk."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    with open(path, "rb") as f:
        return f.read()


def _codec(spark, model: str, params: Params):
    return spark.sparkContext.broadcast(Codec.load(read_model(spark, model), params))


def encode(docs: DataFrame, *, model: str = DEFAULT_MODEL, params: Params = Params(), key_col: str = "doc_id", text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` and the ids of every whole text; ``decoded_col`` adds what they decode to.

    The key is the row's ``key_col`` (null: 0), so equal texts of different rows vary.
    """
    shared = _codec(docs.sparkSession, model, params)
    new = [out_col] + ([decoded_col] if decoded_col else [])
    kept = docs.drop(*new)
    key = next(f"key{'_' * n}" for n in range(99) if f"key{'_' * n}" not in docs.columns)
    rows = kept.withColumn(key, F.xxhash64(key_col))
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else []))

    names = list(kept.columns)

    def run(batches):
        c = shared.value
        for b in batches:
            keys = b.column(key).to_pylist()
            col = b.column(text_col)
            at = 0
            while at < b.num_rows:
                # a slice of rows at a time, so that ids of long texts don't pile up
                end, size = at, 0
                while end < b.num_rows and size < 400_000:
                    size += len(col[end].as_buffer() or b"") if col[end].is_valid else 0
                    end += 1
                part = b.slice(at, end - at)
                texts = part.column(text_col).to_pylist()
                flat, sizes = c.encode_all(texts, keys[at:end])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                arr = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=pa.array([t is None for t in texts], pa.bool_()))
                cols = [part.column(n) for n in names] + [arr]
                if decoded_col:
                    cols.append(pa.array([None if t is None else c.decode(flat[i:j].tolist()) for t, i, j in zip(texts, ends, ends[1:], strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [*names, *new])
                at = end

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, *, model: str = DEFAULT_MODEL, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """All columns of ``rows`` and the text of every list of ids."""
    shared = _codec(rows.sparkSession, model, Params())
    kept = rows.drop(out_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches):
        c = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.decode(x.as_py()) for x in b.column(ids_col)], pa.string())], [*b.schema.names, out_col])

    return kept.mapInArrow(run, schema)
