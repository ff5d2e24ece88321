"""Non-negative positive-unlabelled learning over hashed text features.

The risk of a scorer f under class prior pi is estimated from positives P and unlabelled U as
``pi*E_P[l(f)] + max(0, E_U[l(-f)] - pi*E_P[l(-f)])`` with the logistic loss l. Where the second
term turns negative (the scorer has begun to memorise U), its own gradient is ascended instead.
The scorer is linear over binary features and is fitted with numpy on the driver from bounded
samples; scoring runs in Arrow batches, one block of documents at a time.

No row labelled 0 is ever used. The class prior is estimated from positives and unlabelled rows
alone (best-bin estimation: a scorer of one half of the sample is applied to the other; the
share of unlabelled rows above a score, over the share of positives above it, bounds the prior
from above, and the tightest bound that the sample sizes support is taken). The scale and place of the
scores are set by the unbiased risk of the same two samples, which is convex in these two numbers.

Features of a text: its distinct words (ASCII lower case), their leading bytes, how large a share of the words
has such a form, and shape statistics (case, digits, symbols, repetition, word length) cut into
bins. No other column of a row is ever a feature.

A repeated id takes part once, with the least of its texts; an id with labels that contradict
each other is a positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import textscan

SHAPE_BINS = 24
SHAPES = 12


@dataclass(frozen=True)
class FeatureSpec:
    """bits: log2 of the hashed word space; prefixes: lengths in bytes of word starts; shapes: use statistics.

    A hashed feature gets a weight only if ``min_support`` and a ``min_share`` of the sampled positives have it and its
    share among them is ``min_ratio`` times its share among negatives (with ``min_z``, also if theirs is ``min_ratio`` times
    its, unless ``evidence_only``); otherwise a linear scorer would learn single texts. The share among negatives is what the shares
    among unlabelled and positive rows leave by the prior.
    ``evidence_only`` keeps weights from going below zero: features argue for label 1 or not at all.
    ``rates``: a word or start that is at least one in so many words of its text is a further feature for each.
    ``min_z``: by so many standard deviations a feature's count among positives must exceed what its share among negatives lets expect
    (or fall below it, unless ``evidence_only``). Words are split at white space, or with ``letters`` at all but letters and digits.
    """

    bits: int = 18
    word_features: bool = True
    prefixes: tuple[int, ...] = ()
    shapes: bool = True
    min_support: int = 0
    min_share: float = 0.0
    min_ratio: float = 0.0
    evidence_only: bool = False
    rates: tuple[int, ...] = ()
    min_z: float = 0.0
    letters: bool = False

    @property
    def width(self) -> int:
        return (1 << self.bits) + SHAPES * SHAPE_BINS


def _shape_bins(raw, at, w, low_hashes) -> np.ndarray:
    """For each document of a block, one bin index of each statistic."""
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1)

    def share(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[at]) / size

    count = np.diff(w.first)
    some = np.maximum(count, 1)
    repeated = np.zeros(len(w.starts) + 1, np.int64)
    again = np.zeros(len(w.starts), bool)
    if len(again) > 1:
        again[1:] = (low_hashes[1:] == low_hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    repeated[1:] = np.cumsum(again)
    first_of = np.ones(len(low_hashes), bool)
    order = np.lexsort((low_hashes, w.doc))
    if len(order) > 1:
        same = (low_hashes[order][1:] == low_hashes[order][:-1]) & (w.doc[order][1:] == w.doc[order][:-1])
        first_of[order[1:][same]] = False
    distinct = np.diff(np.concatenate([[0], np.cumsum(first_of)])[w.first])
    edge = np.zeros(len(w.starts), bool)
    if len(edge):
        last = raw[w.ends - 1]
        edge = (last < 128) & ~(((last >= 48) & (last <= 57)) | ((last >= 65) & (last <= 90)) | ((last >= 97) & (last <= 122)))
    edged = np.diff(np.concatenate([[0], np.cumsum(edge)])[w.first]) / some
    alone = np.diff(np.concatenate([[0], np.cumsum((w.ends - w.starts) == 1)])[w.first]) / some
    letters = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    upper = (raw >= 65) & (raw <= 90)
    digit = (raw >= 48) & (raw <= 57)
    space = textscan._SPACE[raw]
    symbol = ~(letters | upper | digit | space)
    values = [
        share(upper), share(digit), share(symbol), share(raw == 33), share(raw == 124), share(raw == 10),
        np.diff(repeated[w.first]) / some, distinct / some, edged, alone,
    ]
    scaled = [np.sqrt(np.clip(v, 0, 1)) for v in values]
    scaled.append(np.clip(np.log2(count + 1) / 20, 0, 1))
    scaled.append(np.clip(size / some / 24, 0, 1))
    bins = np.stack([np.minimum((v * SHAPE_BINS).astype(np.int64), SHAPE_BINS - 1) for v in scaled], 1)
    return bins + np.arange(SHAPES) * SHAPE_BINS if n else bins


def features(column, spec: FeatureSpec) -> Iterator[np.ndarray]:
    """The sorted distinct feature indices of each text."""
    mask = np.uint64((1 << spec.bits) - 1)
    for _, _, raw, at in textscan.blocks(column):
        low = textscan.lower_ascii(raw)
        w = textscan.words(low, at)
        shape = _shape_bins(raw, at, w, w.hashes) + (1 << spec.bits) if spec.shapes else None
        parts = []
        if spec.letters:
            w = textscan.words(low, at, textscan.NOT_LETTER)
        if spec.word_features:
            parts.append(w.hashes & mask)
        for k in spec.prefixes:
            parts.append(textscan.mix(textscan.span_hashes(w.sums, w.starts, np.minimum(w.ends, w.starts + k)) + np.uint64(k)) & mask)
        table = np.stack(parts, 1).astype(np.int64) if parts else np.zeros((len(w.starts), 0), np.int64)
        for d in range(len(at) - 1):
            f, n = np.unique(table[w.first[d] : w.first[d + 1]], return_counts=True)
            some = int(w.first[d + 1] - w.first[d])
            levels = [(textscan.mix(f[n * k >= some].astype(np.uint64) + np.uint64(k << 32)) & mask).astype(np.int64) for k in spec.rates]
            f = np.unique(np.concatenate([f, *levels])) if spec.rates else f
            yield np.concatenate([f, shape[d]]) if spec.shapes else f


@dataclass
class Model:
    spec: FeatureSpec
    weights: np.ndarray
    bias: float
    prior: float
    trained: bool = True
    history: list = field(default_factory=list)
    curve: tuple[float, float] | None = None

    def margin(self, f: np.ndarray) -> float:
        x = float(self.weights[f].sum())
        if self.curve:
            return self.curve[0] * float(np.log1p(x)) + self.curve[1]
        return self.bias + x

    def margins(self, column) -> np.ndarray:
        return np.array([self.margin(f) for f in features(column, self.spec)], np.float64)

    def scores(self, column) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(column), -30, 30)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, spec: FeatureSpec, *, steps: int = 400, batch: int = 512, rate: float = 0.05, l2: float = 1e-4, beta: float = 0.0, seed: int = 7) -> Model:
    """Minimises the non-negative risk by mini-batches (Adam). Without positives or unlabelled rows, every score is the prior."""
    prior = min(max(float(prior), 1e-3), 1 - 1e-3)
    model = Model(spec, np.zeros(spec.width), float(np.log(prior / (1 - prior))), prior)
    if not positive or not unlabelled:
        model.trained = False
        return model
    if spec.min_support:
        in_p, in_u = (np.bincount(np.concatenate(rows), minlength=spec.width) for rows in (positive, unlabelled))
        share_p, share_u = in_p / len(positive), (in_u + 1) / len(unlabelled)
        share_n = np.maximum(share_u - prior * share_p, 1 / len(unlabelled)) / (1 - prior)
        expected = share_n * len(positive)
        z = (in_p - expected) / np.sqrt(expected + 1)
        keep = (in_p >= max(spec.min_support, spec.min_share * len(positive))) & (share_p >= spec.min_ratio * share_n) & (z >= spec.min_z)
        if spec.min_z and not spec.evidence_only:
            keep |= (in_u >= spec.min_support) & (share_n >= spec.min_ratio * (in_p + 1) / len(positive)) & (z <= -spec.min_z)
        keep[1 << spec.bits :] = spec.shapes
        used = np.flatnonzero(keep)
        new = np.cumsum(keep) - 1
        positive, unlabelled = ([new[f[keep[f]]] for f in rows] for rows in (positive, unlabelled))
    else:
        used = np.arange(spec.width)
    rng = np.random.default_rng(seed)
    width = len(used)
    m, v, w = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width)

    def flat(rows, pick):
        chosen = [rows[i] for i in pick]
        return np.concatenate(chosen), np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])

    def forward(idx, row, n):
        return model.bias + np.bincount(row, w[idx], n)

    for t in range(1, steps + 1):
        pick_p = rng.choice(len(positive), min(batch, len(positive)), replace=False)
        pick_u = rng.choice(len(unlabelled), min(batch, len(unlabelled)), replace=False)
        (ip, rp), (iu, ru) = flat(positive, pick_p), flat(unlabelled, pick_u)
        fp, fu = forward(ip, rp, len(pick_p)), forward(iu, ru, len(pick_u))
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        if negative >= -beta:
            gp = prior * (sp - 1) / len(fp) - prior * sp / len(fp)
            gu = su / len(fu)
        else:
            gp = prior * sp / len(fp)
            gu = -su / len(fu)
        grad = np.bincount(ip, gp[rp], width) + np.bincount(iu, gu[ru], width) + l2 * w
        grad = np.append(grad, gp.sum() + gu.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        if spec.evidence_only:
            np.maximum(w, 0, out=w)
        model.bias -= float(step[-1])
        if t % 50 == 0:
            model.history.append(float(prior * np.logaddexp(0, -fp).mean() + max(0.0, negative)))
    model.weights[used] = w
    return model


def calibrate(model: Model, positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> Model:
    """Sets the scale and place of margins by the unbiased risk ``E_U[log(1 + exp f)] - prior * E_P[f]``; the order of scores stays.

    Evidence that only adds up is taken by its logarithm, so that texts full of it don't set the scale.
    """
    if not model.trained:
        return model
    logs = model.spec.evidence_only
    x = np.array([model.weights[f].sum() for f in [*positive, *unlabelled]])
    x = np.log1p(x) if logs else model.bias + x
    scale, centre = max(float(x.std()), 1e-6), float(x.mean())
    z = np.stack([(x - centre) / scale, np.ones_like(x)], 1)
    p, u = z[: len(positive)], z[len(positive) :]
    pull = model.prior * p.mean(0)

    def risk(ab):
        return np.logaddexp(0, u @ ab).mean() - pull @ ab + 5e-4 * ab[0] ** 2

    ab = np.array([1.0, 0.0])
    for _ in range(60):
        s = 1 / (1 + np.exp(-np.clip(u @ ab, -30, 30)))
        grad = (u * s[:, None]).mean(0) - pull + np.array([1e-3 * ab[0], 0])
        hess = (u * (s * (1 - s) + 1e-9)[:, None]).T @ u / len(u) + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hess, grad)
        while risk(ab - step) > risk(ab) and np.abs(step).max() > 1e-9:
            step = step / 2
        ab = ab - step
    if ab[0] > 0 and logs:
        model.curve = (float(ab[0] / scale), float(ab[1] - centre * ab[0] / scale))
    elif ab[0] > 0:
        model.weights = model.weights * (ab[0] / scale)
        model.bias = float((model.bias - centre) * ab[0] / scale + ab[1])
    return model


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, *, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Class prior from scores of positive and unlabelled rows that the scorer was not fitted on."""
    at = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    slack = (1 + gamma) * (np.sqrt(np.log(4 / delta) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / delta) / (2 * len(positive))))
    k = int(np.argmin((u + slack) / p))
    return float(min(u[k] / p[k], 1.0))


def estimate_prior(positive: list[np.ndarray], unlabelled: list[np.ndarray], spec: FeatureSpec, **options) -> float:
    """The class prior, as the mean of two estimates, each from the half that the other's scorer was fitted on.

    With ``evidence_only`` the prior that a scorer is fitted with decides which features it may use: one far below the true prior
    leaves out those of label 1, and the bound is loose. So higher ones are tried until the least bound
    is below them and no longer falls.
    """
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    least = 1.0
    for guess in (0.1, 0.3, 0.5, 0.7, 0.9) if spec.evidence_only else (0.5,):
        found = []
        for k in (0, 1):
            m = fit(positive[k::2], unlabelled[k::2], guess, spec, **options)
            scores = [np.array([m.bias + m.weights[f].sum() for f in rows[1 - k :: 2]]) for rows in (positive, unlabelled)]
            found.append(best_bin(*scores))
        bound = float(np.mean(found))
        if bound >= least and least < guess:
            break
        least = min(least, bound)
    return least


def fold(id_col: Column) -> Column:
    """crc32 of the id as text; null ids have a null fold, so they are never trained on."""
    return F.crc32(id_col.cast("string"))


def _sample_features(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, spec: FeatureSpec) -> list[tuple[int, np.ndarray]]:
    """(kind, features) of the documents in ``ids`` (id, kind), a frame of a bounded number of rows by its own limits."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    rows = rows.groupBy("id", "kind").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            found = list(features(b.column("text"), spec))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("kind"), pa.array([f.astype(np.int32).tobytes() for f in found], pa.binary())], ["id", "kind", "f"])

    got = rows.select("id", "kind", "text").mapInArrow(run, "id long, kind int, f binary").collect()
    return [(r.kind, np.frombuffer(r.f, np.int32)) for r in sorted(got, key=lambda r: r.id)]


def train(docs: DataFrame, labels: DataFrame, label_col: str, spec: FeatureSpec, *, id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 3, held_out_remainder: int = 1, max_positive: int = 4000, max_unlabelled: int = 12000, prior: float | None = None, **options) -> Model:
    """Fits on documented, bounded samples: the rows with the smallest seeded hash of their id.

    Positives are labelled 1; unlabelled rows are drawn from all documents outside the held-out
    fold without looking at labels. Both samples are read in one scan. The class prior is estimated
    from them unless given.
    """
    learn = fold(F.col("id")) % held_out_mod != held_out_remainder
    hashed = F.xxhash64(F.col("id"), F.lit(11))
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where("id is not null and y = 1").where(learn)
    pos = marked.select("id").distinct().orderBy(hashed, "id").limit(max_positive).withColumn("kind", F.lit(1))
    unl = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").where(learn).distinct().orderBy(hashed, "id").limit(max_unlabelled).withColumn("kind", F.lit(2))
    ids = pos.unionByName(unl).groupBy("id").agg(F.sum("kind").cast("int").alias("kind"))
    got = _sample_features(docs, ids, id_col, text_col, spec)
    p, u = [f for k, f in got if k & 1], [f for k, f in got if k & 2]
    if prior is None:
        prior = estimate_prior(p, u, spec, **options)
    return calibrate(fit(p, u, prior, spec, **options), p, u)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """All columns of ``docs`` (one named ``out_col`` is replaced) and the score of every whole text, null and empty ones too."""
    kept = docs.drop(out_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches):
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.scores(b.column(text_col)), pa.float64())], [*b.schema.names, out_col])

    return kept.mapInArrow(run, schema)
