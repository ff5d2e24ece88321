from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import leaf_pairs as lp
from brindle.operators import lineage
from brindle.operators.lineage import Lineage, check_binary, sample_leaves, with_poisson
from brindle.operators.range_min import range_min
from brindle.operators.simulate import birth_death
from brindle.sources.shared import written

SCHEMA = "node bigint, parent bigint, mut bigint, alive boolean"


def grow(ops):
    parent, cells = [None], [0]
    for op in ops.split():
        i = int(op[1:])
        if op[0] == "d":
            parent += [cells[i], cells[i]]
            cells[i] = len(parent) - 2
            cells.append(len(parent) - 1)
        else:
            cells.pop(i)
    return [(n, p, 0 if p is None else 1, n in cells) for n, p in enumerate(parent)]


def values(df, col="freq"):
    return [r[col] for r in df.orderBy(df.columns[0]).collect()]


# Statistics that these four trees must have.
GOLDEN = {
    "d0 d0 d1 d0 d1": ([0, 6, 2, 2], [0, 0, 2, 4], [1, 10], [0, 1, 0, 0], [0, 1 / 3, 0, 0], [0, 0, 2, 4, 1, 4, 4]),
    "d0 d0 d1 d0 d1 r0": ([0, 6, 2, 1], [0, 0, 2, 3], [1, 7, 1], [1, 0.5, 0, 0], [1 / 5, 1 / 6, 0, 0], [0, 0, 1, 3, 1, 3, 2]),
    "d0 d0 r1": ([0, 2, 1], [0, 0, 2], [0, 3], [0, 0, 0], [0, 0, 0], [0, 0, 1]),
    "d0 d0 r1 d0 d1 r0": ([0, 4, 1, 1], [0, 0, 0, 3], [0, 4, 1], [0, 1, 0, 0], [0, 1 / 3, 0, 0], [0, 0, 1, 0, 2]),
}


@pytest.mark.parametrize("ops", GOLDEN)
def test_golden_trees(spark, ops):
    # the removed cell of the third and fourth tree is the sibling at the root
    rows = grow(ops)
    tree = Lineage.build(spark.createDataFrame(rows, SCHEMA))
    sfs, mbd, umbd, mean, ratio, dist = GOLDEN[ops]
    assert values(tree.site_spectrum()) == sfs
    assert values(tree.burden()) == mbd
    assert values(tree.edge_histogram()) == umbd
    assert values(tree.balance(), "mean_diff") == pytest.approx(mean)
    assert values(tree.balance(), "mean_ratio") == pytest.approx(ratio)
    assert values(tree.distance()) == dist
    assert values(tree.distance(pairwise=True)) == dist


def test_jaccard_bins(spark):
    tree = Lineage.build(spark.createDataFrame(grow("d0 d0 d1 d0 d1"), SCHEMA))
    assert values(tree.jaccard(4)) == [0, 0, 2, 13]
    flat = [(n, p, 0, a) for n, p, _, a in grow("d0 d0 d1")]
    assert values(Lineage.build(spark.createDataFrame(flat, SCHEMA)).jaccard(3)) == [6, 0, 0]


def test_pairwise_equals_convolution(spark):
    pdf = birth_death("t", 5, 1.0, 0.3, 30, 10)
    rng = np.random.default_rng(5)
    pdf["mut"] = [0, *rng.poisson(4, len(pdf) - 1)]
    tree = Lineage.build(spark.createDataFrame(pdf.drop(columns="tree_id").astype(object).where(pdf.notna(), None).values.tolist(), SCHEMA))
    assert values(tree.distance()) == values(tree.distance(pairwise=True))
    assert values(tree.jaccard(50)) == values(tree.jaccard(50, pairwise=True))


def most_rows(df):
    """The most rows that any step of a collected frame made."""

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        own = p.metrics().get("numOutputRows")
        kids = p.children()
        return max([own.get().value() if own.isDefined() else 0, *(walk(kids.apply(k)) for k in range(kids.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_all_pairs_make_no_rows_of_pairs(spark):
    """A comb of 300 leaves: 44,850 pairs, which were a row for each common ancestor of each pair."""
    n = 300
    rows = [(0, None, 0, False)]
    for k in range(1, n):
        inner, leaf = 2 * k - 1, 2 * k
        rows += [(inner, max(0, 2 * k - 3), k % 4, k == n - 1), (leaf, max(0, 2 * k - 3), k % 3, True)]
    tree = Lineage.build(spark.createDataFrame(rows, SCHEMA))
    shares = tree.jaccard(20, pairwise=True)
    got = {r.bin: r.freq for r in shares.collect()}
    assert sum(got.values()) == n * (n - 1) // 2 and most_rows(shares) < 10_000
    assert got == {r.bin: r.freq for r in tree.jaccard(20).collect()}


def test_joins_of_the_tree_are_not_broadcast(spark, monkeypatch):
    """Small files can hold many rows; these passed the driver in each round."""
    plans = []

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(lineage, "written", lambda df, name="t": (plans.append(plan(df)), written(df, name))[1])
    tree = Lineage.build(spark.createDataFrame(grow("d0 d0 d1 d0 d1"), SCHEMA))
    plans.append(plan(tree.lca(spark.createDataFrame([(9, 10)], "a bigint, b bigint"))))
    assert not [p for p in plans if "Broadcast" in p]


def test_pairs_of_some_nodes_make_their_paths_only(spark, monkeypatch):
    """Four nodes near the root of a comb of 39: the paths of all nodes were made."""
    rows = [(0, None, 0, False)] + [(k, max(0, (k - 1) // 2 * 2 - 1), k % 4, k % 2 == 0 or k == 37) for k in range(1, 39)]
    tree, made = Lineage.build(spark.createDataFrame(rows, SCHEMA)), []
    monkeypatch.setattr(lineage, "written", lambda df, name="t": (made.append(df.count()), written(df, name))[1])
    assert sorted((r.a, r.b, r.tot_lca) for r in tree.pairwise_mutations(1, 5).collect()) == [(1, 2, 0), (1, 3, 1), (1, 4, 1), (2, 3, 0), (2, 4, 0), (3, 4, 1)]
    assert max(made) <= len(rows)


def test_build_computes_its_tree_once(spark):
    """Drawn mutations were drawn again for each use."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def mut(n):
        seen.add(1)
        return n % 3

    rows = spark.createDataFrame(grow("d0 d0 d1 d0 d1"), SCHEMA)
    Lineage.build(rows.withColumn("mut", mut("node")))
    assert seen.value == rows.count()


@pytest.mark.parametrize("high", [4, 10**7])
def test_tiles_equal_a_loop(high):
    """Narrow totals are counted in an array, wide ones sorted; blocks of several sizes, also with others between them."""
    rng = np.random.default_rng(high)
    gap = rng.integers(0, high, 700)
    t = np.maximum(gap, np.concatenate(([0], gap[:-1]))) + rng.integers(0, high, 700)
    for lo1, hi1, lo2, hi2 in ((0, 1, 1, 2), (0, 150, 150, 700), (10, 300, 520, 640), (0, 300, None, None), (5, 6, None, None)):
        want = Counter()
        for i in range(lo1, hi1):
            for j in range(i + 1, hi1) if lo2 is None else range(lo2, hi2):
                c = gap[i:j].min()
                want[c, t[i] + t[j] - 2 * c] += 1
        second = () if lo2 is None else (t[lo2:hi2], gap[lo2:hi2], int(gap[hi1:lo2].min()) if hi1 < lo2 else None)
        got = Counter()
        for lca, s, k in lp.tile(t[lo1:hi1], gap[lo1:hi1], *second):
            for key in zip(lca, s, k, strict=True):
                got[key[:2]] += key[2]
        assert got == want


def test_lca_and_contracted_children(spark):
    """A chain of 41 nodes with a second leaf at its 20th: all the chain is joined to the nodes below."""
    n = 40
    rows = [(k, k - 1 if k else None, 1 if k else 0, k == n) for k in range(n + 1)] + [(n + 1, 20, 1, True)]
    tree = Lineage.build(spark.createDataFrame(rows, SCHEMA))
    pairs = spark.createDataFrame([(n, n + 1), (n, n), (20, n)], "a bigint, b bigint")
    assert sorted(tuple(r) for r in tree.lca(pairs).collect()) == [(20, n, 20), (n, n, n), (n, n + 1, 20)]
    assert [tuple(r) for r in tree.children().collect()] == [(20, n, n + 1)]
    assert sorted(tuple(r) for r in tree.contracted().collect()) == [(20, None, 20, 20), (n, 20, 20, 40), (n + 1, 20, 1, 21)]
    assert check_binary(spark.createDataFrame([(1, 0, 1, True), (2, 0, 1, True), (3, 0, 1, True)], SCHEMA)).count() == 1


def test_random_trees_equal_a_walk(spark):
    """Contraction, tour, lowest common ancestors and pair totals of simulated trees, against plain Python."""
    pdf = birth_death("walk", 3, 1.0, 0.4, 25, 8)
    rows = [(n, None if p != p or p is None else int(p), (n * 7) % 4 if n else 0, bool(a)) for n, p, a in zip(pdf.node, pdf.parent.astype(object).where(pdf.parent.notna(), None), pdf.alive, strict=True)]
    tree = Lineage.build(spark.createDataFrame(rows, SCHEMA))
    parent, mut = {n: p for n, p, _, _ in rows}, {n: m for n, _, m, _ in rows}

    def path(n):
        return [] if n is None else [n, *path(parent[n])]

    leaves = [n for n, _, _, a in rows if a]
    below = Counter(x for n in leaves for x in path(n))
    kids = Counter(parent[n] for n in below if parent[n] is not None)
    kept = {n for n in below if n in leaves or kids[n] == 2}
    up = {n: next((x for x in path(n)[1:] if x in kept), None) for n in kept}
    total = {n: sum(mut[x] for x in path(n)) for n in below}
    assert {tuple(r) for r in tree.contracted().collect()} == {(n, up[n], total[n] - total.get(up[n], 0), total[n]) for n in kept}
    assert len(kept) == 2 * len(leaves) - 1

    def walk(n):
        two = sorted(x for x in kept if up[x] == n)
        return [n] if not two else [n, *walk(two[0]), n, *walk(two[1]), n]

    tour = walk(next(n for n in kept if up[n] is None))
    assert [r.node for r in tree.euler_tour().orderBy("pos").collect()] == tour and len(tour) == 4 * len(leaves) - 3
    for r in tree.n_leaves().collect():
        first, last = tour.index(r.node), len(tour) - 1 - tour[::-1].index(r.node)
        assert r.n_leaves == (last - first + 4) // 4

    def low(a, b):
        other = set(path(b))
        return next(x for x in path(a) if x in other and x in kept)

    pairs = [(a, b) for a in kept for b in kept if a < b]
    got = {(r.a, r.b): r.lca for r in tree.lca(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {(a, b): low(a, b) for a, b in pairs}
    some = {(r.a, r.b): (r.tot_a, r.tot_b, r.tot_lca) for r in tree.pairwise_mutations(5, 30).collect()}
    assert some == {(a, b): (total[a], total[b], total[low(a, b)]) for a, b in pairs if 5 <= a and b < 30}


@pytest.mark.parametrize(
    "rows, text",
    [
        ([(0, None, 0, False), (1, 0, 1, True)], "two alive leaves"),
        ([(0, None, 0, False), (1, 0, 1, True), (2, 0, 1, True), (3, 0, 1, True)], "more than two children"),
        ([(0, None, 0, False), (1, 0, 1, True), (2, None, 1, True)], "one root"),
        ([(0, None, 0, False), (1, 0, 1, True), (2, 0, 1, True), (3, 9, 1, True)], "no node of the tree"),
        ([(0, None, 0, False), (1, 0, 1, True), (2, 0, 1, True), (2, 0, 1, True)], "more than one row"),
        ([(0, None, 0, False), (1, 0, 1, True), (2, 0, 1, True), (3, 4, 1, False), (4, 3, 1, False)], "cycle"),
        ([(0, None, 0, False), (1, 0, 1, True), (2, 1, 1, True)], "alive node has children"),
    ],
)
def test_trees_that_are_none(spark, rows, text):
    with pytest.raises(ValueError, match=text):
        Lineage.build(spark.createDataFrame(rows, SCHEMA))


def test_sampling_and_poisson(spark):
    tree = spark.createDataFrame(grow("d0 d0 d1 d0 d1"), SCHEMA)
    assert sample_leaves(tree, 3, "p").where("alive").count() == 3
    assert sample_leaves(tree, 99, "p").where("alive").count() == 6
    assert with_poisson(tree, 2.0, "p").where("parent is null").first().mut == 0


def test_range_min(spark):
    vals = [7, 2, 9, 1, 8, 3, 6, 4]
    rows = spark.createDataFrame(list(enumerate(vals)), "pos bigint, val bigint")
    q = spark.createDataFrame([(4, 7), (0, 7), (2, 2)], "lo bigint, hi bigint")
    assert {(r.lo, r.hi): (r.val, r.pos) for r in range_min(rows, q, 8).collect()} == {(4, 7): (3, 5), (0, 7): (1, 3), (2, 2): (9, 2)}
