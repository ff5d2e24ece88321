"""Lineage trees as tables, and their population statistics as set-based plans.

A tree is a frame (node, parent, mut, alive): parent is null at the root, mut counts the mutations
on the edge above the node, alive marks the leaves that count. ``Lineage`` holds the contracted tree of
the alive leaves: lineages without alive leaves are dropped, a node with one retained child is
joined with that child (also at the root), and its mutations go to the child. L alive leaves leave
2L - 1 nodes.

Totals, depths and leaf counts come from pointer doubling: each of log2(depth) rounds is one
aggregation and two joins over the nodes, written, so no round makes more rows than the tree has. Only
the pairwise statistics make the closure of the contracted tree. Dense results have all indices from 0; where
stated, trailing zeros are cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators import leaf_pairs as lp
from brindle.operators.frequency import trim_trailing_zeros
from brindle.sources.shared import written


def by_sort(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables of a tree's size, never by broadcast: files under the limit for that hold a million rows and more, all of which would pass the driver."""
    return left.join(right.hint("merge"), on, how)


def ancestors(tree: DataFrame, some: DataFrame | None = None) -> DataFrame:
    """(node, anc, dist) of every node (of those in ``some``) with all its ancestors and itself, by doubling.

    Round k makes paths of 2**k edges and more from shorter ones and jumps of 2**k, so a tree of depth h takes log2(h)
    rounds, as do nodes at depth h; each is written, so plans and recomputation stay short. Output: nodes x depth rows.
    """
    paths = (tree if some is None else some).select("node", F.col("node").alias("anc"), F.lit(0).alias("dist"))
    jumps = tree.where("parent is not null").select(F.col("node").alias("anc"), F.col("parent").alias("up"))
    join = by_sort if some is None else DataFrame.join
    step = 1
    while True:
        jumps = written(jumps, "jumps")
        far = written(join(paths, jumps, "anc").select("node", F.col("up").alias("anc"), (F.col("dist") + step).alias("dist")), "paths")
        if far.isEmpty():
            return paths
        paths = written(paths.unionByName(far), "paths")
        jumps = by_sort(jumps, jumps.select(F.col("anc").alias("up"), F.col("up").alias("up2")), "up").select("anc", F.col("up2").alias("up"))
        step *= 2


def check_binary(tree: DataFrame) -> DataFrame:
    """Parents with more than two children, with their number; empty for a valid tree."""
    return tree.where("parent is not null").groupBy("parent").agg(F.count("*").alias("children")).where("children > 2")


def ref_counts(tree: DataFrame) -> DataFrame:
    """(node, parent, ref_count): the number of children of each node."""
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("ref_count"))
    return tree.select("node", "parent").join(kids, "node", "left").select("node", "parent", F.coalesce("ref_count", F.lit(0).cast("bigint")).alias("ref_count"))


def check_tree(tree: DataFrame) -> int:
    """The number of nodes; raises ValueError unless nodes are distinct, have two children at most, one root and known parents, and two leaves or more are alive."""
    kids = tree.where("parent is not null").groupBy("parent").agg(F.count("*").alias("children"))
    seen = tree.groupBy("node").agg(F.count("*").alias("n"), F.count_if(F.col("parent").isNull()).alias("root"), F.max("alive").alias("alive"))
    both = by_sort(seen, kids, seen.node == kids.parent, "full")
    r = both.agg(
        F.count("node").alias("nodes"),
        F.sum("n").alias("rows"),
        F.sum("root").alias("roots"),
        F.count_if("alive").alias("alive"),
        F.max("children").alias("children"),
        F.count_if(F.col("node").isNull()).alias("orphans"),
        F.count_if(F.col("alive") & F.col("children").isNotNull()).alias("inner"),
    ).first()
    for bad, text in (
        (r.rows != r.nodes, "a node stands in more than one row"),
        (r.roots != 1, f"a tree has one root, this one {r.roots or 0}"),
        (r.orphans, "a parent is no node of the tree"),
        ((r.children or 0) > 2, "a node has more than two children"),
        (r.inner, "an alive node has children"),
        (r.alive < 2, "a tree needs two alive leaves"),
    ):
        if bad:
            raise ValueError(text)
    return r.nodes


def sums(tree: DataFrame, nodes: int) -> DataFrame:
    """(node, parent, mut, alive, tot, depth, nl): mutations from the root to the node, edges above it, alive leaves below it.

    In round k every node knows the sums over its 2**k nearest ancestors and descendants. A tree of which some
    rows never reach the root after log2(nodes) rounds has a cycle.
    """
    kept = tree.select("node", "parent", F.col("mut").cast("bigint").alias("mut"), "alive")
    cur = kept.select("node", F.col("parent").alias("jump"), F.col("mut").alias("tot"), F.col("parent").isNotNull().cast("bigint").alias("depth"), F.col("alive").cast("bigint").alias("nl"))
    for _ in range(max(1, math.ceil(math.log2(max(nodes, 2)))) + 2):
        cur = written(cur, "sums")
        moving = cur.where("jump is not null")
        if moving.isEmpty():
            return by_sort(kept, cur.drop("jump"), "node")
        up = cur.select(F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("tot").alias("tot2"), F.col("depth").alias("depth2"))
        far = by_sort(moving, up, "jump").select("node", F.col("jump2").alias("jump"), (F.col("tot") + F.col("tot2")).alias("tot"), (F.col("depth") + F.col("depth2")).alias("depth"), "nl")
        more = moving.groupBy(F.col("jump").alias("node")).agg(F.sum("nl").alias("more"))
        cur = by_sort(far.unionByName(cur.where("jump is null")), more, "node", "left").select("node", "jump", "tot", "depth", (F.col("nl") + F.coalesce("more", F.lit(0).cast("bigint"))).alias("nl"))
    raise ValueError("the tree has a cycle")


def contract(rows: DataFrame) -> DataFrame:
    """(node, parent, mut, alive, tot, depth, nl) of the contracted tree, from the result of ``sums``."""
    rows = written(rows.where("nl > 0"), "retained")
    kids = rows.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    rows = by_sort(rows, kids, "node", "left").withColumn("kept", F.col("alive") | (F.coalesce("kids", F.lit(0)) == 2)).drop("kids")
    link = written(rows.where("not kept").select("node", F.col("parent").alias("up")), "chains")
    while True:
        onward = link.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.lit(True).alias("on"))
        far = written(by_sort(link, onward, "up", "left"), "chains")
        if far.where("on").isEmpty():
            break
        link = far.select("node", F.when(F.col("on"), F.col("up2")).otherwise(F.col("up")).alias("up"))
    nodes = rows.where("kept").drop("kept")
    nodes = by_sort(nodes, link.select(F.col("node").alias("parent"), "up", F.lit(True).alias("on")), "parent", "left").withColumn("parent", F.when(F.col("on"), F.col("up")).otherwise(F.col("parent")))
    above = rows.select(F.col("node").alias("parent"), F.col("tot").alias("tot_above"))
    nodes = by_sort(nodes, above, "parent", "left")
    return nodes.select("node", "parent", (F.col("tot") - F.coalesce("tot_above", F.lit(0).cast("bigint"))).alias("mut"), "alive", "tot", "depth", "nl")


@dataclass
class Lineage:
    """The contracted tree; ``nodes`` is (node, parent, mut, alive, tot, depth, nl)."""

    nodes: DataFrame
    _made: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def build(tree: DataFrame) -> Lineage:
        """Raises ValueError if ``tree`` is no binary tree with two alive leaves. ``tree`` is computed once."""
        tree = written(tree.select("node", "parent", "mut", "alive"), "tree")
        return Lineage(written(contract(sums(tree, check_tree(tree))), "nodes"))

    def save(self, path: str) -> None:
        self.nodes.write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Lineage:
        return Lineage(spark.read.parquet(path))

    @property
    def closure(self) -> DataFrame:
        """(leaf, node) of alive leaves with all their contracted ancestors and themselves; leaves x depth rows, made once."""
        if "closure" not in self._made:
            leaves = self.nodes.where("alive").select(F.col("node").alias("leaf"))
            up = ancestors(self.nodes)
            self._made["closure"] = written(by_sort(up, leaves, up.node == leaves.leaf).select("leaf", F.col("anc").alias("node")), "closure")
        return self._made["closure"]

    def contracted(self) -> DataFrame:
        """(node, parent, unique_mutations, total_mutations) of the 2L - 1 nodes."""
        return self.nodes.select("node", "parent", F.col("mut").alias("unique_mutations"), F.col("tot").alias("total_mutations"))

    def n_leaves(self) -> DataFrame:
        """(node, n_leaves) under each node."""
        return self.nodes.select("node", F.col("nl").alias("n_leaves"))

    def children(self) -> DataFrame:
        """(node, child1, child2) of the branching nodes of the contracted tree, by number."""
        kids = self.nodes.where("parent is not null").groupBy(F.col("parent").alias("node"))
        return kids.agg(F.min("node").alias("child1"), F.max("node").alias("child2"))

    def euler_tour(self) -> DataFrame:
        """(pos, node): the 4L - 3 places of the tour that enters children by number, from 0.

        A node's first place is the sum of what each ancestor puts before it: one step, and for second children
        the first one's tour and a step back. So it is a sum along the path, by the same doubling.
        """
        both = self.children()
        size = self.nodes.select(F.col("node").alias("child1"), (4 * F.col("nl") - 3).alias("tour"))
        both = by_sort(both, size, "child1")
        before = both.select(F.explode(F.array(F.struct(F.col("child1").alias("node"), F.lit(1).cast("bigint").alias("mut")), F.struct(F.col("child2").alias("node"), (F.col("tour") + 2).alias("mut")))).alias("x")).select("x.*")
        steps = by_sort(self.nodes.select("node", "parent", "alive"), before, "node", "left").withColumn("mut", F.coalesce("mut", F.lit(0).cast("bigint")))
        first = sums(steps, self.nodes.count()).select("node", F.col("tot").alias("pos"))
        inner = by_sort(first, both, "node").select("node", F.explode(F.array(F.col("pos"), F.col("pos") + F.col("tour") + 1)).alias("pos"))
        last = by_sort(by_sort(first, both, "node"), self.nodes.select("node", (4 * F.col("nl") - 3).alias("whole")), "node").select("node", (F.col("pos") + F.col("whole") - 1).alias("pos"))
        leaves = by_sort(first, both, "node", "left_anti")
        return leaves.select("pos", "node").unionByName(inner.select("pos", "node")).unionByName(last.select("pos", "node"))

    def _lifts(self) -> tuple[list[DataFrame], DataFrame]:
        """(node, up) by 2**k edges for each k, and (node, level) in the contracted tree."""
        if "lifts" not in self._made:
            jumps, cur = [], written(self.nodes.where("parent is not null").select("node", F.col("parent").alias("up")), "lift")
            while not cur.isEmpty():
                jumps.append(cur)
                cur = written(by_sort(cur, cur.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").select("node", F.col("up2").alias("up")), "lift")
            level = written(sums(self.nodes.select("node", "parent", F.lit(0).alias("mut"), "alive"), self.nodes.count()).select("node", F.col("depth").alias("level")), "levels")
            self._made["lifts"] = jumps, level
        return self._made["lifts"]

    def lca(self, pairs: DataFrame) -> DataFrame:
        """(a, b, lca) of pairs (a, b) of nodes: the deepest common ancestor, by binary lifting (2 log2(depth) joins of the pairs)."""
        jumps, level = self._lifts()
        la, lb = (level.select(F.col("node").alias(x), F.col("level").alias(f"level_{x}")) for x in "ab")
        q = by_sort(by_sort(pairs.select("a", "b").distinct(), la, "a"), lb, "b")
        swap = F.col("level_a") < F.col("level_b")
        q = q.select("a", "b", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("y"), F.abs(F.col("level_a") - F.col("level_b")).alias("gap"))
        for k in reversed(range(len(jumps))):
            up = jumps[k].select(F.col("node").alias("x"), F.col("up").alias("x2"))
            q = by_sort(q, up, "x", "left").select("a", "b", F.when(F.col("gap") >= 1 << k, F.col("x2")).otherwise(F.col("x")).alias("x"), "y", F.when(F.col("gap") >= 1 << k, F.col("gap") - (1 << k)).otherwise(F.col("gap")).alias("gap"))
        q = written(q.drop("gap"), "lifted")
        for k in reversed(range(len(jumps))):
            ux, uy = (jumps[k].select(F.col("node").alias(v), F.col("up").alias(f"{v}2")) for v in "xy")
            apart = F.coalesce(F.col("x2") != F.col("y2"), F.lit(False))
            q = by_sort(by_sort(q, ux, "x", "left"), uy, "y", "left").select("a", "b", F.when(apart, F.col("x2")).otherwise(F.col("x")).alias("x"), F.when(apart, F.col("y2")).otherwise(F.col("y")).alias("y"))
        top = self.nodes.select(F.col("node").alias("x"), "parent")
        return by_sort(q, top, "x").select("a", "b", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.col("parent")).alias("lca"))

    def _dense(self, found: DataFrame, trim: bool = True) -> DataFrame:
        last = F.broadcast(found.agg(F.max("idx").alias("last")))
        spine = last.select(F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("i"))
        full = spine.join(found, spine.i == found.idx, "left").select(F.col("i").alias("idx"), F.coalesce("freq", F.lit(0).cast("bigint")).alias("freq"))
        return trim_trailing_zeros(full, "idx", "freq") if trim else full

    def site_spectrum(self) -> DataFrame:
        """(idx, freq): mutations by the number of leaves that share them; trimmed."""
        return self._dense(self.nodes.groupBy(F.col("nl").alias("idx")).agg(F.sum("mut").cast("bigint").alias("freq")))

    def burden(self) -> DataFrame:
        """(idx, freq): alive leaves by their total mutations; trimmed."""
        return self._dense(self.nodes.where("alive").groupBy(F.col("tot").alias("idx")).agg(F.count("*").alias("freq")))

    def edge_histogram(self) -> DataFrame:
        """(idx, freq): contracted nodes by the mutations on the edge above; trimmed."""
        return self._dense(self.nodes.groupBy(F.col("mut").alias("idx")).agg(F.count("*").alias("freq")))

    def balance(self) -> DataFrame:
        """(idx, mean_diff, mean_ratio) by total mutations of branching nodes, zeros where there are none; not trimmed."""
        kid = self.nodes.where("parent is not null").groupBy("parent").agg(F.max("nl").alias("hi"), F.min("nl").alias("lo"))
        at = by_sort(kid, self.nodes.select(F.col("node").alias("parent"), "tot"), "parent")
        diff = F.col("hi") - F.col("lo")
        found = at.groupBy(F.col("tot").alias("idx")).agg(F.avg(diff).alias("mean_diff"), F.avg(diff / (F.col("hi") + F.col("lo"))).alias("mean_ratio"))
        last = F.broadcast(self.nodes.agg(F.max("tot").alias("last")))
        spine = last.select(F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("i"))
        return spine.join(found, spine.i == found.idx, "left").select(F.col("i").alias("idx"), F.coalesce("mean_diff", F.lit(0.0)).alias("mean_diff"), F.coalesce("mean_ratio", F.lit(0.0)).alias("mean_ratio"))

    def pairwise_mutations(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """(a, b, tot_a, tot_b, tot_lca) of all pairs a < b of contracted nodes with low <= node < high; quadratic by definition.

        Totals never fall along a path, so the largest total of the common ancestors is that of the lowest one.
        """
        some = self.nodes
        some = some if low is None else some.where(F.col("node") >= low)
        some = some if high is None else some.where(F.col("node") < high)
        return self._pairs(ancestors(self.nodes, None if low is None and high is None else some).select("node", "anc"))

    def leaf_pairs(self) -> DataFrame:
        """The same of all pairs of alive leaves."""
        return self._pairs(self.closure.select(F.col("leaf").alias("node"), F.col("node").alias("anc")))

    def _pairs(self, up: DataFrame) -> DataFrame:
        c = written(up.join(self.nodes.select(F.col("node").alias("anc"), F.col("tot").alias("tot_node")), "anc"), "above")
        t = c.where("node = anc").select("node", F.col("tot_node").alias("tot"))
        x, y = c.select("anc", F.col("node").alias("a"), "tot_node"), c.select("anc", F.col("node").alias("b"))
        common = x.join(y, "anc").where("a < b").groupBy("a", "b").agg(F.max("tot_node").alias("tot_lca"))
        return common.join(t.select(F.col("node").alias("a"), F.col("tot").alias("tot_a")), "a").join(t.select(F.col("node").alias("b"), F.col("tot").alias("tot_b")), "b").select("a", "b", "tot_a", "tot_b", "tot_lca")

    def _profile(self) -> DataFrame:
        """(s, tot_lca, n): leaf pairs by their distance and their common ancestor's total.

        Counts of leaves by (node, child side, total) are made before the self join, so a node costs the
        product of its sides' distinct totals, not of their leaves.
        """
        side = self.nodes.where("parent is not null").select(F.col("node"), F.col("parent").alias("v"))
        leaf = self.nodes.where("alive").select(F.col("node").alias("leaf"), F.col("tot").alias("t"))
        h = by_sort(by_sort(self.closure, side, "node"), leaf, "leaf").groupBy("v", F.col("node").alias("side"), "t").agg(F.count("*").alias("c"))
        h = written(h, "profile")
        x = h.select("v", F.col("side").alias("s1"), F.col("t").alias("t1"), F.col("c").alias("c1"))
        y = h.select("v", F.col("side").alias("s2"), F.col("t").alias("t2"), F.col("c").alias("c2"))
        both = x.join(y, "v").where("s1 < s2").join(self.nodes.select(F.col("node").alias("v"), "tot"), "v")
        return both.groupBy((F.col("t1") + F.col("t2") - 2 * F.col("tot")).alias("s"), F.col("tot").alias("tot_lca")).agg(F.sum(F.col("c1") * F.col("c2")).cast("bigint").alias("n"))

    def _ranked(self) -> DataFrame:
        """(rank, t, gap) of alive leaves by their place in the tour, from 0: total, and total of the common ancestor with the next leaf.

        A leaf's place is the sum of the leaves of first children beside its path: the tour's doubling.
        """
        both = by_sort(self.children(), self.nodes.select(F.col("node").alias("child1"), F.col("nl").alias("first")), "child1")
        before = both.select(F.col("child2").alias("node"), F.col("first").alias("mut"))
        steps = by_sort(self.nodes.select("node", "parent", "alive"), before, "node", "left").withColumn("mut", F.coalesce("mut", F.lit(0).cast("bigint")))
        rank = written(sums(steps, self.nodes.count()).select("node", F.col("tot").alias("rank")), "ranks")
        at = by_sort(self.nodes.select("node", "tot", "alive"), rank, "node")
        gap = by_sort(at, both, "node").select((F.col("rank") + F.col("first") - 1).alias("rank"), F.col("tot").alias("gap"))
        return by_sort(at.where("alive").select("rank", F.col("tot").alias("t")), gap, "rank", "left").select("rank", "t", F.coalesce("gap", "t").alias("gap"))

    def _pair_profile(self) -> DataFrame:
        """As ``_profile``, but every pair of leaves is made: in tiles of two blocks of leaves, a task for some of them, without rows of pairs."""
        leaves = self.nodes.where("alive").count()
        side = max(64, min(lp.SIDE, -(-leaves // 32)))
        n = -(-leaves // side)
        tasks = min(n * (n + 1) // 2, max(64, n * (n + 1) // 32))
        rows = self._ranked().groupBy(F.expr(f"rank div {side}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "t", "gap"))).alias("x"))
        blocks = written(rows.select("block", F.col("x.t").alias("t"), F.col("x.gap").alias("gap")), "blocks")
        low = blocks.select(F.col("block").alias("j"), F.array_min("gap").alias("low"))
        passed = Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
        tiles = blocks.select(F.col("block").alias("i")).join(low, F.col("i") < F.col("j")).select("i", "j", F.min("low").over(passed).alias("between"))
        one, two = (blocks.select(F.col("block").alias(k), F.col("t").alias(f"t{x}"), F.col("gap").alias(f"gap{x}")).hint("merge") for k, x in (("i", 1), ("j", 2)))
        own = blocks.select(F.col("block").alias("i"), F.col("block").alias("j"), F.lit(None).cast("bigint").alias("between"))
        left = tiles.unionByName(own).join(one, "i").repartition(tasks, "i", "j")
        right = tiles.select("i", "j").join(two, "j").repartition(tasks, "i", "j")
        both = left.join(right.hint("merge"), ["i", "j"], "left").select("t1", "gap1", "t2", "gap2", "between")
        return both.mapInArrow(lp.count_tiles, "s bigint, tot_lca bigint, n bigint")

    def distance(self, *, pairwise: bool = False) -> DataFrame:
        """(idx, freq): leaf pairs by tot_a + tot_b - 2 tot_lca; trimmed."""
        rows = self._pair_profile() if pairwise else self._profile()
        return self._dense(written(rows.groupBy(F.col("s").alias("idx")).agg(F.sum("n").cast("bigint").alias("freq")), "distances"))

    def jaccard(self, n_bins: int, *, pairwise: bool = False) -> DataFrame:
        """(bin, freq): leaf pairs by s / (s + tot_lca) in ``n_bins`` equal bins (0 without mutations), by integers; not trimmed."""
        rows = self._pair_profile() if pairwise else self._profile()
        b = F.when(F.col("s") + F.col("tot_lca") == 0, F.lit(0)).otherwise(F.least(F.lit(n_bins - 1), F.expr(f"({n_bins} * s) div (s + tot_lca)"))).cast("int")
        found = rows.groupBy(b.alias("b")).agg(F.sum("n").cast("bigint").alias("freq"))
        spine = self.nodes.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
        return spine.join(found, F.col("bin") == F.col("b"), "left").select("bin", F.coalesce("freq", F.lit(0).cast("bigint")).alias("freq"))


def sample_leaves(tree: DataFrame, amount: int, path: str) -> DataFrame:
    """``tree`` with exactly ``amount`` of its alive leaves kept alive, drawn without replacement."""
    from brindle.functions.rand import sample_rows

    kept = sample_rows(tree.where("alive").select("node"), "node", amount, path).select("node", F.lit(True).alias("kept"))
    return tree.join(kept, "node", "left").withColumn("alive", F.col("alive") & F.coalesce("kept", F.lit(False))).drop("kept")


def with_poisson(tree: DataFrame, lam: float, path: str) -> DataFrame:
    """``tree`` with Poisson mutations on every edge, none on the root."""
    from brindle.functions.rand import poisson

    draw: Column = poisson(lam, path, "mutations", F.col("node"))
    return tree.withColumn("mut", F.when(F.col("parent").isNull(), F.lit(0).cast("bigint")).otherwise(draw))
