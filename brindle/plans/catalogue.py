"""The registered queries of the engine and their DuckDB equivalents.

Each query runs over its whole tables. The tree of the ``tree_*`` and ``pair_*`` queries has a node
for each customer: the parent of k is (k - 1) div 2, nation mod 4 mutations stand on each edge,
and every node without a child is alive, except those of ``pruned`` queries that die by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import bits, keys, rand
from brindle.operators import checks, flow
from brindle.operators import frequency as fq
from brindle.operators.lineage import Lineage, by_sort, ref_counts, sample_leaves, with_poisson
from brindle.operators.range_min import block_range_min, range_min
from brindle.sources import store as st
from brindle.sources.shared import shared_dir, written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Frequencies


@_query("freq_hash_event_type", "SELECT event_type, count(*) AS freq FROM events GROUP BY event_type")
def _(spark, d):
    return fq.count_by(_t(spark, d, "events"), "event_type")


@_query("freq_hash_composite", "SELECT l_returnflag, l_linestatus, count(*) AS freq FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return fq.count_by(_t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@_query("freq_hash_weighted", "SELECT l_returnflag, sum(l_quantity) AS freq FROM lineitem GROUP BY 1")
def _(spark, d):
    return fq.weighted_by(_t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


def _dense_sql(key: str, table: str, agg: str, bound: int) -> str:
    return f"""WITH c AS (SELECT {key} AS k, {agg} AS f FROM {table} GROUP BY 1),
s AS (SELECT CAST(range AS BIGINT) AS k FROM range({bound + 1})), j AS (SELECT s.k, coalesce(c.f, 0) AS f FROM s LEFT JOIN c ON s.k = c.k)
SELECT k AS {key}, CAST(f AS BIGINT) AS freq FROM j WHERE k <= (SELECT max(k) FROM j WHERE f <> 0)"""


@_query("freq_bounded_dense", _dense_sql("p_size", "part", "count(*)", 60))
def _(spark, d):
    return fq.dense_by(_t(spark, d, "part"), "p_size", 60)


@_query("freq_bounded_unchecked", _dense_sql("p_size", "(SELECT * FROM part WHERE p_size <= 40)", "count(*)", 40))
def _(spark, d):
    return fq.dense_by(_t(spark, d, "part"), "p_size", 40, checked=False)


@_query("freq_bounded_weighted", _dense_sql("l_linenumber", "lineitem", "sum(CAST(l_quantity AS BIGINT))", 9))
def _(spark, d):
    rows = _t(spark, d, "lineitem").select("l_linenumber", F.col("l_quantity").cast("bigint").alias("w"))
    return fq.dense_by(rows, "l_linenumber", 9, weight="w")


_BIN = "(o_totalprice - 20000.0) * (20 / 380000.0)"


def _hist_sql(agg: str) -> str:
    return f"""WITH b AS (SELECT CAST(CASE WHEN isnan(x) THEN 0 WHEN x <= 0 THEN 0 WHEN x >= 19 THEN 19 ELSE trunc(x) END AS INTEGER) AS bin, {agg} AS f
FROM (SELECT *, {_BIN} AS x FROM orders) GROUP BY 1)
SELECT CAST(range AS INTEGER) AS bin, CAST(coalesce(f, 0) AS BIGINT) AS freq FROM range(20) LEFT JOIN b ON bin = range"""


@_query("hist_binned", _hist_sql("count(*)"))
def _(spark, d):
    return fq.histogram(_t(spark, d, "orders"), "o_totalprice", 20, 20000.0, 400000.0)


@_query("hist_binned_weighted", _hist_sql("sum(o_custkey)"))
def _(spark, d):
    return fq.histogram(_t(spark, d, "orders"), "o_totalprice", 20, 20000.0, 400000.0, weight="o_custkey")


@_query("freq_documents_source", "SELECT source, lang, count(*) AS freq, FROM documents GROUP BY 1, 2")
def _(spark, d):
    return fq.count_by(_t(spark, d, "documents"), "source", "lang")


@_query("freq_bounded_unchecked_weighted", _dense_sql("l_linenumber", "(SELECT * FROM lineitem WHERE l_linenumber <= 5)", "sum(CAST(l_quantity AS BIGINT))", 5))
def _(spark, d):
    rows = _t(spark, d, "lineitem").select("l_linenumber", F.col("l_quantity").cast("bigint").alias("w"))
    return fq.dense_by(rows, "l_linenumber", 5, weight="w", checked=False)


@_query("hist_binned_single", """WITH b AS (SELECT CAST(CASE WHEN x <= 0 THEN 0 WHEN x >= 6 THEN 6 ELSE trunc(x) END AS INTEGER) AS bin, count(*) AS f
FROM (SELECT CAST((CAST(l_discount AS FLOAT) - CAST(0.0 AS FLOAT)) * (CAST(7 AS FLOAT) / (CAST(0.1 AS FLOAT) - CAST(0.0 AS FLOAT))) AS FLOAT) AS x FROM lineitem) GROUP BY 1)
SELECT CAST(range AS INTEGER) AS bin, CAST(coalesce(f, 0) AS BIGINT) AS freq FROM range(7) LEFT JOIN b ON bin = range""")
def _(spark, d):
    return fq.histogram(_t(spark, d, "lineitem").select(F.col("l_discount").cast("float").alias("x")), "x", 7, 0.0, 0.1)


@_query("freq_typed", "SELECT l_returnflag, CAST(sum(l_quantity) AS INTEGER) AS freq FROM lineitem GROUP BY 1")
def _(spark, d):
    return fq.weighted_by(fq.sized(_t(spark, d, "lineitem"), 20_000), ["l_returnflag"], "l_quantity", count_type="int")


@_query("freq_running_sums", "SELECT p_size, CAST(coalesce(sum(n) OVER (ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1)")
def _(spark, d):
    return fq.running_sums(fq.count_by(_t(spark, d, "part"), "p_size"), "p_size", "freq", block=7).select("p_size", "before")


# Lineage


def _tree(spark: SparkSession, d: str, *, pruned: bool = False) -> DataFrame:
    t = _t(spark, d, "customer").select(
        F.col("c_custkey").alias("node"),
        F.when(F.col("c_custkey") > 0, F.expr("(c_custkey - 1) div 2")).alias("parent"),
        F.when(F.col("c_custkey") > 0, F.col("c_nationkey") % 4).otherwise(0).cast("bigint").alias("mut"),
    )
    inner = t.where("parent is not null").select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    leaf = by_sort(t, inner, "node", "left").withColumn("alive", F.col("inner").isNull()).drop("inner")
    return leaf.withColumn("alive", F.col("alive") & (F.col("node") % 5 != 0)) if pruned else leaf


def _tree_sql(last: str, *, pruned: bool = False) -> str:
    dies = " AND c.c_custkey % 5 <> 0" if pruned else ""
    return f"""WITH RECURSIVE t AS (
  SELECT c.c_custkey AS node, CASE WHEN c.c_custkey > 0 THEN (c.c_custkey - 1) // 2 END AS parent,
    CASE WHEN c.c_custkey > 0 THEN c.c_nationkey % 4 ELSE 0 END AS mut,
    NOT EXISTS (SELECT 1 FROM customer k WHERE k.c_custkey > 0 AND (k.c_custkey - 1) // 2 = c.c_custkey){dies} AS alive FROM customer c),
anc(leaf, node) AS (
  SELECT node, node FROM t WHERE alive
  UNION ALL SELECT a.leaf, t.parent FROM anc a JOIN t ON a.node = t.node WHERE t.parent IS NOT NULL),
up(node, anc) AS (SELECT node, node FROM t UNION ALL SELECT u.node, t.parent FROM up u JOIN t ON u.anc = t.node WHERE t.parent IS NOT NULL),
n AS (SELECT t.node, t.parent, t.mut, t.alive, l.nl FROM t JOIN (SELECT node, count(*) AS nl FROM anc GROUP BY 1) l ON l.node = t.node),
tt AS (SELECT u.node, sum(t.mut) AS tot, count(*) AS depth FROM up u JOIN t ON t.node = u.anc GROUP BY 1),
r0 AS (SELECT n.*, tt.tot, tt.depth FROM n JOIN tt ON tt.node = n.node),
kc AS (SELECT parent, count(*) AS kids FROM r0 WHERE parent IS NOT NULL GROUP BY 1),
q0 AS (SELECT r0.* FROM r0 LEFT JOIN kc ON kc.parent = r0.node WHERE r0.alive OR kc.kids = 2),
cp AS (SELECT u.node, arg_max(u.anc, a.depth) AS cparent FROM up u JOIN q0 ON q0.node = u.node JOIN q0 a ON a.node = u.anc WHERE u.anc <> u.node GROUP BY 1),
m AS (SELECT q0.node, cp.cparent AS parent, CAST(q0.tot - coalesce(a.tot, 0) AS BIGINT) AS mut, q0.alive, q0.nl, CAST(q0.tot AS BIGINT) AS tot, q0.depth FROM q0 LEFT JOIN cp ON cp.node = q0.node LEFT JOIN q0 a ON a.node = cp.cparent),
{last}"""


_DENSE = "SELECT CAST(range AS BIGINT) AS idx, CAST(coalesce(f, 0) AS BIGINT) AS freq FROM range((SELECT CAST(max(i) + 1 AS BIGINT) FROM r WHERE f <> 0)) LEFT JOIN r ON i = range"


def _tree_query(name: str, last: str, *, pruned: bool = False):
    return _query(name, _tree_sql(last, pruned=pruned))


@_tree_query("tree_sfs", f"r AS (SELECT nl AS i, sum(mut) AS f FROM m GROUP BY 1) {_DENSE}")
def _(spark, d):
    return Lineage.build(_tree(spark, d)).site_spectrum()


@_tree_query("tree_mbd", f"r AS (SELECT tot AS i, count(*) AS f FROM m WHERE alive GROUP BY 1) {_DENSE}")
def _(spark, d):
    return Lineage.build(_tree(spark, d)).burden()


@_tree_query("tree_umbd", f"r AS (SELECT mut AS i, count(*) AS f FROM m GROUP BY 1) {_DENSE}")
def _(spark, d):
    return Lineage.build(_tree(spark, d)).edge_histogram()


@_tree_query("tree_umbd_pruned", f"r AS (SELECT mut AS i, count(*) AS f FROM m GROUP BY 1) {_DENSE}", pruned=True)
def _(spark, d):
    return Lineage.build(_tree(spark, d, pruned=True)).edge_histogram()


_BBM = """k AS (SELECT parent, max(nl) - min(nl) AS diff, max(nl) + min(nl) AS total FROM m WHERE parent IS NOT NULL GROUP BY 1 HAVING count(*) = 2),
r AS (SELECT m.tot AS i, avg(diff) AS md, avg(diff / total) AS mr FROM k JOIN m ON m.node = k.parent GROUP BY 1)
SELECT CAST(range AS BIGINT) AS idx, coalesce(round(md, 9), 0.0) AS mean_diff, coalesce(round(mr, 9), 0.0) AS mean_ratio FROM range((SELECT CAST(max(tot) + 1 AS BIGINT) FROM m)) LEFT JOIN r ON i = range"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("idx", F.round("mean_diff", 9).alias("mean_diff"), F.round("mean_ratio", 9).alias("mean_ratio"))


@_tree_query("tree_bbm", _BBM)
def _(spark, d):
    return _rounded(Lineage.build(_tree(spark, d)).balance())


@_tree_query("tree_bbm_pruned", _BBM, pruned=True)
def _(spark, d):
    return _rounded(Lineage.build(_tree(spark, d, pruned=True)).balance())


@_tree_query("tree_n_leaves", "z AS (SELECT 1) SELECT node, nl AS n_leaves FROM m")
def _(spark, d):
    return Lineage.build(_tree(spark, d)).n_leaves()


_CHILDREN = "z AS (SELECT 1) SELECT parent AS node, min(node) AS child1, max(node) AS child2 FROM m WHERE parent IS NOT NULL GROUP BY 1"


@_tree_query("tree_children", _CHILDREN)
def _(spark, d):
    return Lineage.build(_tree(spark, d)).children()


@_tree_query("tree_children_pruned", _CHILDREN, pruned=True)
def _(spark, d):
    return Lineage.build(_tree(spark, d, pruned=True)).children()


@_tree_query("tree_contracted", "z AS (SELECT 1) SELECT node, parent, mut AS unique_mutations, tot AS total_mutations FROM m", pruned=True)
def _(spark, d):
    return Lineage.build(_tree(spark, d, pruned=True)).contracted()


@_tree_query("tree_saved", "z AS (SELECT 1) SELECT node, nl AS n_leaves FROM m", pruned=True)
def _(spark, d):
    path = f"{_fresh_root(spark)}/tree"
    Lineage.build(_tree(spark, d, pruned=True)).save(path)
    return Lineage.load(spark, path).n_leaves()


@_tree_query("tree_euler_tour", """k AS (SELECT parent AS node, min(node) AS c1, max(node) AS c2 FROM m WHERE parent IS NOT NULL GROUP BY 1),
f(node, pos) AS (
  SELECT node, CAST(0 AS BIGINT) FROM m WHERE parent IS NULL
  UNION ALL SELECT x.node, f.pos + CASE WHEN x.node = k.c1 THEN 1 ELSE 4 * y.nl - 1 END FROM f JOIN k ON k.node = f.node JOIN m x ON x.parent = f.node JOIN m y ON y.node = k.c1)
SELECT pos, node FROM f
UNION ALL SELECT f.pos + 4 * y.nl - 2, f.node FROM f JOIN k ON k.node = f.node JOIN m y ON y.node = k.c1
UNION ALL SELECT f.pos + 4 * m.nl - 4, f.node FROM f JOIN k ON k.node = f.node JOIN m ON m.node = f.node""", pruned=True)
def _(spark, d):
    return Lineage.build(_tree(spark, d, pruned=True)).euler_tour()


@_query("node_ref_counts", "SELECT c.c_custkey AS node, CASE WHEN c.c_custkey > 0 THEN (c.c_custkey - 1) // 2 END AS parent, (SELECT count(*) FROM customer k WHERE k.c_custkey > 0 AND (k.c_custkey - 1) // 2 = c.c_custkey) AS ref_count FROM customer c")
def _(spark, d):
    return ref_counts(_tree(spark, d))


@_tree_query("pairwise_mutations_range", """c AS (SELECT x.node AS a, y.node AS b, max(m.tot) AS l FROM up x JOIN up y ON x.anc = y.anc AND x.node < y.node JOIN m ON m.node = x.anc WHERE x.node BETWEEN 20 AND 79 AND y.node BETWEEN 20 AND 79 GROUP BY 1, 2)
SELECT c.a, c.b, p.tot AS tot_a, q.tot AS tot_b, l AS tot_lca FROM c JOIN m p ON p.node = c.a JOIN m q ON q.node = c.b""")
def _(spark, d):
    return Lineage.build(_tree(spark, d)).pairwise_mutations(20, 80)


@_tree_query("tree_lca", """l AS (SELECT node FROM m WHERE alive), p AS (SELECT a.node AS a, b.node AS b FROM l a JOIN l b ON b.node = a.node + 7)
SELECT a, b, arg_max(x.node, m.depth) AS lca FROM p JOIN anc x ON x.leaf = a JOIN anc y ON y.leaf = b AND y.node = x.node JOIN m ON m.node = x.node GROUP BY a, b""")
def _(spark, d):
    tree = Lineage.build(_tree(spark, d))
    leaf = tree.nodes.where("alive").select("node")
    pairs = by_sort(leaf.select(F.col("node").alias("a"), (F.col("node") + 7).alias("b")), leaf.select(F.col("node").alias("b")), "b")
    return tree.lca(pairs.select("a", "b"))


_PAIRS = """c AS (SELECT a.leaf AS a, b.leaf AS b, max(m.tot) AS l FROM anc a JOIN anc b ON a.node = b.node AND a.leaf < b.leaf JOIN m ON m.node = a.node GROUP BY 1, 2),
q AS (SELECT x.tot + y.tot - 2 * l AS s, l FROM c JOIN m x ON x.node = a JOIN m y ON y.node = b)"""


@_tree_query("pair_distance_naive", f"{_PAIRS}, r AS (SELECT s AS i, count(*) AS f FROM q GROUP BY 1) {_DENSE}")
def _(spark, d):
    return Lineage.build(_tree(spark, d)).distance(pairwise=True)


@_tree_query("pair_distance_conv", f"{_PAIRS}, r AS (SELECT s AS i, count(*) AS f FROM q GROUP BY 1) {_DENSE}")
def _(spark, d):
    return Lineage.build(_tree(spark, d)).distance()


_JACCARD = f"{_PAIRS}, r AS (SELECT CASE WHEN s + l = 0 THEN 0 ELSE least(19, (20 * s) // (s + l)) END AS i, count(*) AS f FROM q GROUP BY 1) SELECT CAST(range AS INTEGER) AS bin, CAST(coalesce(f, 0) AS BIGINT) AS freq FROM range(20) LEFT JOIN r ON i = range"


@_tree_query("pair_jaccard", _JACCARD)
def _(spark, d):
    return Lineage.build(_tree(spark, d)).jaccard(20)


@_tree_query("pair_jaccard_naive", _JACCARD)
def _(spark, d):
    return Lineage.build(_tree(spark, d)).jaccard(20, pairwise=True)


def _sampled_sql() -> str:
    u = "CAST(('0x' || substr(sha256('tree-v1|{v}|' || CAST({k} AS VARCHAR) || '|' || CAST({n} AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0"
    draws = f"""pois(node, k, p) AS (
  SELECT c_custkey, 1, {u.format(v="mutations", k="c_custkey", n="1")} FROM customer WHERE c_custkey > 0
  UNION ALL SELECT node, k + 1, p * {u.format(v="mutations", k="node", n="k + 1")} FROM pois WHERE p > exp(-3.0)),
drawn AS (SELECT node, max(k) - 1 AS mut FROM pois GROUP BY 1),
inner_ AS (SELECT DISTINCT (c_custkey - 1) // 2 AS node FROM customer WHERE c_custkey > 0),
sampled AS (SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT node FROM inner_) ORDER BY {u.format(v="", k="c_custkey", n="0")}, c_custkey LIMIT 100),
t AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 0 THEN (c_custkey - 1) // 2 END AS parent, coalesce(drawn.mut, 0) AS mut, c_custkey IN (SELECT node FROM sampled) AS alive FROM customer LEFT JOIN drawn ON drawn.node = c_custkey),"""
    whole = _tree_sql(f"r AS (SELECT nl AS i, sum(mut) AS f FROM m GROUP BY 1) {_DENSE}")
    return "WITH RECURSIVE " + draws + whole[whole.index("\nanc(leaf") :]


@_query("tree_poisson_sampled_sfs", _sampled_sql())
def _(spark, d):
    tree = sample_leaves(with_poisson(_tree(spark, d), 3.0, "tree-v1"), 100, "tree-v1")
    return Lineage.build(tree).site_spectrum()


@_query(
    "range_minimum",
    """SELECT a.c_custkey AS lo, a.c_custkey + 9 AS hi, min(b.c_nationkey) AS val, arg_min(b.c_custkey, CAST(b.c_nationkey AS BIGINT) * 100000000 + b.c_custkey) AS pos
FROM customer a JOIN customer b ON b.c_custkey BETWEEN a.c_custkey AND a.c_custkey + 9 WHERE a.c_custkey + 9 <= (SELECT max(c_custkey) FROM customer) GROUP BY 1, 2""",
)
def _(spark, d):
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_nationkey").alias("val"))
    last = F.broadcast(rows.agg(F.max("pos").alias("last")))
    queries = rows.join(last, F.col("pos") + 9 <= F.col("last")).select(F.col("pos").alias("lo"), (F.col("pos") + 9).alias("hi"))
    return range_min(rows, queries, 10)


@_query(
    "range_minimum_blocks",
    """WITH r AS (SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS pos, c_nationkey AS val FROM customer)
SELECT a.pos AS lo, a.pos + 69 AS hi, min(b.val) AS val, arg_min(b.pos, CAST(b.val AS BIGINT) * 100000000 + b.pos) AS pos
FROM r a JOIN r b ON b.pos BETWEEN a.pos AND a.pos + 69 WHERE a.pos % 5 = 0 AND a.pos + 69 <= (SELECT max(pos) FROM r) GROUP BY 1, 2""",
)
def _(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("val"))
    ends = F.broadcast(c.agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high")))
    rows = c.join(ends).select((F.col("c_custkey") - F.col("low")).alias("pos"), "val", (F.col("high") - F.col("low")).alias("last"))
    queries = rows.where("pos % 5 = 0 and pos + 69 <= last").select(F.col("pos").alias("lo"), (F.col("pos") + 69).alias("hi"))
    return block_range_min(rows.select("pos", "val"), queries, 70)


@_query("bit_fields", "SELECT o_orderkey, (o_orderkey >> 3) & 31 AS field, CAST(bit_count(o_orderkey & 248) AS INTEGER) AS ones, o_orderkey | 248 AS filled, o_orderkey & ~248 AS cleared, xor(o_orderkey, 248) AS flipped, (o_orderkey & ~248) | (o_custkey % 32) * 8 AS written FROM orders")
def _(spark, d):
    f, word = bits.BitField(3, 5), F.col("o_orderkey")
    return _t(spark, d, "orders").select("o_orderkey", f.read(word).alias("field"), f.ones(word).alias("ones"), f.fill(word).alias("filled"), f.clear(word).alias("cleared"), f.flip(word).alias("flipped"), f.write(word, F.col("o_custkey")).alias("written"))


# Keys


@_query("key_i64", "SELECT c_custkey, printf('%016x', xor(CAST(c_custkey AS BIGINT), CAST(-9223372036854775808 AS BIGINT))) AS key FROM customer")
def _(spark, d):
    return keys.with_key(_t(spark, d, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.lower(F.hex("key")).alias("key"))


@_query("key_struct", "SELECT c_custkey, printf('%08x', CAST(c_nationkey AS BIGINT) + 2147483648) || printf('%016x', xor(CAST(c_custkey AS BIGINT), CAST(-9223372036854775808 AS BIGINT))) AS key FROM customer")
def _(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", F.struct("c_nationkey", "c_custkey").alias("s"))
    return keys.with_key(rows, "s").select("c_custkey", F.lower(F.hex("key")).alias("key"))


@_query("key_double_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos FROM orders")
def _(spark, d):
    rows = keys.with_key(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")
    return flow.numbered(rows.select("o_orderkey", "key").orderBy("key")).select("o_orderkey", "pos")


@_query("key_bool", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '01' ELSE '00' END AS key FROM orders")
def _(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3 == 0).alias("b"))
    return keys.with_key(rows, "b").select("o_orderkey", F.hex("key").alias("key"))


@_query("key_unsigned_64", "SELECT o_orderkey, printf('%016x', CAST(18446744073709551615 - o_orderkey AS UBIGINT)) AS key FROM orders")
def _(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", (F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("o_orderkey")).cast("decimal(20,0)").alias("u"))
    return keys.with_key(rows, "u").select("o_orderkey", F.lower(F.hex("key")).alias("key"))


@_query("key_wide", "SELECT c_custkey, printf('%016x', xor(CAST(-c_custkey AS BIGINT), CAST(-9223372036854775808 AS BIGINT))) || printf('%016x', CAST(c_custkey * 977 AS BIGINT)) AS key FROM customer")
def _(spark, d):
    c = F.col("c_custkey").cast("bigint")
    return _t(spark, d, "customer").select("c_custkey", F.lower(F.hex(keys.key_wide(-c, c * 977, signed=True))).alias("key"))


@_query("key_array", "SELECT c_custkey, printf('%08x', CAST(c_nationkey AS BIGINT) + 2147483648) || printf('%08x', CAST(-c_nationkey AS BIGINT) + 2147483648) AS key FROM customer")
def _(spark, d):
    n = F.col("c_nationkey").cast("int")
    rows = _t(spark, d, "customer").select("c_custkey", F.array(n, -n).alias("a"))
    return keys.with_key(rows, "a", array_length=2).select("c_custkey", F.lower(F.hex("key")).alias("key"))


_K8 = "printf('%016x', xor(CAST({} AS BIGINT), CAST(-9223372036854775808 AS BIGINT)))"


@_query("key_dependent", f"""SELECT l_orderkey, l_linenumber, {_K8.format('l_partkey')} || {_K8.format('l_orderkey')} || printf('%016x', CAST(l_linenumber AS BIGINT)) AS key,
{_K8.format('l_orderkey')} || printf('%016x', CAST(l_linenumber AS BIGINT)) AS source FROM lineitem""")
def _(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("bigint"), "l_linenumber", F.col("l_partkey").cast("bigint"))
    key = keys.key_dependent(rows, ["l_partkey"], keys.key_stochastic(rows, ["l_orderkey"], "l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", F.lower(F.hex(key)).alias("key"), F.lower(F.hex(keys.source_part(key, 8, 16))).alias("source"))


# Random streams

_U = "CAST(('0x' || substr(sha256('demo-v1|{v}|' || CAST({k} AS VARCHAR) || '|' || CAST({n} AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0"


@_query("rand_uniform", f"SELECT c_custkey, {_U.format(v='a', k='c_custkey', n='0')} AS a, {_U.format(v='b', k='c_custkey', n='0')} AS b FROM customer")
def _(spark, d):
    u = rand.uniforms("demo-v1", ["a", "b"], F.col("c_custkey"))
    return _t(spark, d, "customer").select("c_custkey", *[c.alias(n) for n, c in u.items()])


@_query("sample_without_replacement", f"SELECT c_custkey FROM customer ORDER BY {_U.format(v='', k='c_custkey', n='0')}, c_custkey LIMIT 100")
def _(spark, d):
    return rand.sample_rows(_t(spark, d, "customer").select("c_custkey"), "c_custkey", 100, "demo-v1")


@_query(
    "poisson_knuth",
    f"""WITH RECURSIVE r(c_custkey, k, p) AS (
  SELECT c_custkey, 1, {_U.format(v="p", k="c_custkey", n="1")} FROM customer
  UNION ALL SELECT c_custkey, k + 1, p * {_U.format(v="p", k="c_custkey", n="k + 1")} FROM r WHERE p > exp(-5.0))
SELECT c_custkey, CAST(max(k) - 1 AS BIGINT) AS n FROM r GROUP BY 1""",
)
def _(spark, d):
    return _t(spark, d, "customer").select("c_custkey", rand.poisson(5.0, "demo-v1", "p", F.col("c_custkey")).alias("n"))


# Stages and stores


@_query("repeated_inputs", "SELECT CAST(r_regionkey AS INTEGER) AS r_regionkey, CAST(range AS BIGINT) AS repetition_index, CAST(r_regionkey * 4 + range AS BIGINT) AS ordinal FROM region, range(4)")
def _(spark, d):
    return flow.repeated(_t(spark, d, "region").select("r_regionkey"), 4, ordinal="r_regionkey")


def _fresh_root(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/stores-{uuid.uuid4().hex}"


@_query("get_or_compute", "SELECT p_partkey, p_size * 3 + p_partkey AS value FROM part")
def _(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_size")
    compute = lambda rows: rows.select("p_partkey", (F.col("p_size") * 3 + F.col("p_partkey")).alias("value"))
    store = st.ParquetStore(spark, _fresh_root(spark), rand.path_of("part-v1"))
    store.append(compute(part.where("p_partkey % 2 = 0")), ["p_partkey"])
    return flow.get_or_compute(part, ["p_partkey"], store, compute).select("p_partkey", "value")


@_query("derived_param", "SELECT r_regionkey, p_partkey, 2 * (p_size + 1) + r_regionkey AS value FROM region, part")
def _(spark, d):
    root = _fresh_root(spark)
    part = _t(spark, d, "part").select("p_partkey", "p_size")
    source = flow.Stage("source-v1", lambda rows: rows.join(part, "p_partkey").withColumn("size1", F.col("p_size") + 1).drop("p_size"), ["p_partkey"], st.ParquetStore(spark, root, "source-v1"))
    path = rand.path_of("source-v1", "twice-v1")
    twice = source.derive("twice-v1", lambda rows: rows.withColumn("value", 2 * F.col("size1") + F.col("r_regionkey")), params=["r_regionkey"], store=st.ParquetStore(spark, root, path))
    inputs = _t(spark, d, "region").select("r_regionkey").crossJoin(part.select("p_partkey"))
    return twice.run(inputs).select("r_regionkey", "p_partkey", "value")


@_query("stage_errors", "SELECT p_partkey, p_size % 7 <> 0 AS ok, CASE WHEN p_size % 7 <> 0 THEN CAST(1000 // (p_size % 7) AS BIGINT) END AS value, CASE WHEN p_size % 7 = 0 THEN 'division by zero' END AS error FROM part UNION ALL SELECT NULL, true, CAST(0 AS BIGINT), NULL")
def _(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("p_partkey"), F.col("p_size").cast("bigint").alias("p_size"))
    inputs = part.unionByName(spark.createDataFrame([(None, 1001)], "p_partkey bigint, p_size bigint"))
    left = F.col("p_size") % 7
    value = F.when(F.col("p_partkey").isNull(), F.lit(0).cast("bigint")).when(left != 0, F.floor(1000 / left))
    bad = F.when(F.col("p_partkey").isNotNull() & (left == 0), F.lit("division by zero"))
    stage = flow.Stage("divide-v1", lambda rows: rows.select("p_partkey", value.alias("value"), bad.alias("error")), ["p_partkey"], st.ParquetStore(spark, _fresh_root(spark), "divide-v1"))
    stage.results(inputs).count()  # the second pass takes the good ones from the store and fails the others again
    return stage.results(inputs).select("p_partkey", "ok", "value", "error")


_STREAM = "CAST(('0x' || substr(sha256('{p}|{v}|' || {k} || '|' || CAST({n} AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0"
_REP = "CAST(p_partkey AS VARCHAR) || '/' || CAST(r AS VARCHAR)"


@_query("stochastic_stage", f"""WITH i AS (SELECT p_partkey, CAST(range AS BIGINT) AS r FROM part, range(3) WHERE p_partkey % 4 = 0),
w AS (SELECT *, {_STREAM.format(p='walk-v1', v='step', k=_REP, n=0)} + {_STREAM.format(p='walk-v1', v='step', k=_REP, n=1)} AS walk, {_STREAM.format(p='walk-v1', v='noise', k=_REP, n=0)} AS noise FROM i)
SELECT p_partkey, r AS repetition_index, scale, round(walk, 9) AS walk, round(noise, 9) AS noise, round(walk * scale + {_STREAM.format(p='jitter-v1_walk-v1', v='jump', k="CAST(scale AS VARCHAR) || '/' || " + _REP, n=0)}, 9) AS moved
FROM w, (SELECT CAST(unnest([2, 5]) AS INTEGER) AS scale)""")
def _(spark, d):
    provider = st.Provider(spark, "parquet", root=_fresh_root(spark))
    walk = flow.stochastic("walk-v1", lambda rows, draw: rows.withColumns({"walk": draw("step") + draw("step", 1), "noise": draw("noise")}), ["p_partkey", "repetition_index"], ("step", "noise"), provider.bind("walk-v1"))
    moved = walk.derive("jitter-v1", lambda rows, draw: rows.withColumn("moved", F.col("walk") * F.col("scale") + draw("jump")), params=["scale"], store=provider.bind("jitter-v1_walk-v1"), streams=("jump",))
    params = flow.repeated(_t(spark, d, "part").where("p_partkey % 4 = 0").select("p_partkey"), 3)
    inputs = params.withColumn("scale", F.explode(F.array(F.lit(2), F.lit(5))))
    out = walk.run(moved.run(inputs))
    return out.select("p_partkey", "repetition_index", "scale", *[F.round(c, 9).alias(c) for c in ("walk", "noise", "moved")])


@_query("lru_store", "WITH k AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, n <= 10 OR n BETWEEN 31 AND 70 AS held FROM k WHERE n <= 80")
def _(spark, d):
    store = st.LruStore(50)
    part = _t(spark, d, "part").orderBy("p_partkey").limit(80).select("p_partkey")
    first = written(part.withColumn("n", F.row_number().over(Window.orderBy("p_partkey"))), "first")
    twice = lambda rows: rows.select("p_partkey", (F.col("p_partkey") * 2).alias("v"))
    for low, high in ((1, 40), (31, 70)):  # 40 keys, then 10 of these again and 30 more: 20 of the first must go
        flow.get_or_compute(first.where(F.col("n").between(low, high)).select("p_partkey"), ["p_partkey"], store, twice).count()
    held = store.read(["p_partkey"]).select("p_partkey", F.lit(True).alias("held"))
    return first.join(held, "p_partkey", "left").select("p_partkey", F.coalesce("held", F.lit(False)).alias("held"))


@_query("corrupt_is_miss", "SELECT p_partkey, CAST(p_size * 3 AS BIGINT) AS value, p_partkey % 5 = 0 AS computed FROM part")
def _(spark, d):
    part = _t(spark, d, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("p_size"))
    plain = st.MemoryStore()
    store = st.EncodedStore(plain, st.Codec(st.CompressPolicy("zstd", min_len=64)))
    compute = lambda mark: lambda rows: rows.select("p_partkey", (F.col("p_size") * 3).alias("value"), F.lit(mark).alias("computed"))
    store.append(compute(False)(part), ["p_partkey"])
    hurt = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.substring("frame", 1, 7), F.unhex(F.lit("00")))).otherwise(F.col("frame"))
    plain.append(plain.read(["p_partkey"]).withColumn("frame", hurt), ["p_partkey"])
    return flow.get_or_compute(part, ["p_partkey"], store, compute(True)).select("p_partkey", "value", "computed")


@_query("store_scan", "SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) AS pos FROM part")
def _(spark, d):
    store = st.ParquetStore(spark, _fresh_root(spark), "part-v1")
    part = _t(spark, d, "part").select("p_partkey", "p_size")
    store.append(part.withColumn("p_size", F.lit(0).cast(part.schema["p_size"].dataType)), ["p_partkey"])
    store.append(part, ["p_partkey"])
    store.compact(["p_partkey"])
    return flow.numbered(store.scan(["p_partkey"])).select("p_partkey", "p_size", "pos")


@_query("store_transcode", "SELECT count(*) FILTER (p_size > 10) AS migrated, count(*) FILTER (p_size <= 10) AS skipped, CAST(sum(p_size * 2) FILTER (p_size > 10) AS BIGINT) AS total FROM part")
def _(spark, d):
    root, part = _fresh_root(spark), _t(spark, d, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("p_size"))
    a, b = (st.ParquetStore(spark, root, "part-v1", f) for f in ("plain-v1", "twice-v1"))
    a.append(part, ["p_partkey"])
    s = st.transcode_store(a, b, ["p_partkey"], lambda rows: rows.withColumn("refused", F.col("p_size") <= 10).withColumn("p_size", F.col("p_size") * 2))
    return b.read(["p_partkey"]).agg(F.sum("p_size").alias("total")).select(F.lit(s["migrated"]).cast("bigint").alias("migrated"), F.lit(s["skipped"]).cast("bigint").alias("skipped"), "total")


@_query("compressed_frames", "SELECT doc_id, 'ok' AS status, text FROM documents")
def _(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", st.framed(F.encode("text", "utf-8"), st.CompressPolicy("lz4", min_len=200)).alias("frame"))
    return rows.select("doc_id", st.unframed(F.col("frame")).alias("r")).select("doc_id", "r.status", F.decode("r.value", "utf-8").alias("text"))


@_query("bounded_cache_lru", "SELECT user_id, max(event_id) AS last FROM events GROUP BY 1 ORDER BY last DESC LIMIT 50")
def _(spark, d):
    return st.keep_recent(_t(spark, d, "events"), "user_id", "event_id", 50)


@_query("checked_frames", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'checksum' WHEN event_id % 3 = 1 THEN 'truncated' ELSE 'ok' END AS status FROM events")
def _(spark, d):
    rows = _t(spark, d, "events").select("event_id", st.checked(F.encode("props", "utf-8")).alias("frame"))
    flipped = F.concat(F.unhex(F.hex(F.hex("frame"))), F.unhex(F.lit("00")))
    damaged = F.when(F.col("event_id") % 3 == 0, flipped).when(F.col("event_id") % 3 == 1, F.substring("frame", 1, 3)).otherwise(F.col("frame"))
    return rows.select("event_id", st.unchecked(damaged)[1].alias("status"))


@_query("store_migration", "SELECT count(*) AS migrated, CAST(0 AS BIGINT) AS skipped, CAST(sum(p_size) AS BIGINT) AS total FROM part")
def _(spark, d):
    root, part = _fresh_root(spark), _t(spark, d, "part").select("p_partkey", "p_size")
    a, b = (st.ParquetStore(spark, root, "part-v1", f) for f in ("plain-v1", "plain-v2"))
    a.append(part, ["p_partkey"])
    a.append(part, ["p_partkey"])
    s = st.copy_store(a, b, ["p_partkey"])
    return b.read(["p_partkey"]).agg(F.sum("p_size").alias("total")).select(F.lit(s["migrated"]).cast("bigint").alias("migrated"), F.lit(s["skipped"]).cast("bigint").alias("skipped"), "total")


# Checks


@_query("violations_range", "SELECT l_orderkey, l_linenumber, l_partkey, 'invalid parameter `discount`: expected in [0.0, 0.05), got ' || CAST(l_discount AS VARCHAR) AS violation FROM lineitem WHERE NOT (l_discount >= 0.0 AND l_discount < 0.05)")
def _(spark, d):
    rule = checks.Rule("l_discount", ((">=", 0.0), ("<", 0.05)), name="discount")
    return checks.violations(_t(spark, d, "lineitem"), rule).select("l_orderkey", "l_linenumber", "l_partkey", "violation")


@_query("violations_nested", "SELECT o_orderkey, 'invalid parameter `order.price`: expected < 50000.0, got ' || CAST(o_totalprice AS VARCHAR) AS violation FROM orders WHERE NOT o_totalprice < 50000.0")
def _(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("order"))
    rules = checks.Rule("order.price", (("<", 50000.0),)), checks.Rule("order.status", ((">=", "A"),))
    return checks.violations(rows, *rules).select("o_orderkey", "violation")


@_query("passing_rows", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 1000.0 AND o_totalprice <= 100000.0 AND length(o_orderstatus) = 1")
def _(spark, d):
    rules = checks.Rule("o_totalprice", ((">", 1000.0), ("<=", 100000.0))), checks.Rule("o_orderstatus", predicate=F.length("o_orderstatus") == 1, expected="one letter")
    return checks.passing(_t(spark, d, "orders"), *rules).agg(F.count("*").alias("n"))
