import re

import numpy as np
import pyarrow as pa

from brindle.llm import textscan as ts
from brindle.llm.tables import Scratch, connected_components, possibly_in

TEXTS = ["", None, "a", "  Foo\tbar\x0bBAZ é日本 x ", "one two three four five six", "é" * 50, " \n ", "x" * 5000 + " y"]


def test_words_are_those_of_the_rule():
    seen = 0
    for i, j, raw, at in ts.blocks(pa.array(TEXTS), 60):
        w = ts.words(ts.lower_ascii(raw), at)
        for d in range(j - i):
            want = re.findall(rb"[^\x20\x09-\x0D]+", (TEXTS[i + d] or "").encode().lower())
            got = [ts.lower_ascii(raw)[a:b].tobytes() for a, b in zip(w.starts[w.first[d] : w.first[d + 1]], w.ends[w.first[d] : w.first[d + 1]], strict=True)]
            assert got == want
            seen += 1
    assert seen == len(TEXTS)


def test_equal_spans_have_equal_hashes_anywhere():
    raw = np.frombuffer(b"abcabcabd", np.uint8)
    s = ts.prefix_sums(raw)
    h = ts.span_hashes(s, np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert h[0] == h[1] != h[2]


def test_shingles_count_and_short_texts():
    for text, n in (("a b c d e", 2), ("a b", 1), ("", 0), ("a a a a a a", 1)):
        (_, _, raw, at), = ts.blocks(pa.array([text]))
        w = ts.words(raw, at)
        h, begin = ts.shingles(w.hashes, w.first, 4)
        assert len(np.unique(h[begin[0] : begin[1]])) == n


def test_components_both_ways(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (80, 2))] + [(500 + i, 501 + i) for i in range(12)]
    df = spark.createDataFrame(edges, "a long, b long")
    s = Scratch(spark)
    few = {tuple(r) for r in connected_components(df, s).collect()}
    many = {tuple(r) for r in connected_components(df, s, few=0).collect()}
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        top[max(find(a), find(b))] = min(find(a), find(b))
    want = {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    assert few == many == want


def test_bitmap_loses_no_key_and_splits(spark):
    df, keys = spark.range(5000), spark.range(0, 5000, 31)
    kept, rest = possibly_in(df, keys, "id"), possibly_in(df, keys, "id", inverse=True)
    assert kept.count() + rest.count() == 5000
    assert keys.join(kept, "id", "left_anti").count() == 0
