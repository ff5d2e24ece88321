"""Birth-death trees, one tree for each group, with draws that depend on (path, tree, attempt, step) only."""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

TREE_SCHEMA = "tree_id bigint, node bigint, parent bigint, mut bigint, alive boolean"


def _draws(path: str, tree: int, attempt: int):
    n = 0
    while True:
        block = hashlib.blake2b(struct.pack("<qqq", tree, attempt, n), key=path.encode()[:64]).digest()
        for k in range(8):
            yield (int.from_bytes(block[8 * k : 8 * k + 8], "little") >> 11) / 2.0**53
        n += 1


class Cells:
    """Living cells. With ``lineage`` every division makes two daughters of the dividing node; without, cells are only counted."""

    def __init__(self, lineage: bool = True):
        self.parent: list[int] | None = [-1] if lineage else None
        self.alive: list[int] = [0]

    def __len__(self) -> int:
        return len(self.alive)

    def divide(self, node: int) -> tuple[int, int]:
        """The two daughters of a node."""
        if self.parent is None:
            return 0, 0
        self.parent += [node, node]
        return len(self.parent) - 2, len(self.parent) - 1

    def divide_at(self, i: int) -> None:
        """The i-th cell divides: one daughter takes its place, the other comes last."""
        self.alive[i], other = self.divide(self.alive[i])
        self.alive.append(other)

    def remove_at(self, i: int) -> None:
        """The i-th cell dies: the last one takes its place."""
        self.alive[i] = self.alive[-1]
        self.alive.pop()


def _grow(path: str, tree: int, birth: float, death: float, max_cells: int, min_survivors: int, max_attempts: int, lineage: bool) -> tuple[Cells, int]:
    if not birth > 0 or death < 0 or min_survivors > max_cells:
        raise ValueError("needs birth > 0, death >= 0 and min_survivors <= max_cells")
    for attempt in range(max_attempts):
        draw, cells = _draws(path, tree, attempt), Cells(lineage)
        while 0 < len(cells) < max_cells:
            born = next(draw) < birth / (birth + death)
            i = int(next(draw) * len(cells))
            cells.divide_at(i) if born else cells.remove_at(i)
        if len(cells) >= min_survivors:
            return cells, attempt
    raise RuntimeError(f"no run of {max_attempts} left {min_survivors} cells or more")


def birth_death(path: str, tree: int, birth: float, death: float, max_cells: int, min_survivors: int = 0, max_attempts: int = 10_000) -> pd.DataFrame:
    """The tree's rows: each event is a birth with chance birth / (birth + death) of a uniform cell, else a death.

    Stops at extinction or ``max_cells``; tries again until ``min_survivors`` cells are left, ``max_attempts`` times at most.
    """
    cells, _ = _grow(path, tree, birth, death, max_cells, min_survivors, max_attempts, True)
    alive = set(cells.alive)
    n = len(cells.parent)
    return pd.DataFrame({"tree_id": tree, "node": range(n), "parent": pd.array([None if p < 0 else p for p in cells.parent], "Int64"), "mut": [0] + [1] * (n - 1), "alive": [k in alive for k in range(n)]})


def population_sizes(params: DataFrame, path: str, max_attempts: int = 10_000) -> DataFrame:
    """(tree_id, cells, attempts) of the same runs without lineages, one for each row of ``params``."""

    def run(batches):
        for b in batches:
            got = [_grow(path, int(r["tree_id"]), float(r["birth"]), float(r["death"]), int(r["max_cells"]), int(r["min_survivors"]), max_attempts, False) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pydict({"tree_id": b.column("tree_id").cast(pa.int64()), "cells": pa.array([len(c) for c, _ in got], pa.int64()), "attempts": pa.array([a + 1 for _, a in got], pa.int64())})

    return params.select("tree_id", "birth", "death", "max_cells", "min_survivors").mapInArrow(run, "tree_id bigint, cells bigint, attempts bigint")


def simulate_trees(params: DataFrame, path: str) -> DataFrame:
    """Rows of one tree for each row (tree_id, birth, death, max_cells, min_survivors) of ``params``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        return birth_death(path, int(r.tree_id), float(r.birth), float(r.death), int(r.max_cells), int(r.min_survivors))

    return params.groupBy("tree_id").applyInPandas(one, TREE_SCHEMA)
