"""Connected components: one identifier for all that is linked, directly or through others.

Edges lie on a two-dimensional grid: both ends are hashed into blocks, and the
cell (block of one end, block of the other) gets the edge. So the edges of a hub
spread over a whole row of cells. Each cell runs union-find over its own edges
and keeps one edge per vertex, to the representative of its component. The
representatives that a vertex got in its row and its column are then exchanged:
the one of least priority becomes its parent. With every vertex moved on to its
parent's parent, the links that are left are the edges of the next round, until
there are none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.scratch import stage


def local_union(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over one cell: each vertex with the one of least priority in its component, which has itself."""
    vertices, first, codes = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
    rank = np.empty(len(vertices), np.int64)
    order = np.argsort(np.concatenate([pa_, pb])[first], kind="stable")
    rank[order] = np.arange(len(vertices))
    parent = np.arange(len(vertices))
    x, y = rank[codes[: len(a)]], rank[codes[len(a) :]]
    while len(x):
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:  # halve the paths
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        x, y = parent[x], parent[y]
        left = x != y
        x, y = x[left], y[left]
    return vertices[order], vertices[order[parent]]


def _cell_stars(edges: DataFrame, blocks: int, seed: int) -> DataFrame:
    """(v, r): per grid cell, each vertex with its representative."""

    def run(key, t):
        v, r = local_union(*(t.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "pa", "pb")))
        return pa.table({"v": pa.array(v, pa.string()), "r": pa.array(r, pa.string())})

    p = lambda c: F.xxhash64(c, F.lit(seed))
    cell = F.pmod(p("a"), F.lit(blocks)) * blocks + F.pmod(p("b"), F.lit(blocks))
    return edges.select("a", "b", p("a").alias("pa"), p("b").alias("pb"), cell.alias("cell")).groupBy("cell").applyInArrow(run, "v string, r string")


def connected_components(edges: DataFrame, cell_edges: int = 50_000, max_rounds: int = 60) -> DataFrame:
    """(v, component) for each vertex of ``edges(a, b)`` that is linked to another one.

    ``component`` is one of its vertices, the same for all. Edges may be repeated,
    run in either direction or join a vertex to itself; those with a null end are
    ignored. No edges give an empty result. Vertices are strings. The grid of each
    round is as fine as its number of edges asks for, ``cell_edges`` a cell; the
    priorities by which representatives are chosen are drawn anew each round, so
    that long chains shrink by a constant factor too.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    # a pair that is repeated a billion times is one edge, reduced where it is read
    e = stage(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    for k in range(max_rounds):
        n = e.count()
        if not n:
            break
        blocks = max(1, math.ceil(math.sqrt(n / cell_edges)))
        stars = stage(_cell_stars(e, blocks, k), f"stars{k}")
        if blocks == 1:  # one cell saw every edge
            maps.append(stars.select("v", F.col("r").alias("p")))
            break
        least = stars.groupBy("v").agg(F.min(F.struct(F.xxhash64("r", F.lit(k)).alias("h"), "r"))["r"].alias("p"))
        least = stage(least, f"parents{k}")
        jump = least.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        twice = stage(least.join(jump, "p").select("v", F.col("pp").alias("p")), f"jumped{k}")
        maps.append(twice)
        # what the stars link stays linked: both ends move on to their parents
        to = lambda c, new: twice.select(F.col("v").alias(c), F.col("p").alias(new))  # noqa: B023, E731
        moved = stars.where("v <> r").join(to("v", "x"), "v").join(to("r", "y"), "r").where("x <> y")
        e = stage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"links{k}")
    else:
        raise RuntimeError(f"parents have not stabilised after {max_rounds} rounds")
    if not maps:
        return edges.sparkSession.createDataFrame([], "v string, component string")
    up = maps[-1].select("v", F.col("p").alias("component"))
    for m in reversed(maps[:-1]):  # the representatives of a round are the vertices of the next
        top = up.select(F.col("v").alias("p"), "component")
        up = stage(m.join(top, "p", "left").select("v", F.coalesce("component", "p").alias("component")), "labels")
    return up
