"""Problem 6: the most similar vectors of every vector, by an inverted multi-index.

Each vector is cut into two halves and each half is quantised by its own
centroids, learnt from a bounded sample; a pair of centroids names a cell, and
every vector is filed under its cell. A query ranks the centroids of each half by
distance and walks the pairs in order of summed distance, with a heap, until the
cells seen hold enough entries; those entries are then ranked by cosine. A search
for all pairs above a cosine counts nothing: it leaves out only cells whose
distance rules such a cosine out, so no pair is lost however the vectors lie.

The first half's centroids are gathered into groups of about ``block_rows``
entries. A query travels to the groups its cells lie in, not to single cells, and
a group that is too large (many vectors in one cell) is cut into sub-blocks of
entries and of queries, so that no task holds more than a block of each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.scratch import stage

#: Bound of the sample per space that the centroids are learnt from.
SAMPLE_ROWS = 10_000
MAX_CENTROIDS = 256
_VECTORS = "space string, id string, dim int, vec binary"


@dataclass(frozen=True)
class Space:
    """Centroids and cell counts of the vectors that are comparable: one table and model."""

    dim: int
    n: int
    first: np.ndarray  # centroids of the first half
    second: np.ndarray
    cells: np.ndarray  # entries per cell, first x second
    group_of: np.ndarray  # group of each first centroid
    parts: np.ndarray  # sub-blocks of each group


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(space, id, dim, vec) of the usable ``rows(space, id, embedding)``: scaled to length 1, as float32 bytes.

    Null, empty, all-zero, NaN and infinite vectors are left out, as are those
    with a null id or without the usual size (the most frequent, of several the
    larger) of their space.
    """

    def run(batches):
        for b in batches:
            v = b.column(2)
            starts = v.offsets.to_numpy()
            flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            size = np.diff(starts)
            keep = np.flatnonzero((size > 0) & ~np.asarray(v.is_null()))
            out = []
            for i in keep:
                x = flat[starts[i] : starts[i + 1]]
                n = np.sqrt(x @ x)
                out.append((x / n).astype(np.float32).tobytes() if 0 < n < np.inf else None)
            t = pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), pa.array(size[keep], pa.int32()), pa.array(out, pa.binary())],
                ["space", "id", "dim", "vec"],
            )
            yield t.filter(pa.array([x is not None for x in out], pa.bool_()))

    named = rows.where("id is not null and embedding is not null").select(F.coalesce("space", F.lit("")).alias("space"), F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>"))
    return named.mapInArrow(run, _VECTORS)


def _means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means from k sample rows; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.argmin(-2 * x @ c.T + (c * c).sum(1), axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], axis=1)
        c[n > 0] = (total[n > 0] / n[n > 0, None]).astype(np.float32)
    return c


def _matrix(column, dim: int) -> np.ndarray:
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int32)
    raw = np.frombuffer(data.buffers()[2], np.uint8)[at[0] : at[-1]] if len(data) else np.zeros(0, np.uint8)
    kind = np.float32 if not len(data) or (at[1] - at[0]) == 4 * dim else np.float16
    return raw.view(kind).reshape(-1, dim).astype(np.float32)


def _codes(x: np.ndarray, s: Space) -> np.ndarray:
    h = s.dim // 2
    a = np.argmin(-2 * x[:, :h] @ s.first.T + (s.first * s.first).sum(1), axis=1)
    b = np.argmin(-2 * x[:, h:] @ s.second.T + (s.second * s.second).sum(1), axis=1)
    return a * len(s.second) + b


def fit(vectors: DataFrame, block_rows: int, per_cell: int, most_cells: int = MAX_CENTROIDS**2) -> tuple[dict[str, Space], DataFrame]:
    """Centroids of each space, and the vectors of usual size with their cell."""
    sizes = vectors.groupBy("space", "dim").agg(F.count("*").alias("n"))
    usual = sizes.groupBy("space").agg(F.max(F.struct("n", "dim")).alias("m")).select("space", "m.*").collect()  # one row a space
    if not usual:
        return {}, vectors.withColumn("cell", F.lit(0))
    take, same = F.lit(False), F.lit(False)
    for r in usual:
        own = (F.col("space") == r["space"]) & (F.col("dim") == r["dim"])
        same = same | own
        take = take | (own & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1e6 * min(1.0, SAMPLE_ROWS / r["n"]))))
    sample = vectors.where(take).select("space", "id", "vec").toArrow().to_pandas().sort_values(["space", "id"])
    learnt: dict[str, tuple] = {}
    for k, r in enumerate(sorted(usual, key=lambda r: r["space"])):
        x = np.stack([np.frombuffer(v, np.float32) for v in sample.vec[sample.space == r["space"]]] or [np.zeros(r["dim"], np.float32)])
        n_c = int(min(MAX_CENTROIDS, max(1, len(x) // 8), max(2, round(np.sqrt(min(most_cells, r["n"] / per_cell))))))
        h = r["dim"] // 2
        learnt[r["space"]] = (r["dim"], r["n"], _means(x[:, :h], n_c, 2 * k), _means(x[:, h:], n_c, 2 * k + 1))
    bare = {s: Space(d, n, a, b, np.zeros(0), np.zeros(0), np.zeros(0)) for s, (d, n, a, b) in learnt.items()}

    def file(batches):
        for b in batches:
            names = np.array(b.column(0).to_pylist())
            cell = np.zeros(b.num_rows, np.int32)
            for s in np.unique(names):
                own = np.flatnonzero(names == s)
                cell[own] = _codes(_matrix(b.column(3).take(pa.array(own)), bare[s].dim), bare[s])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["space", "id", "dim", "vec", "cell"])

    filed = stage(vectors.where(same).mapInArrow(file, _VECTORS + ", cell int"), "filed")
    counts: dict[str, np.ndarray] = {s: np.zeros(len(x.first) * len(x.second), np.int64) for s, x in bare.items()}
    # at most MAX_CENTROIDS squared rows a space
    got = filed.groupBy("space", "cell").count().toArrow().to_pandas()
    for s, part in got.groupby("space"):
        counts[s][part.cell.to_numpy()] = part["count"].to_numpy()
    out = {}
    for s, x in bare.items():
        cells = counts[s].reshape(len(x.first), len(x.second))
        rows = cells.sum(1)
        # neighbouring centroids share a group: they are taken in the order of their main axis
        centred = x.first - x.first.mean(0)
        order = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0]) if len(x.first) > 1 else np.zeros(1, int)
        group_of = np.zeros(len(x.first), np.int32)
        group_of[order] = np.minimum((np.cumsum(rows[order]) - rows[order]) // block_rows, len(x.first)).astype(np.int32)
        size = np.bincount(group_of, weights=rows)
        out[s] = Space(x.dim, x.n, x.first, x.second, cells, group_of, np.maximum(1, np.ceil(size / (2 * block_rows))).astype(np.int32))
    return out, filed


def walk(d1: np.ndarray, d2: np.ndarray, cells: np.ndarray, enough: int) -> list[int]:
    """Cells in order of summed distance, by a heap over the two ranked halves, until they hold ``enough`` entries."""
    o1, o2 = np.argsort(d1), np.argsort(d2)
    a, b = d1[o1].tolist(), d2[o2].tolist()
    r1, r2 = o1.tolist(), o2.tolist()
    wide, found, held = len(b), [], 0
    heap, reach = [(a[0] + b[0], 0, 0)], [0] * len(a)  # reach: next rank of the second half to enter, by rank of the first
    reach[0] = 1
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        n = cells[r1[i]][r2[j]]
        if n:
            found.append(r1[i] * wide + r2[j])
            held += n
        if j + 1 < wide and reach[i] == j + 1 and (i == 0 or reach[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            reach[i] = j + 2
        if i + 1 < len(a) and reach[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
            reach[i + 1] = j + 1
    return found


def _route(filed: DataFrame, spaces: dict[str, Space], enough: dict[str, int], queries) -> DataFrame:
    """(space, grp, se, sq, role, id, vec, cells): entries and queries at the blocks where they meet."""
    lists = {s: x.cells.tolist() for s, x in spaces.items()}

    def run(batches):
        for b in batches:
            names, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            own_cell, asks = b.column(4).to_pylist(), b.column(5).to_pylist()
            vecs = b.column(3).to_pylist()
            out: list[tuple] = []
            by: dict[str, list[int]] = {}
            for i, s in enumerate(names):
                by.setdefault(s, []).append(i)
            for s, own in by.items():
                x = spaces[s]
                m = np.stack([np.frombuffer(vecs[i], np.float32) for i in own])
                h, wide = x.dim // 2, len(x.second)
                d1 = -2 * m[:, :h] @ x.first.T + (x.first * x.first).sum(1)
                d2 = -2 * m[:, h:] @ x.second.T + (x.second * x.second).sum(1)
                half = m.astype(np.float16)
                for k, i in enumerate(own):
                    v = half[k].tobytes()
                    mark = sum(ids[i].encode()) * 2654435761 & 0x7FFFFFFF
                    g = int(x.group_of[own_cell[i] // wide])
                    p = int(x.parts[g])
                    out.extend((s, g, mark % p, q, 0, ids[i], v, [own_cell[i]]) for q in range(p))
                    if asks[i]:
                        groups: dict[int, list[int]] = {}
                        for c in walk(d1[k], d2[k], lists[s], enough[s]):
                            groups.setdefault(int(x.group_of[c // wide]), []).append(c)
                        for g, cs in groups.items():
                            p = int(x.parts[g])
                            out.extend((s, g, e, mark % p, 1, ids[i], v, cs) for e in range(p))
            cols = list(zip(*out)) if out else [()] * 8
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["space", "grp", "se", "sq", "role", "id", "vec", "cells"])

    return filed.withColumn("asks", queries).mapInArrow(run, "space string, grp int, se int, sq int, role int, id string, vec binary, cells array<int>")


def _meet(spaces: dict[str, Space], k: int):
    """The reducer of a block: cosines of its queries with the entries of their cells."""

    def run(key, t):
        dim = spaces[key[0].as_py()].dim
        role = t.column("role").to_numpy()
        ids = np.array(t.column("id").to_pylist(), object)
        x = _matrix(t.column("vec"), dim)
        e, q = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        lists = t.column("cells").combine_chunks()
        starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        e_cell = flat[starts[e]]
        order = np.argsort(e_cell, kind="stable")
        e, e_cell = e[order], e_cell[order]
        lens = starts[q + 1] - starts[q]
        asked = np.concatenate([flat[starts[i] : starts[i + 1]] for i in q]) if len(q) else np.zeros(0, np.int32)
        asker = np.repeat(q, lens)
        order = np.argsort(asked, kind="stable")
        asked, asker = asked[order], asker[order]
        out_q, out_e, out_s = [], [], []
        cells, begin = np.unique(asked, return_index=True)
        ends = np.append(begin[1:], len(asked))
        lo, hi = np.searchsorted(e_cell, cells, "left"), np.searchsorted(e_cell, cells, "right")
        for b0, b1, l0, l1 in zip(begin, ends, lo, hi):
            if l0 == l1:
                continue
            entries = e[l0:l1]
            for at in range(b0, b1, 4096):
                who = asker[at : min(b1, at + 4096)]
                s = x[who] @ x[entries].T
                if s.shape[1] > k + 1:
                    j = np.argpartition(-s, k, axis=1)[:, : k + 1]
                    i, j = np.repeat(np.arange(len(who)), k + 1), j.ravel()
                else:
                    i, j = np.repeat(np.arange(len(who)), s.shape[1]), np.tile(np.arange(s.shape[1]), len(who))
                other = ids[who[i]] != ids[entries[j]]
                i, j = i[other], j[other]
                out_q.append(who[i])
                out_e.append(entries[j])
                out_s.append(s[i, j])
        if not out_q:
            return pa.table({"space": pa.array([], pa.string()), "id": pa.array([], pa.string()), "other": pa.array([], pa.string()), "cosine": pa.array([], pa.float32())})
        a, b, s = np.concatenate(out_q), np.concatenate(out_e), np.concatenate(out_s)
        order = np.lexsort((-s, a))
        a, b, s = a[order], b[order], s[order]
        first = np.concatenate([[True], a[1:] != a[:-1]])
        nth = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
        top = nth < k
        return pa.table({"space": pa.array([key[0].as_py()] * int(top.sum()), pa.string()), "id": pa.array(ids[a[top]], pa.string()), "other": pa.array(ids[b[top]], pa.string()), "cosine": pa.array(s[top], pa.float32())})

    return run


def nearest(
    vectors: DataFrame, k: int = 10, candidates: int = 600, share: float = 0.0, queries=None, block_rows: int = 20_000, per_cell: int = 16, most_cells: int = MAX_CENTROIDS**2
) -> tuple[DataFrame, DataFrame]:
    """(space, id, other, cosine, rank) of the ``k`` most similar of each query, and the filed vectors.

    ``vectors`` as of :func:`unit_vectors`; ``queries`` (a condition on id) are
    all by default. Each query looks at the nearest cells that hold at least
    ``candidates`` entries, or ``share`` of the space if that is more; a search
    of a large share wants ``most_cells`` low, since it walks that share of them.
    Cosines are of half-precision vectors (error under 0.001). Repeated ids are the same vector; a vector is never its
    own neighbour.
    """
    spaces, filed = fit(vectors, block_rows, per_cell, most_cells)
    if not spaces:
        empty = vectors.sparkSession.createDataFrame([], "space string, id string, other string, cosine float, rank int")
        return empty, filed
    enough = {s: max(candidates, int(share * x.n)) for s, x in spaces.items()}
    routed = _route(filed, spaces, enough, F.lit(True) if queries is None else queries)
    met = routed.groupBy("space", "grp", "se", "sq").applyInArrow(_meet(spaces, k), "space string, id string, other string, cosine float").distinct()
    rank = F.row_number().over(Window.partitionBy("space", "id").orderBy(F.desc("cosine"), "other"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k), filed


def exact_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs(space, id_a, id_b)`` with the cosine of the full vectors."""
    a = vectors.select("space", F.col("id").alias("id_a"), F.col("vec").alias("va"), "dim")
    b = vectors.select("space", F.col("id").alias("id_b"), F.col("vec").alias("vb"))

    def run(batches):
        for t in batches:
            s = [float(np.frombuffer(x, np.float32).astype(np.float64) @ np.frombuffer(y, np.float32).astype(np.float64)) for x, y in zip(t.column(3).to_pylist(), t.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), pa.array(s, pa.float64())], ["space", "id_a", "id_b", "cosine"])

    joined = pairs.select("space", "id_a", "id_b").join(a, ["space", "id_a"]).join(b, ["space", "id_b"]).select("space", "id_a", "id_b", "va", "vb")
    return joined.mapInArrow(run, "space string, id_a string, id_b string, cosine double")


#: Added to the greatest distance of a pair when cells are ruled out: more than float32 sums and half-precision vectors are off.
_SLACK = 0.003
#: Cosines computed at once, and pairs a batch that leaves a block.
_SCORES, _PAIRS = 8_000_000, 200_000
_PAIR = "space string, id_a string, id_b string, cosine float"


def _gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """At least the squared distance of each ``x`` to anything that is nearest to each centroid.

    What is nearest to c lies beyond the plane halfway between c and the centroid nearest to x.
    """
    d = -2 * x @ c.T + (c * c).sum(1)
    own = d.argmin(1)
    apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))[own]
    far = np.where(apart > 1e-3, (d - d[np.arange(len(x)), own][:, None]) / (2 * np.maximum(apart, 1e-3)), 0)
    return np.maximum(far, 0) ** 2


def _within(x: np.ndarray, s: Space, least: float):
    """``f(i)``: which of ``x`` can have a cosine of ``least`` with an entry under first centroid ``i``."""
    h = s.dim // 2
    reach = (np.sqrt(max(0.0, 2 - 2 * least)) + _SLACK) ** 2
    g1, g2 = _gaps(x[:, :h], s.first), _gaps(x[:, h:], s.second)

    def some(i: int) -> np.ndarray:
        filled = np.flatnonzero(s.cells[i])
        who = np.flatnonzero(g1[:, i] <= reach) if len(filled) else np.zeros(0, int)
        return who[g1[who, i] + g2[np.ix_(who, filled)].min(1) <= reach] if len(who) else who

    return some


def _route_within(filed: DataFrame, spaces: dict[str, Space], least: float, block_rows: int) -> DataFrame:
    """(space, grp, se, sq, role, id, vec, cell): entries and queries at the blocks where they meet.

    A query goes to its own group and those after it, so two groups meet once.
    """
    asking = {}  # sub-blocks of the queries of each group: all vectors of groups up to it may come
    for s, x in spaces.items():
        size = np.bincount(x.group_of, weights=x.cells.sum(1), minlength=len(x.parts))
        asking[s] = np.maximum(1, np.ceil(np.cumsum(size) / (2 * block_rows))).astype(int)

    def run(batches):
        for b in batches:
            names, ids = np.array(b.column(0).to_pylist()), b.column(1).to_pylist()
            own_cell = b.column(4).to_numpy()
            out: list[tuple] = []
            for s in np.unique(names):
                x = spaces[s]
                own = np.flatnonzero(names == s)
                m = _matrix(b.column(3).take(pa.array(own)), x.dim)
                group = x.group_of[own_cell[own] // len(x.second)]
                goes = np.zeros((len(own), len(x.parts)), bool)
                some = _within(m, x, least)
                for i in range(len(x.first)):
                    goes[some(i), x.group_of[i]] = True
                half = m.astype(np.float16)
                for k, i in enumerate(own.tolist()):
                    v, c = half[k].tobytes(), int(own_cell[i])
                    mark = sum(ids[i].encode()) * 2654435761 & 0x7FFFFFFF
                    g = int(group[k])
                    out.extend((s, g, mark % int(x.parts[g]), q, 0, ids[i], v, c) for q in range(asking[s][g]))
                    for g in (np.flatnonzero(goes[k, g:]) + g).tolist():
                        out.extend((s, g, e, mark % int(asking[s][g]), 1, ids[i], v, c) for e in range(x.parts[g]))
            cols = list(zip(*out)) if out else [()] * 8
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["space", "grp", "se", "sq", "role", "id", "vec", "cell"])

    return filed.mapInArrow(run, "space string, grp int, se int, sq int, role int, id string, vec binary, cell int")


def _meet_within(spaces: dict[str, Space], least: float):
    """The reducer of a block: its pairs of cosine ``least`` or more, in batches of bounded size."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, here = spaces[key[0].as_py()], key[1].as_py()
        t = pa.Table.from_batches(list(batches))
        role, cell = t.column("role").to_numpy(), t.column("cell").to_numpy()
        ids = np.array(t.column("id").to_pylist(), object)
        x = _matrix(t.column("vec"), s.dim)
        first = cell // len(s.second)
        e, q = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        e = e[np.argsort(first[e], kind="stable")]
        at_home = s.group_of[first] == here

        def batch(a, b, cosine):
            # within a group each pair is seen from both sides
            once = np.where(at_home[a], ids[a] < ids[b], ids[a] != ids[b]).astype(bool)
            a, b, cosine = ids[a[once]], ids[b[once]], cosine[once]
            less = (a < b).astype(bool)
            columns = [pa.array([key[0].as_py()] * len(a), pa.string()), pa.array(np.where(less, a, b), pa.string()), pa.array(np.where(less, b, a), pa.string()), pa.array(cosine, pa.float32())]
            return pa.RecordBatch.from_arrays(columns, ["space", "id_a", "id_b", "cosine"])

        if not len(e) or not len(q):
            return
        some = _within(x[q], s, least)
        for i in np.unique(first[e]):
            entries, who = e[first[e] == i], q[some(i)]
            y = x[entries].T
            step = max(1, _SCORES // len(entries))
            for at in range(0, len(who), step):
                part = who[at : at + step]
                cosine = (x[part] @ y).ravel()
                hit = np.flatnonzero(cosine >= least)
                for h in range(0, len(hit), _PAIRS):
                    n = hit[h : h + _PAIRS]
                    yield batch(part[n // len(entries)], entries[n % len(entries)], cosine[n])

    return run


def similar_pairs(
    vectors: DataFrame, least: float = 0.9, k: int | None = None, doubt: float = 0.002, candidates: int = 0, block_rows: int = 20_000, per_cell: int = 16, most_cells: int = MAX_CENTROIDS**2
) -> DataFrame:
    """(space, id_a, id_b) with id_a < id_b: all pairs of cosine ``least`` or more.

    ``k`` keeps only those where one is among the other's ``k`` nearest. The
    search ends by distance, so ``candidates`` has no effect here; where the
    vectors have little structure, it compares nearly all of a space. Pairs
    within ``doubt`` of the limit are decided on the full vectors.
    """
    spaces, filed = fit(vectors, block_rows, per_cell, most_cells)
    if not spaces:
        return vectors.sparkSession.createDataFrame([], "space string, id_a string, id_b string")
    routed = _route_within(filed, spaces, least - doubt, block_rows)
    pairs = routed.groupBy("space", "grp", "se", "sq").applyInArrow(_meet_within(spaces, least - doubt), _PAIR)
    pairs = stage(pairs.groupBy("space", "id_a", "id_b").agg(F.max("cosine").alias("cosine")), "pairs")
    if k is not None:
        both = pairs.withColumn("id", F.explode(F.array("id_a", "id_b"))).withColumn("other", F.when(F.col("id") == F.col("id_a"), F.col("id_b")).otherwise(F.col("id_a")))
        rank = F.row_number().over(Window.partitionBy("space", "id").orderBy(F.desc("cosine"), "other"))
        pairs = stage(both.withColumn("rank", rank).where(F.col("rank") <= k).select("space", "id_a", "id_b", "cosine").distinct(), "nearest")
    sure = pairs.where(F.col("cosine") >= least + doubt).select("space", "id_a", "id_b")
    unsure = pairs.where(F.col("cosine") < least + doubt)
    if unsure.isEmpty():
        return sure
    return sure.unionByName(exact_cosines(unsure, filed).where(F.col("cosine") >= least).select("space", "id_a", "id_b").distinct())


def embedding_rows(chunks: DataFrame, nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """(space, id, embedding) of the three tables; a space is a table, for chunks also a model."""
    c = chunks.select(F.concat(F.lit("chunk_embeddings|"), F.coalesce("model", F.lit(""))).alias("space"), F.col("vec_id").alias("id"), "embedding")
    n = nodes.select(F.lit("graph_nodes").alias("space"), "id", "embedding")
    m = communities.select(F.lit("communities").alias("space"), F.col("id").cast("string").alias("id"), "embedding")
    return c.unionByName(n).unionByName(m)
