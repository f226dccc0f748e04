"""Problem 9: items of varying length in containers of fixed capacity.

Items are spread over shards of bounded size. A shard places its items by
descending size, each where it leaves the least space, and then improves the
underfull containers by local search: an item moves to a fuller container, or is
exchanged with a larger one or with two that together are larger, whenever that
raises the sum of squared fills, so full containers get fuller and the emptiest
dissolve. What is still underfull is pooled over all shards and packed again in
fewer of them, until one shard is left.
"""

from __future__ import annotations

from collections import Counter
from heapq import heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.tokens import VOCABULARY, transducer
from docmill.scratch import stage

CAPACITY = 2048
#: Items per shard; bounds the memory of a task.
SHARD_ITEMS = 40_000
#: A container at least this full isn't packed again.
FULL_SHARE = 0.98


def token_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, size): tokens of each text, 0 for null and empty ones."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        t = transducer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode(x)) if x else 0 for x in b.column(1).to_pylist()], pa.int64())], ["id", "size"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, size long")


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container of each item, by descending size into the least space that suffices."""
    out = [0] * len(sizes)
    spaces: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = n = 0  # bit s is set where a container has s left
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fit = some >> size
        if fit:
            left = size + (fit & -fit).bit_length() - 1
            c = spaces[left].pop()
            if not spaces[left]:
                some ^= 1 << left
        else:
            left, c, n = capacity, n, n + 1
        out[i] = c
        left -= size
        spaces[left].append(c)
        some |= 1 << left
    return out


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search over underfull containers until no step is left; every step raises the sum of squared fills.

    Containers take in turn, the fullest first, from all that come after them.
    What these hold, single items and pairs of one container, is offered by size,
    and under each size by the fill of its container, the emptiest first: if that
    one can't give it with a gain, none of the others can, so every partner counts.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    issue = [0] * len(bins)  # offers of an earlier one are void
    changed = True
    while changed:
        changed = False
        ones: list[list[tuple]] = [[] for _ in range(capacity + 1)]
        twos: list[list[tuple]] = [[] for _ in range(capacity + 1)]
        some = {1: 0, 2: 0}  # bit s is set where something of size s is offered

        def offer(b):
            issue[b] += 1
            own = Counter(sizes[i] for i in bins[b])
            pairs = {x + y for x, y in combinations(own, 2)} | {2 * x for x, n in own.items() if n > 1}
            for n, heaps, offered in ((1, ones, own), (2, twos, pairs)):
                for size in offered:
                    if size <= capacity:
                        heappush(heaps[size], (fill[b], b, issue[b]))
                        some[n] |= 1 << size

        def largest(n, heaps, least, most, have, a):
            """Largest size above ``least``, up to ``most``, that raises the sum of squares in exchange for ``have``, and who gives it."""
            while (size := (some[n] & ((2 << most) - 1)).bit_length() - 1) > least:
                heap = heaps[size]
                while heap and issue[heap[0][1]] != heap[0][2]:
                    heappop(heap)
                if not heap:
                    some[n] ^= 1 << size
                elif fill[a] + size - have > heap[0][0]:
                    return size, heap[0][1]
                else:
                    most = size - 1
            return None

        order = sorted((b for b in range(len(bins)) if bins[b]), key=lambda b: (-fill[b], b))
        for b in order:
            offer(b)
        for a in order:
            issue[a] += 1  # gives to none after it
            while bins[a] and (room := capacity - fill[a]) > 0:
                gain, step = 0, None
                own = sorted({sizes[i] for i in bins[a]})
                # a move, or an exchange of one for one, then of two for one: gain is what the fuller container grows by
                for n, heaps, given in ((1, ones, [0, *own]), (2, twos, own)):
                    for have in given:
                        if gain < room and (found := largest(n, heaps, have + gain, min(capacity, have + room), have, a)):
                            gain, step = found[0] - have, (n, have, *found)
                if step is None:
                    break
                n, have, size, b = step
                held = {}
                for i in bins[b]:
                    held.setdefault(sizes[i], []).append(i)
                if n == 1:
                    ys = held[size][:1]
                else:
                    x = next(x for x in sorted(held) if size - x in held and (size != 2 * x or len(held[x]) > 1))
                    ys = held[x][:2] if size == 2 * x else [held[x][0], held[size - x][0]]
                for y in ys:
                    bins[b].remove(y)
                    bins[a].append(y)
                if have:
                    x = next(i for i in bins[a] if sizes[i] == have and i not in ys)
                    bins[a].remove(x)
                    bins[b].append(x)
                fill[a] += gain
                fill[b] -= gain
                offer(b)
                changed = True
    return [b for b in bins if b]


def pack_shard(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item of a shard; items of size 0 lie in the first."""
    solid = [i for i, s in enumerate(sizes) if s > 0]
    placed = best_fit([sizes[i] for i in solid], capacity)
    bins: list[list[int]] = [[] for _ in range(max(placed, default=-1) + 1)]
    for i, c in zip(solid, placed):
        bins[c].append(i)
    full = [b for b in bins if sum(sizes[i] for i in b) >= FULL_SHARE * capacity]
    under = improve([b for b in bins if sum(sizes[i] for i in b) < FULL_SHARE * capacity], sizes, capacity)
    out = [0] * len(sizes)
    for n, b in enumerate(full + under):
        for i in b:
            out[i] = n
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container_id, id, piece, start, size): where each of ``items(id, size)`` lies.

    An item above the capacity is cut into pieces of full capacity, each alone in
    its container, and a rest; no other item is split. Items of size 0 (also null
    or negative sizes) take no space and lie beside others. Repeated rows are
    items of their own. An empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    kind = items.schema["id"].dataType.simpleString()
    size = F.greatest(F.lit(0), F.coalesce(F.col("size"), F.lit(0))).cast("long")
    marked = items.select("id", size.alias("all")).withColumn("row", F.monotonically_increasing_id())
    marked = stage(marked, "items")
    n_full = F.floor((F.col("all") - 1) / capacity)  # the rest of an exact multiple is a full piece as well
    pieces = marked.select("id", "row", "all", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), n_full))).alias("piece"))
    pieces = pieces.select("id", "row", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("all") - F.col("piece") * capacity).alias("size"))
    whole = pieces.where(F.col("size") == capacity).select(F.concat_ws(".", F.lit("f"), "row", "piece").alias("container_id"), "id", "piece", "start", "size")
    pool = pieces.where(F.col("size") < capacity)
    shape = f"id {kind}, row long, piece long, start long, size long, shard long, bin long"

    def run(key, t):
        t = t.sort_by([("row", "ascending"), ("piece", "ascending")])
        bins = pack_shard(t.column("size").to_pylist(), capacity)
        return t.append_column("bin", pa.array(bins, pa.int64()))

    done, n_round, before = [whole], 0, None
    while True:
        pool = stage(pool, f"pool{n_round}") if before is None else pool
        n = pool.count()
        shards = max(1, -(-n // shard_items))
        spread = pool.withColumn("shard", F.pmod(F.xxhash64("row", "piece", F.lit(n_round)), F.lit(shards)))
        packed = stage(spread.groupBy("shard").applyInArrow(run, shape), f"packed{n_round}")
        named = packed.select(F.concat_ws(".", F.lit(f"r{n_round}"), "shard", "bin").alias("container_id"), "id", "row", "piece", "start", "size")
        if shards == 1:
            done.append(named.drop("row"))
            break
        fill = named.groupBy("container_id").agg(F.sum("size").alias("fill"))
        loose = fill.where(F.col("fill") < FULL_SHARE * capacity).select("container_id")
        rest = stage(named.join(loose, "container_id", "left_semi").drop("container_id"), f"pool{n_round + 1}")
        left = rest.count()
        if left > 0.9 * n or left == 0:  # nothing to gain by pooling again
            done.append(named.drop("row"))
            break
        done.append(named.join(loose, "container_id", "left_anti").drop("row"))
        pool, before, n_round = rest, n, n_round + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could hold them, and the share of unused space."""
    bins = packed.groupBy("container_id").agg(F.sum("size").alias("fill"))
    return bins.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"),
        F.ceil(F.coalesce(F.sum("fill"), F.lit(0)) / capacity).alias("least_containers"),
        F.coalesce(F.max("fill"), F.lit(0)).alias("fullest"),
        (1 - F.coalesce(F.sum("fill"), F.lit(0)) / F.greatest(F.lit(1), F.count("*") * capacity)).alias("unused_share"),
    )
