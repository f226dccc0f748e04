"""Entity resolution: candidate pairs, verdicts, clusters, merged entities and redirected edges."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import strip
from docmill.operators.components import connected_components
from docmill.scratch import stage

BLOCK_ROWS = 4_000


def candidate_pairs(vectors: DataFrame, least: float = 0.75, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id_a, id_b, similarity) with id_a < id_b of all pairs of ``vectors(id, vec)`` with that cosine, exactly.

    Rows are dealt to blocks of bounded size; each pair of blocks is one matrix
    product in a task of its own. Null vectors and those without length are left
    out; vectors of other sizes are never alike. For sets that are too large to
    compare in full, an index over the vectors has to choose the pairs.
    """
    v = vectors.where("vec is not null and size(vec) > 0").select(F.col("id").cast("string").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    v = stage(v, "vectors")
    blocks = max(1, -(-v.count() // block_rows))
    own = v.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    first = own.select("id", "vec", F.lit(0).alias("side"), F.explode(F.sequence("b", F.lit(blocks - 1))).alias("cb"), F.col("b").alias("ra"))
    second = own.select("id", "vec", F.lit(1).alias("side"), F.col("b").alias("cb"), F.explode(F.sequence(F.lit(0), "b")).alias("ra"))

    def run(key, t):
        side = np.array(t.column("side").to_pylist())
        ids = np.array(t.column("id").to_pylist(), object)
        vecs = t.column("vec").to_pylist()
        size = np.array([len(x) for x in vecs])
        out_a, out_b, out_s = [], [], []
        for d in np.unique(size):
            a, b = np.flatnonzero((side == 0) & (size == d)), np.flatnonzero((side == 1) & (size == d))
            if not len(a) or not len(b):
                continue
            x, y = np.array([vecs[i] for i in a], float), np.array([vecs[i] for i in b], float)
            nx, ny = np.linalg.norm(x, axis=1, keepdims=True), np.linalg.norm(y, axis=1, keepdims=True)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = (x / nx) @ (y / ny).T
            i, j = np.nonzero(s >= least)
            for p, q in zip(i, j):
                u, w = ids[a[p]], ids[b[q]]
                if u != w and (key[0].as_py() != key[1].as_py() or u < w):
                    out_a.append(min(u, w))
                    out_b.append(max(u, w))
                    out_s.append(float(s[p, q]))
        return pa.table({"id_a": pa.array(out_a, pa.string()), "id_b": pa.array(out_b, pa.string()), "similarity": pa.array(out_s, pa.float64())})

    return first.unionByName(second).groupBy("ra", "cb").applyInArrow(run, "id_a string, id_b string, similarity double")


def same_by_rule(name_a: Column, aliases_a: Column, name_b: Column, aliases_b: Column) -> Column:
    """The default verdict: equal names, a name among the other's aliases, or one the initials of the other."""
    low = lambda c: F.lower(strip(c))
    initials = lambda c: F.array_join(F.transform(F.filter(F.split(low(c), r"\s+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")
    a, b = low(name_a), low(name_b)
    among = lambda xs, n: F.coalesce(F.exists(xs, lambda x: low(x) == n), F.lit(False))
    short = ((F.length(a) >= 2) & (a == initials(name_b)) & (F.size(F.split(b, r"\s+")) > 1)) | ((F.length(b) >= 2) & (b == initials(name_a)) & (F.size(F.split(a, r"\s+")) > 1))
    return (a != "") & (b != "") & ((a == b) | among(aliases_a, b) | among(aliases_b, a) | short)


def clusters(pairs: DataFrame, cell_edges: int = 50_000) -> DataFrame:
    """(id, root): records linked by ``pairs(a, b)``, directly or through others, with the smallest id of each cluster."""
    cc = stage(connected_components(pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")), cell_edges), "components")
    least = cc.groupBy("component").agg(F.min("v").alias("root"))
    return cc.join(least, "component").select(F.col("v").alias("id"), "root")


def majority_type(members: DataFrame) -> DataFrame:
    """(root, type) of ``members(root, type, ord)``: the most frequent type, of equally frequent ones the first seen."""
    per = members.groupBy("root", "type").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return per.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "type")).alias("k")).select("root", "k.type")


def canonical_name(members: DataFrame) -> DataFrame:
    """(root, name): the most frequent name, of equally frequent ones the longest, then the first in order."""
    per = members.where("name is not null").groupBy("root", "name").agg(F.count("*").alias("n"))
    return per.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.length("name")).alias("l"), "name")).alias("k")).select("root", F.col("k.name").alias("name"))


def merge_attributes(members: DataFrame) -> DataFrame:
    """(root, key, value) of ``members(root, attributes)``: equal values once, numbers their largest, texts the longest."""
    kv = members.select("root", F.explode("attributes").alias("key", "value")).where("value is not null")
    x = F.col("value").try_cast("double")
    g = kv.groupBy("root", "key").agg(
        F.count_distinct("value").alias("n"),
        F.min("value").alias("only"),
        F.count_if(x.isNull()).alias("texts"),
        F.max(F.struct(x.alias("x"), "value")).alias("top"),
        F.min(F.struct((-F.length("value")).alias("l"), "value")).alias("longest"),
    )
    return g.select("root", "key", F.when(F.col("n") == 1, F.col("only")).when(F.col("texts") == 0, F.col("top.value")).otherwise(F.col("longest.value")).alias("value"))


def join_sentences(texts: Column, limit: float = 0.8) -> Column:
    """Sentences of several texts, in order, without those that share more than ``limit`` of their words with one before."""
    parts = F.filter(F.flatten(F.transform(texts, lambda t: F.split(t, r"(?<=[.!?])\s+"))), lambda s: F.trim(s) != "")
    bag = lambda s: F.array_distinct(F.filter(F.split(F.lower(s), r"\s+"), lambda w: w != ""))

    def alike(a, b):
        x, y = bag(a), bag(b)
        least = F.least(F.size(x), F.size(y))
        return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0) > limit

    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(F.exists(acc, lambda k: alike(k, s)), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(kept, " ")


def merge_descriptions(members: DataFrame) -> DataFrame:
    """(root, description) of ``members(root, ord, description)``: their sentences in order, without what was said before.

    Equal sentences, case apart, are reduced to the first before a cluster is
    gathered. A sentence meets those kept before through the words that they
    share (as in :func:`join_sentences`, which compares all of them).
    """
    s = members.select("root", "ord", F.posexplode(F.split("description", r"(?<=[.!?])\s+")).alias("pos", "s")).where(F.trim("s") != "")
    once = s.groupBy("root", F.lower(F.trim("s")).alias("k")).agg(F.min(F.struct("ord", "pos", "s")).alias("f"))
    bag = F.array_distinct(F.filter(F.split(F.lower("f.s"), r"\s+"), lambda w: w != ""))
    listed = once.select("root", F.col("f").alias("f"), bag.alias("bag")).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("f", "bag"))).alias("l"))
    listed = listed.select("root", F.transform("l", lambda x: x["f"]["s"]).alias("t"), F.transform("l", lambda x: x["bag"]).alias("bags"))
    kind = members.schema["root"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts, bags = b.column(1).to_pylist(), b.column(2).to_pylist()
            out = [" ".join(t[i] for i in unsaid(g)) for t, g in zip(texts, bags)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["root", "description"])

    return listed.mapInArrow(run, f"root {kind}, description string")


def unsaid(bags: list[list[str]], limit: float = 0.8) -> list[int]:
    """Places of the sentences, as their different words, that share at most ``limit`` of the words of the shorter with each one kept before."""
    holds: dict[str, list[int]] = {}
    sizes: list[int] = []
    kept = []
    for i, words in enumerate(bags):
        shared: Counter = Counter()
        for w in words:
            shared.update(holds.get(w, ()))
        if any(n / min(len(words), sizes[j]) > limit for j, n in shared.items()):
            continue
        for w in words:
            holds.setdefault(w, []).append(len(sizes))
        sizes.append(len(words))
        kept.append(i)
    return kept


def redirect_edges(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(src, dst, rel_type, weight): both ends moved to their root; loops that arise are dropped, parallel edges added up."""
    e = edges
    for side in ("src", "dst"):
        e = e.join(roots.select(F.col("id").alias(side), F.col("root").alias("_r")), side, "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
    moved = e.join(edges.where("src = dst").select(F.col("src").alias("_loop")).distinct(), (F.col("src") == F.col("_loop")) & (F.col("src") == F.col("dst")), "left")
    kept = moved.where("src <> dst or _loop is not null").drop("_loop")
    return kept.groupBy("src", "dst").agg(F.min_by("rel_type", F.struct((-F.col("weight")).alias("w"), "rel_type")).alias("rel_type"), F.sum("weight").alias("weight"))


def redirect_support(edge_chunks: DataFrame, roots: DataFrame) -> DataFrame:
    """(src, dst, chunk_id): the chunks of edges whose ends were moved to their root, each once; loops lose theirs."""
    e = edge_chunks
    for side in ("src", "dst"):
        e = e.join(roots.select(F.col("id").alias(side), F.col("root").alias("_r")), side, "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
    return e.where("src <> dst").select("src", "dst", "chunk_id").distinct()


def merged_edge_descriptions(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(src, dst, description) of ``edges(src, dst, description)`` moved to their roots: sentences of all, without repeats."""
    e = edges.where("description is not null").select("src", "dst", "description", F.concat_ws("\x00", "src", "dst").alias("ord"))
    for side in ("src", "dst"):
        e = e.join(roots.select(F.col("id").alias(side), F.col("root").alias("_r")), side, "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
    e = e.where("src <> dst").withColumn("root", F.struct("src", "dst"))
    return merge_descriptions(e.select("root", "ord", "description")).select("root.src", "root.dst", "description")


def merged_nodes(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, name, type, n_members): one row per cluster; the type is the root's own."""
    m = nodes.join(roots.select(F.col("id"), "root"), "id").select("root", "id", "name", "type")
    names = canonical_name(m)
    own = m.where("id = root").select("root", "type")
    size = m.groupBy("root").agg(F.count("*").alias("n_members"))
    return size.join(names, "root", "left").join(own, "root", "left").select("root", "name", "type", "n_members")


def apply_merges(nodes: DataFrame, roots: DataFrame) -> dict[str, DataFrame]:
    """The nodes after merging, and what an entity was merged from, as tables of one row each.

    nodes(id, name, type, description, attributes): each root with the name that
    most members have, its own type, the sentences of all descriptions and the
    merged attributes; nodes outside clusters as they are; other members are gone.
    aliases(id, alias): names of members other than the chosen one, beside the
    aliases that nodes outside clusters have. members(id, member). node_chunks(id,
    chunk_id): every source chunk of every member once. Roots without a row in
    ``nodes`` are taken over by nobody: their members stay in the cluster under it.
    """
    m = stage(nodes.join(roots.select("id", "root"), "id"), "members")
    lone = nodes.join(roots.select("id"), "id", "left_anti")
    kv = merge_attributes(m.select("root", "attributes"))
    attributes = kv.groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes"))
    described = merge_descriptions(m.where("description is not null").select("root", F.col("id").alias("ord"), "description"))
    base = merged_nodes(nodes, roots)
    merged = base.join(described, "root", "left").join(attributes, "root", "left").select(F.col("root").alias("id"), "name", "type", "description", "attributes")
    names = m.select(F.col("root").alias("id"), F.col("name").alias("alias")).join(base.select(F.col("root").alias("id"), F.col("name").alias("_name")), "id")
    aliases = names.where("alias is not null and alias <> _name").select("id", "alias").unionByName(lone.select("id", F.explode("aliases").alias("alias")).where("alias is not null")).distinct()
    own = lambda d, key: d.select(F.col(key).alias("id"), F.explode("source_chunks").alias("chunk_id"))
    chunks = own(m, "root").unionByName(own(lone, "id")).where("chunk_id is not null").distinct()
    return {
        "nodes": merged.unionByName(lone.select("id", "name", "type", "description", "attributes")),
        "aliases": aliases,
        "members": m.select(F.col("root").alias("id"), F.col("id").alias("member")),
        "node_chunks": chunks,
    }


def resolve(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, least: float = 0.75, verdict=same_by_rule, decided: DataFrame | None = None, confidence: float = 0.7) -> dict[str, DataFrame]:
    """One pass over a graph: pairs, verdicts, clusters, merged entities, redirected edges and counts.

    ``verdict`` may be any column function of names and aliases. Pairs in
    ``decided(id_a, id_b, same_entity, confidence)`` keep that decision, if it is
    of at least ``confidence``, and aren't asked again.
    """
    pairs = stage(candidate_pairs(vectors, least), "pairs")
    side = lambda s: nodes.select(F.col("id").alias(f"id_{s}"), F.col("name").alias(f"name_{s}"), F.col("aliases").alias(f"al_{s}"))
    open_, known = pairs, None
    if decided is not None:
        cached = decided.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "same_entity", "confidence").groupBy("id_a", "id_b").agg(F.max(F.struct("confidence", "same_entity")).alias("d"))
        known = pairs.join(cached, ["id_a", "id_b"]).where(F.col("d.same_entity") & (F.col("d.confidence") >= confidence)).select("id_a", "id_b")
        open_ = pairs.join(cached, ["id_a", "id_b"], "left_anti")
    same = open_.join(side("a"), "id_a").join(side("b"), "id_b").where(verdict(F.col("name_a"), F.col("al_a"), F.col("name_b"), F.col("al_b"))).select("id_a", "id_b")
    same = stage(same if known is None else same.unionByName(known), "verified")
    roots = stage(clusters(same.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))), "roots")
    ids = roots.select("id")
    touched = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns))
    count = lambda d, name: d.agg(F.count("*").alias("value")).select(F.lit(name).alias("counter"), "value")
    counts = [count(pairs, "candidate_pairs"), count(same, "verified_pairs"), count(roots.select("root").distinct(), "clusters"), count(roots.where("id <> root"), "entities_merged"), count(touched, "relationships_updated")]
    return {"pairs": pairs, "verified": same, "roots": roots, "merged": merged_nodes(nodes, roots), **apply_merges(nodes, roots), "edges": redirect_edges(edges, roots), "counts": reduce(DataFrame.unionByName, counts)}
