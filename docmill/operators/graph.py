"""Property graph as tables: building, statistics, walks, communities, pruning and retrieval.

nodes(node_id, name, name_norm, type, description, attributes), one row an entity;
node_chunks(node_id, chunk_id) and edge_chunks(src, dst, chunk_id) hold the
support, so an entity of very many chunks is many rows and not one large row;
edges(src, dst, rel_type, weight) are directed and simple.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.similarity import cosine
from docmill.functions.text import normalize_name, tokens
from docmill.scratch import stage

MIN_CONFIDENCE, MAX_ENTITIES, MAX_RELATIONS = 0.7, 15, 20


def chunks_once(extraction: DataFrame) -> DataFrame:
    """Each chunk once, of repeated rows the first extracted."""
    order = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.col("extracted_at").asc_nulls_last(), "chunk_text"))
    return extraction.where("chunk_id is not null").withColumn("_n", order).where("_n = 1").drop("_n")


def entity_mentions(chunks: DataFrame, min_confidence: float = MIN_CONFIDENCE, most: int = MAX_ENTITIES) -> DataFrame:
    """(chunk_id, pos, name, type, confidence): sure mentions with a name and a type, the first ``most`` of a chunk."""
    m = chunks.select("chunk_id", F.posexplode("entities").alias("pos", "e")).select("chunk_id", "pos", "e.name", "e.type", "e.confidence")
    m = m.where((F.col("confidence") >= min_confidence) & (F.trim("name") != "") & (F.trim("type") != ""))
    nth = F.row_number().over(Window.partitionBy("chunk_id").orderBy("pos"))
    return m.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def relation_mentions(chunks: DataFrame, entities: DataFrame, most: int = MAX_RELATIONS) -> DataFrame:
    """(chunk_id, pos, source_entity, target_entity, rel_type) between entities of the same chunk, the first ``most`` of a chunk."""
    r = chunks.select("chunk_id", F.posexplode("relationships").alias("pos", "r")).select(
        "chunk_id", "pos", "r.source_entity", "r.target_entity", F.coalesce(F.nullif(F.trim("r.relationship_type"), F.lit("")), F.lit("RELATED_TO")).alias("rel_type")
    )
    known = entities.select("chunk_id", normalize_name(F.col("name")).alias("n")).distinct()
    for side in ("source_entity", "target_entity"):
        r = r.withColumn("n", normalize_name(F.col(side))).join(known, ["chunk_id", "n"], "left_semi").drop("n")
    nth = F.row_number().over(Window.partitionBy("chunk_id").orderBy("pos"))
    return r.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def node_key(name: Column) -> Column:
    return F.substring(F.md5(normalize_name(name)), 1, 16)


def build_nodes(mentions: DataFrame) -> DataFrame:
    """(node_id, name_norm, name, type, n_mentions): one row per name, case apart; name and type of the first mention."""
    key = normalize_name(F.col("name"))
    first = F.min(F.struct("chunk_id", "pos", "name", "type"))
    g = mentions.withColumn("name_norm", key).groupBy("name_norm").agg(first.alias("f"), F.count("*").alias("n_mentions"))
    return g.select(F.substring(F.md5("name_norm"), 1, 16).alias("node_id"), "name_norm", F.col("f.name").alias("name"), F.col("f.type").alias("type"), "n_mentions")


def merge_descriptions_by_length(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The longest description of each key, of equally long ones the first."""
    longest = F.max_by("description", F.struct(F.length("description"), *[(-F.col(o)) for o in order]))
    return rows.where("description is not null").groupBy(key).agg(longest.alias("description"))


def node_chunks(mentions: DataFrame) -> DataFrame:
    return mentions.select(node_key(F.col("name")).alias("node_id"), "chunk_id").distinct()


def build_edges(relations: DataFrame) -> DataFrame:
    """(src, dst, rel_type, weight): one row per ordered pair; the first relation gives the type, each mention adds 1."""
    first = F.min(F.struct("chunk_id", "pos", "rel_type"))
    r = relations.select(node_key(F.col("source_entity")).alias("src"), node_key(F.col("target_entity")).alias("dst"), "chunk_id", "pos", "rel_type")
    return r.groupBy("src", "dst").agg(first.alias("f"), F.count("*").alias("weight")).select("src", "dst", F.col("f.rel_type").alias("rel_type"), F.col("weight").cast("double"))


def edge_chunks(relations: DataFrame) -> DataFrame:
    return relations.select(node_key(F.col("source_entity")).alias("src"), node_key(F.col("target_entity")).alias("dst"), "chunk_id").distinct()


def resolve_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts of relations whose ends both have a node, and of the others."""
    ids = nodes.select("name_norm", F.lit(True).alias("known"))
    s = relations.select(normalize_name(F.col("source_entity")).alias("s"), normalize_name(F.col("target_entity")).alias("t"))
    a = s.join(ids.withColumnsRenamed({"name_norm": "s", "known": "ks"}), "s", "left").join(ids.withColumnsRenamed({"name_norm": "t", "known": "kt"}), "t", "left")
    ok = F.col("ks").isNotNull() & F.col("kt").isNotNull()
    return a.agg(F.count_if(ok).alias("resolved"), F.count_if(~ok).alias("failed"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight): both directions of a pair as one edge."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree): edges in and out; a loop counts twice, a node without edges 0."""
    ends = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(ends, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(stat, key, value): totals, nodes by type, edges by relation, mean degree."""
    n, e = nodes.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("e"))
    row = lambda d, stat, key, value: d.select(F.lit(stat).alias("stat"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    nothing = F.lit(None)
    both = n.withColumn("e", e.scalar())
    parts = [
        row(n, "total_nodes", nothing, F.col("n")),
        row(e, "total_edges", nothing, F.col("e")),
        row(both, "average_degree", nothing, F.when(F.col("n") > 0, 2 * F.col("e") / F.col("n")).otherwise(0.0)),
        row(nodes.groupBy("type").count(), "nodes_by_type", F.col("type"), F.col("count")),
        row(edges.groupBy("rel_type").count(), "edges_by_relation", F.col("rel_type"), F.col("count")),
    ]
    return reduce(DataFrame.unionByName, parts)


def successors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("node_id").alias("src")), "src", "left_semi")


def predecessors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("node_id").alias("dst")), "dst", "left_semi")


def neighbours(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """(start, node_id, distance): nodes within ``depth`` steps of each of ``starts(start)``, at their least distance.

    Each step joins the frontier with the edges; what was reached before is left out.
    """
    one = edges.select(F.col("src").alias("from"), F.col("dst").alias("node_id"))
    back = edges.select(F.col("dst").alias("from"), F.col("src").alias("node_id"))
    steps = {"out": one, "in": back, "both": one.unionByName(back)}[direction].distinct()
    seen = starts.select("start", F.col("start").alias("node_id"), F.lit(0).alias("distance")).distinct()
    frontier = seen
    for d in range(1, depth + 1):
        grown = frontier.select("start", F.col("node_id").alias("from")).join(steps, "from").select("start", "node_id").distinct()
        frontier = grown.join(seen, ["start", "node_id"], "left_anti").withColumn("distance", F.lit(d))
        if d < depth:
            frontier = stage(frontier, f"frontier{d}")
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0")


def simple_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 3, most: int = 10) -> DataFrame:
    """(src, dst, length, path): directed paths without a repeated node, the first ``most`` of each pair by (length, path).

    A walk goes on only from nodes that can still reach the target in the steps left.
    """
    e = edges.select(F.col("src").alias("from"), F.col("dst").alias("to")).where("from <> to").distinct()
    reach = pairs.select("dst", F.col("dst").alias("from"), F.lit(0).alias("left")).distinct()
    layers = [reach]
    for d in range(1, max_depth):
        nxt = layers[-1].select("dst", F.col("from").alias("to")).join(e, "to").select("dst", "from").distinct().withColumn("left", F.lit(d))
        layers.append(nxt)
    can = reduce(DataFrame.unionByName, layers).groupBy("dst", "from").agg(F.min("left").alias("left"))
    can = stage(can, "reach")
    walk = pairs.where("src <> dst").select("src", "dst", F.col("src").alias("at"), F.array("src").alias("path"))
    found = []
    for d in range(1, max_depth + 1):
        grown = walk.join(e.withColumnRenamed("from", "at"), "at").where(~F.array_contains("path", F.col("to")))
        grown = grown.select("src", "dst", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
        found.append(grown.where("at = dst").select("src", "dst", F.lit(d).alias("length"), "path"))
        if d < max_depth:
            open_ = can.where(F.col("left") <= max_depth - d).select("dst", F.col("from").alias("at"))
            walk = grown.where("at <> dst").join(open_, ["dst", "at"], "left_semi").select("src", "dst", "at", "path")
    all_ = reduce(DataFrame.unionByName, found)
    nth = F.row_number().over(Window.partitionBy("src", "dst").orderBy("length", "path"))
    return all_.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def prune(node_support: DataFrame, edge_support: DataFrame, nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """The graph without the chunks of ``gone(chunk_id)``.

    What loses all its chunks is removed, with a node its edges; what never had
    one stays. Returns nodes, edges, node_chunks, edge_chunks and counts.
    """
    kept_nc = node_support.join(gone, "chunk_id", "left_anti")
    kept_ec = edge_support.join(gone, "chunk_id", "left_anti")
    lost = node_support.select("node_id").distinct().join(kept_nc, "node_id", "left_anti")
    lost_e = edge_support.select("src", "dst").distinct().join(kept_ec, ["src", "dst"], "left_anti")
    n = nodes.join(lost, "node_id", "left_anti")
    e = edges.join(lost_e, ["src", "dst"], "left_anti")
    e = e.join(lost.withColumnRenamed("node_id", "src"), "src", "left_anti").join(lost.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    touched_n = node_support.join(gone, "chunk_id", "left_semi").select("node_id").distinct().join(lost, "node_id", "left_anti")
    touched_e = edge_support.join(gone, "chunk_id", "left_semi").select("src", "dst").distinct().join(e.select("src", "dst"), ["src", "dst"], "left_semi")
    count = lambda d, name: d.agg(F.count("*").alias("value")).select(F.lit(name).alias("counter"), "value")
    removed_e = edges.select("src", "dst").join(e, ["src", "dst"], "left_anti")
    counts = reduce(DataFrame.unionByName, [count(lost.join(nodes, "node_id", "left_semi"), "nodes_removed"), count(touched_n, "nodes_updated"), count(removed_e, "edges_removed"), count(touched_e, "edges_updated")])
    return {"nodes": n, "edges": e, "node_chunks": kept_nc.join(lost, "node_id", "left_anti"), "edge_chunks": kept_ec.join(e.select("src", "dst"), ["src", "dst"], "left_semi"), "counts": counts}


def louvain(edges: DataFrame, resolution: float = 1.0, rounds: int = 80, levels: int = 20) -> DataFrame:
    """(node_id, community): modularity communities by parallel local moves.

    Each round, a part of the vertices (drawn anew by hash, so that neighbours
    don't change places for ever) moves to the neighbouring community of most
    gain, until none would; then communities become vertices, until none merge.
    A search that doesn't end within ``rounds`` and ``levels`` fails.
    A community is named after its smallest node. Deterministic; all steps are
    joins and aggregations over edges, none gathers a component.
    """
    w = undirected(edges.select("src", "dst", "weight")).select(F.col("a"), F.col("b"), F.col("weight").cast("double").alias("weight"))
    w = stage(w, "louvain-edges")
    total = w.agg(F.sum("weight")).first()[0]
    base = w.select(F.col("a").alias("node_id")).unionByName(w.select(F.col("b").alias("node_id"))).distinct()
    if not total:
        return base.select("node_id", F.col("node_id").alias("community"))
    member = stage(base.select("node_id", F.col("node_id").alias("v")), "louvain-members")
    for level in range(levels):
        both = w.select(F.col("a").alias("v"), F.col("b").alias("u"), "weight").unionByName(w.select(F.col("b").alias("v"), F.col("a").alias("u"), "weight"))
        strength = stage(both.groupBy("v").agg(F.sum("weight").alias("k")), "louvain-strength")
        state = strength.select("v", F.col("v").alias("c"), "k")
        links = stage(both.where("v <> u"), "louvain-links")
        for r in range(rounds):
            size = state.groupBy("c").agg(F.sum("k").alias("tot"))
            near = links.join(state.select(F.col("v").alias("u"), "c"), "u").groupBy("v", "c").agg(F.sum("weight").alias("kin"))
            own = state.select("v", F.col("c").alias("mine"), "k")
            options = own.join(near, "v").join(size, "c")
            out = F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)
            gain = F.col("kin") - resolution * F.col("k") * (F.col("tot") - out) / (2 * total)
            best = options.withColumn("gain", gain).groupBy("v", "mine", "k").agg(
                F.max_by(F.struct("c", "gain"), F.struct(F.round("gain", 9), (F.col("c") == F.col("mine")).cast("int"), F.hash("c"))).alias("b"),
                F.max(F.when(F.col("c") == F.col("mine"), F.col("gain"))).alias("stay"),
            )
            # alone in its community, a vertex gains nothing by staying
            turn = F.pmod(F.xxhash64("v", F.lit(r)), F.lit(2 if r < 10 else 4)) == 0
            moves = best.where(F.col("b.gain") > F.coalesce("stay", F.lit(0.0)) + 1e-9).select("v", F.col("b.c").alias("to"), turn.alias("turn"))
            step = stage(state.join(moves, "v", "left").select("v", F.when(F.col("turn"), F.col("to")).otherwise(F.col("c")).alias("c"), "k", F.col("to").isNotNull().alias("wants")), f"louvain-{level}-{r}")
            state = step.drop("wants")
            if step.where("wants").isEmpty():
                break
        else:
            raise RuntimeError(f"vertices still move after {rounds} rounds")
        named = state.groupBy("c").agg(F.min("v").alias("name"))
        label = stage(state.join(named, "c").select("v", "name"), f"louvain-label{level}")
        if label.where("v <> name").isEmpty():
            break
        member = stage(member.join(label, "v").select("node_id", F.col("name").alias("v")), f"louvain-members{level}")
        w = w.join(label.withColumnsRenamed({"v": "a", "name": "na"}), "a").join(label.withColumnsRenamed({"v": "b", "name": "nb"}), "b")
        w = stage(w.groupBy(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).agg(F.sum("weight").alias("weight")), f"louvain-edges{level}")
    else:
        raise RuntimeError(f"communities still merge after {levels} levels")
    return member.select("node_id", F.col("v").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of a partition (node_id, community)."""
    w = undirected(edges)
    c = communities
    inside = w.join(c.withColumnsRenamed({"node_id": "a", "community": "ca"}), "a").join(c.withColumnsRenamed({"node_id": "b", "community": "cb"}), "b")
    ends = inside.select(F.col("ca").alias("c"), "weight").unionByName(inside.select(F.col("cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("tot"))
    within = inside.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("win"))
    m = w.agg(F.sum("weight")).scalar()
    return ends.join(within, "c", "left").withColumn("m", m).agg(F.sum(F.coalesce("win", F.lit(0.0)) / F.col("m") - resolution * (F.col("tot") / (2 * F.col("m"))) ** 2).alias("modularity"))


def community_prompts(nodes: DataFrame, edges: DataFrame, communities: DataFrame, most_nodes: int = 20, most_edges: int = 15) -> DataFrame:
    """(community, n_nodes, prompt): the first members and inner relations of each community, as text."""
    n = nodes.join(communities, "node_id")
    nth = F.row_number().over(Window.partitionBy("community").orderBy("name", "node_id"))
    listed = n.withColumn("_n", nth).where(F.col("_n") <= most_nodes).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("_n", F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit(")")).alias("t")))).alias("nl"))
    size = n.groupBy("community").agg(F.count("*").alias("n_nodes"))
    ends = nodes.select("node_id", "name")
    c1 = communities.join(ends, "node_id").withColumnsRenamed({"node_id": "src", "community": "cs", "name": "ns"})
    c2 = communities.join(ends, "node_id").withColumnsRenamed({"node_id": "dst", "community": "cd", "name": "nd"})
    inner = edges.join(c1, "src").join(c2, "dst").where("cs = cd")
    nth_e = F.row_number().over(Window.partitionBy("cs").orderBy(F.desc("weight"), "ns", "nd"))
    rel = inner.withColumn("_n", nth_e).where(F.col("_n") <= most_edges).groupBy(F.col("cs").alias("community")).agg(
        F.array_sort(F.collect_list(F.struct("_n", F.concat(F.lit("- "), "ns", F.lit(" --["), "rel_type", F.lit("]--> "), "nd").alias("t")))).alias("rl")
    )
    text = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), "\n")
    return size.join(listed, "community").join(rel, "community", "left").select(
        "community", "n_nodes", F.concat(F.lit("Entities:\n"), text(F.col("nl")), F.when(F.col("rl").isNotNull(), F.concat(F.lit("\nRelations:\n"), text(F.col("rl")))).otherwise("")).alias("prompt")
    )


def default_summary(n_nodes: Column) -> Column:
    return F.format_string("Community of %d related entities", n_nodes)


def mentioned(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node_id): nodes whose name stands in the query, case apart.

    Names are found by their words: a query's word sequences, up to the length of
    the longest name, are joined with the names, so no query meets every node.
    """
    named = nodes.select("node_id", tokens(F.col("name")).alias("w")).where("size(w) > 0").select("node_id", F.array_join("w", " ").alias("words"), F.size("w").alias("n"))
    most = named.agg(F.max("n")).scalar()
    w = queries.select("query_id", tokens(F.col("query")).alias("w"))
    w = w.select("query_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w")))).alias("i"))
    room = F.greatest(F.lit(1), F.least(F.size("w") - F.col("i") + 1, F.coalesce(most, F.lit(1))))
    w = w.withColumn("room", room).select("query_id", "w", "i", F.explode(F.sequence(F.lit(1), F.col("room"))).alias("k"))
    w = w.select("query_id", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("words")).distinct()
    return w.join(named, "words").select("query_id", "node_id").distinct()


def retrieve_by_entities(queries: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, most: int = 20) -> DataFrame:
    """(query_id, node_id, mentioned, degree, rank): mentioned entities and their surroundings, mentioned ones first."""
    hit = stage(mentioned(queries, nodes), "mentioned")
    near = neighbours(edges, hit.select(F.col("node_id").alias("start")).distinct(), depth)
    around = hit.withColumnRenamed("node_id", "start").join(near, "start").select("query_id", "node_id").distinct()
    all_ = hit.withColumn("mentioned", F.lit(True)).unionByName(around.join(hit, ["query_id", "node_id"], "left_anti").withColumn("mentioned", F.lit(False)))
    scored = all_.join(degrees(nodes, edges), "node_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("mentioned"), F.desc("degree"), "node_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def retrieve_by_relationship(edges: DataFrame, nodes: DataFrame, source: str | None = None, target: str | None = None, rel_type: str | None = None, most: int = 30) -> DataFrame:
    """(src, rel_type, dst) of one relation type, out of a source, or into a target, by name."""
    named = lambda side, name: nodes.where(F.col("name_norm") == name.strip().lower()).select(F.col("node_id").alias(side))
    e = edges
    if rel_type:
        e = e.where(F.lower("rel_type") == rel_type.lower())
    if source:
        e = e.join(named("src", source), "src", "left_semi")
    if target:
        e = e.join(named("dst", target), "dst", "left_semi")
    return e.orderBy(F.desc("weight"), "src", "dst").limit(most).select("src", "rel_type", "dst")


def rank_communities(communities: DataFrame, query: str, k: int = 3) -> DataFrame:
    """(community, score): summaries by the share of the query's words in them."""
    q = F.array(*[F.lit(w) for w in sorted(set(query.lower().split()))]) if query.split() else F.array().cast("array<string>")
    s = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("summary", F.lit(""))), r"\s+"), lambda w: w != ""))
    score = F.size(F.array_intersect(q, s)) / F.greatest(F.lit(1), F.size(q))
    return communities.select(F.col("id").alias("community"), score.alias("score")).orderBy(F.desc("score"), "community").limit(k)


def rank_communities_by_vector(communities: DataFrame, query: list[float], k: int = 3) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    s = cosine(F.col("embedding"), q)
    return communities.select(F.col("id").alias("community"), s.alias("score")).where("score is not null and not isnan(score)").orderBy(F.desc("score"), "community").limit(k)


def lookup(nodes: DataFrame, name: str) -> DataFrame:
    """The node of that name, else the last whose name holds it (by node_id)."""
    low = name.strip().lower()
    exact = F.col("name_norm") == low
    return nodes.where(exact | F.col("name_norm").contains(low)).orderBy(F.desc(exact), F.desc("node_id")).limit(1)


def relations_summary(nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(node_id, summary): '--[R]--> t' and '<--[R]-- s' of the heaviest edges of each node."""
    ends = nodes.select("node_id", "name")
    out = edges.join(ends.withColumnsRenamed({"node_id": "dst", "name": "other"}), "dst").select(F.col("src").alias("node_id"), "weight", F.lit(0).alias("way"), "other", F.concat(F.lit("--["), "rel_type", F.lit("]--> "), "other").alias("t"))
    back = edges.join(ends.withColumnsRenamed({"node_id": "src", "name": "other"}), "src").select(F.col("dst").alias("node_id"), "weight", F.lit(1).alias("way"), "other", F.concat(F.lit("<--["), "rel_type", F.lit("]-- "), "other").alias("t"))
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("weight"), "way", "other", "t"))
    top = out.unionByName(back).withColumn("_n", nth).where(F.col("_n") <= most)
    return top.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "t"))), lambda x: x["t"]), "; ").alias("summary"))


def aggregate(nodes: DataFrame, op: str, type_: str | None = None, attribute: str | None = None, value: str | None = None) -> DataFrame:
    """The aggregation language over nodes: COUNT, COUNT_BY, LIST, GROUP_BY and STATS, types case apart."""
    n = nodes.where(F.lower("type") == type_.lower()) if type_ else nodes
    held = F.element_at("attributes", F.lit(attribute)) if attribute else F.lit(None).cast("string")
    op = op.upper()
    if op == "COUNT":
        return n.agg(F.count("*").alias("count"))
    if op == "COUNT_BY":
        hit = n.where(F.lower(F.coalesce(held, F.lit(""))) == (value or "").lower())
        first = hit.orderBy("name", "id").limit(20).agg(F.array_sort(F.collect_list("name")))
        return hit.agg(F.count("*").alias("count")).withColumn("names", first.scalar())
    if op == "LIST":
        return n.select("id", "name")
    if op == "GROUP_BY":
        return n.groupBy(F.coalesce(held, F.lit("unknown")).alias("value")).agg(F.count("*").alias("count"))
    if op == "STATS":
        x = F.trim(held).try_cast("double")
        v = n.select(x.alias("x")).where("x is not null and not isnan(x)")
        return v.agg(F.count("*").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"), F.bround(F.avg("x"), 2).alias("avg"), F.sum("x").alias("sum"))
    raise ValueError(f"unknown aggregation {op!r}")


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes beside the old; of those that exist the old row stays."""
    return nodes.unionByName(new.join(nodes.select("node_id"), "node_id", "left_anti").select(*nodes.columns))


def update_nodes(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of ``changed`` in place of those of the same id; others aren't added."""
    known = changed.join(nodes.select("node_id"), "node_id", "left_semi").select(*nodes.columns)
    return nodes.join(changed.select("node_id"), "node_id", "left_anti").unionByName(known)


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without nodes of ``gone(node_id)`` and the edges at them."""
    e = edges.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti").join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), e.select(*edges.columns)


def add_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between existing nodes; one that exists gains its weight and keeps its type."""
    ok = new.join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi").join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    both = edges.select("src", "dst", "rel_type", "weight", F.lit(0).alias("_new")).unionByName(ok.select("src", "dst", "rel_type", "weight", F.lit(1).alias("_new")))
    g = both.groupBy("src", "dst").agg(F.min(F.struct("_new", "rel_type")).alias("f"), F.sum("weight").alias("weight"))
    return g.select("src", "dst", F.col("f.rel_type").alias("rel_type"), "weight")


def viewer_feed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, payload): one JSON text per node (with degree) and edge."""
    n = nodes.join(degrees(nodes, edges), "node_id").select(F.lit("node").alias("kind"), F.to_json(F.struct("node_id", "name", "type", "degree")).alias("payload"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("src", "dst", "rel_type", "weight")).alias("payload")))
