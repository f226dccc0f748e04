"""Queries of the graph and entity resolution operators, over extraction_results and graph_nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.engine import Engine
from docmill.operators import graph, resolution
from docmill.plans.registry import query
from docmill.scratch import stage

_MENTIONS = r"""
ch AS (SELECT * FROM extraction_results WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY extracted_at NULLS LAST, chunk_text) = 1),
em0 AS (SELECT chunk_id, generate_subscripts(entities, 1) - 1 AS pos, unnest(entities) AS e FROM ch),
em AS (SELECT chunk_id, pos, e.name AS name, e.type AS type, regexp_replace(e.name, '^\s+|\s+$', '', 'g').lower() AS norm FROM em0
       WHERE e.confidence >= 0.7 AND trim(e.name) <> '' AND trim(e.type) <> '' QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY pos) <= 15),
rm0 AS (SELECT chunk_id, generate_subscripts(relationships, 1) - 1 AS pos, unnest(relationships) AS r FROM ch),
rm1 AS (SELECT chunk_id, pos, coalesce(nullif(trim(r.relationship_type), ''), 'RELATED_TO') AS rel_type, regexp_replace(r.source_entity, '^\s+|\s+$', '', 'g').lower() AS s, regexp_replace(r.target_entity, '^\s+|\s+$', '', 'g').lower() AS t FROM rm0),
rm AS (SELECT * FROM rm1 WHERE EXISTS (SELECT 1 FROM em WHERE em.chunk_id = rm1.chunk_id AND em.norm = rm1.s) AND EXISTS (SELECT 1 FROM em WHERE em.chunk_id = rm1.chunk_id AND em.norm = rm1.t)
       QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY pos) <= 20),
nodes AS (SELECT substr(md5(norm), 1, 16) AS node_id, norm AS name_norm, arg_min(name, (chunk_id, pos)) AS name, arg_min(type, (chunk_id, pos)) AS type, count(*) AS n_mentions FROM em GROUP BY norm),
edges AS (SELECT substr(md5(s), 1, 16) AS src, substr(md5(t), 1, 16) AS dst, arg_min(rel_type, (chunk_id, pos)) AS rel_type, count(*)::DOUBLE AS weight FROM rm GROUP BY s, t)"""


def _graph(read):
    ch = graph.chunks_once(read("extraction_results"))
    em = stage(graph.entity_mentions(ch), "mentions")
    rm = stage(graph.relation_mentions(ch, em), "relations")
    return em, rm


def _tables(read):
    em, rm = _graph(read)
    return stage(graph.build_nodes(em), "nodes"), stage(graph.build_edges(rm), "edges")


@query("kg_nodes", f"WITH {_MENTIONS} SELECT * FROM nodes")
def kg_nodes(read):
    return graph.build_nodes(_graph(read)[0])


@query("kg_edges", f"WITH {_MENTIONS} SELECT * FROM edges")
def kg_edges(read):
    return graph.build_edges(_graph(read)[1])


@query("entity_mentions", f"WITH {_MENTIONS} SELECT chunk_id, pos, name, type FROM em")
def entity_mentions(read):
    return _graph(read)[0].select("chunk_id", F.col("pos").cast("long").alias("pos"), "name", "type")


@query("relation_mentions", f"WITH {_MENTIONS} SELECT chunk_id, pos, rel_type, s, t FROM rm")
def relation_mentions(read):
    r = _graph(read)[1]
    return r.select("chunk_id", F.col("pos").cast("long").alias("pos"), "rel_type", graph.normalize_name(F.col("source_entity")).alias("s"), graph.normalize_name(F.col("target_entity")).alias("t"))


@query("node_chunks", f"WITH {_MENTIONS} SELECT DISTINCT substr(md5(norm), 1, 16) AS node_id, chunk_id FROM em")
def node_chunks(read):
    return graph.node_chunks(_graph(read)[0])


@query("relation_resolution", f"WITH {_MENTIONS} SELECT count(*) FILTER (a.norm IS NOT NULL AND b.norm IS NOT NULL) AS resolved, count(*) FILTER (a.norm IS NULL OR b.norm IS NULL) AS failed FROM rm1 LEFT JOIN (SELECT DISTINCT norm FROM em) a ON s = a.norm LEFT JOIN (SELECT DISTINCT norm FROM em) b ON t = b.norm")
def relation_resolution(read):
    ch = graph.chunks_once(read("extraction_results"))
    em = graph.entity_mentions(ch)
    r = ch.select(F.explode("relationships").alias("r")).select("r.source_entity", "r.target_entity")
    return graph.resolve_relations(r, graph.build_nodes(em))


@query(
    "kg_stats",
    f"""WITH {_MENTIONS}, n AS (SELECT count(*)::DOUBLE AS n FROM nodes), e AS (SELECT count(*)::DOUBLE AS e FROM edges)
SELECT 'total_nodes' AS stat, NULL AS key, n AS value FROM n UNION ALL SELECT 'total_edges', NULL, e FROM e UNION ALL SELECT 'average_degree', NULL, CASE WHEN n > 0 THEN 2 * e / n ELSE 0 END FROM n, e
UNION ALL SELECT 'nodes_by_type', type, count(*)::DOUBLE FROM nodes GROUP BY type UNION ALL SELECT 'edges_by_relation', rel_type, count(*)::DOUBLE FROM edges GROUP BY rel_type""",
)
def kg_stats(read):
    return graph.statistics(*_tables(read))


@query("kg_degree", f"WITH {_MENTIONS}, d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) SELECT node_id, coalesce(n, 0) AS degree FROM nodes LEFT JOIN d ON node_id = id")
def kg_degree(read):
    return graph.degrees(*_tables(read))


@query("kg_undirected", f"WITH {_MENTIONS} SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS weight FROM edges GROUP BY ALL")
def kg_undirected(read):
    return graph.undirected(_tables(read)[1])


@query(
    "neighbors_bfs",
    f"""WITH RECURSIVE {_MENTIONS}, st AS (SELECT DISTINCT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges),
w AS (SELECT DISTINCT src AS start, src AS node_id, 0 AS d FROM edges UNION SELECT w.start, st.y, w.d + 1 FROM w JOIN st ON w.node_id = st.x WHERE w.d < 2)
SELECT start, node_id, min(d) AS distance FROM w GROUP BY ALL HAVING min(d) > 0""",
)
def neighbors_bfs(read):
    """Two steps around every node that has an edge out."""
    e = _tables(read)[1]
    return graph.neighbours(e, e.select(F.col("src").alias("start")).distinct(), 2)


@query(
    "simple_paths",
    f"""WITH RECURSIVE {_MENTIONS}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
p AS (SELECT src, dst FROM e UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst),
w AS (SELECT p.src, p.dst, p.src AS cur, [p.src] AS path, 0 AS d FROM p UNION ALL SELECT w.src, w.dst, e.dst, list_append(w.path, e.dst), w.d + 1 FROM w JOIN e ON w.cur = e.src WHERE w.d < 3 AND w.cur <> w.dst AND NOT list_contains(w.path, e.dst))
SELECT src, dst, d AS length, array_to_string(path, '>') AS path FROM w WHERE cur = dst QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY d, path) <= 10""",
)
def simple_paths(read):
    """All ways between nodes that one or two edges connect, three steps at most."""
    e = _tables(read)[1]
    one = e.where("src <> dst").select("src", "dst").distinct()
    two = one.select("src", F.col("dst").alias("mid")).join(one.select(F.col("src").alias("mid"), "dst"), "mid").where("src <> dst").select("src", "dst")
    pairs = one.unionByName(two).distinct()
    return graph.simple_paths(e, pairs).withColumn("path", F.array_join("path", ">"))


@query("relations_by_type", f"WITH {_MENTIONS} SELECT src, rel_type, dst FROM edges WHERE lower(rel_type) = 'uses' ORDER BY weight DESC, src, dst LIMIT 30")
def relations_by_type(read):
    n, e = _tables(read)
    return graph.retrieve_by_relationship(e, n, rel_type="USES")


@query("entity_lookup", f"WITH {_MENTIONS} SELECT node_id, name, type FROM nodes WHERE contains(name_norm, 'register') ORDER BY name_norm = 'register' DESC, node_id DESC LIMIT 1")
def entity_lookup(read):
    return graph.lookup(_tables(read)[0], "Register").select("node_id", "name", "type")


@query(
    "relations_summary",
    f"""WITH {_MENTIONS}, r AS (
SELECT src AS node_id, weight, 0 AS way, name AS other, '--[' || rel_type || ']--> ' || name AS t FROM edges JOIN nodes ON dst = nodes.node_id UNION ALL
SELECT dst, weight, 1, name, '<--[' || rel_type || ']-- ' || name FROM edges JOIN nodes ON src = nodes.node_id),
k AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY weight DESC, way, other, t) AS n FROM r QUALIFY n <= 5)
SELECT node_id, string_agg(t, '; ' ORDER BY n) AS summary FROM k GROUP BY node_id""",
)
def relations_summary(read):
    return graph.relations_summary(*_tables(read))


_QTOK = r"array_to_string(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), ' ')"


@query(
    "retrieve_by_entities",
    f"""WITH RECURSIVE {_MENTIONS}, q AS (SELECT chunk_id || '#' || pos AS query_id, ' ' || {_QTOK.format(c="'How is ' || s || ' related to ' || t || '?'")} || ' ' AS q FROM rm),
hit AS (SELECT DISTINCT query_id, node_id FROM q, (SELECT node_id, {_QTOK.format(c='name')} AS w FROM nodes) n WHERE w <> '' AND contains(q, ' ' || w || ' ')),
st AS (SELECT DISTINCT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges),
a AS (SELECT query_id, y AS node_id FROM hit JOIN st ON node_id = x), b AS (SELECT query_id, y AS node_id FROM a JOIN st ON node_id = x),
al AS (SELECT query_id, node_id, true AS mentioned FROM hit UNION ALL (SELECT DISTINCT query_id, node_id, false FROM (SELECT * FROM a UNION SELECT * FROM b) x WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.query_id = x.query_id AND hit.node_id = x.node_id))),
d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)
SELECT query_id, node_id, mentioned, coalesce(n, 0) AS degree, row_number() OVER (PARTITION BY query_id ORDER BY mentioned DESC, coalesce(n, 0) DESC, node_id) AS rank FROM al LEFT JOIN d ON node_id = id QUALIFY rank <= 20""",
)
def retrieve_by_entities(read):
    """A question about each relation stands in for queries that name entities."""
    rm = _graph(read)[1]
    n, e = _tables(read)
    q = rm.select(F.concat_ws("#", "chunk_id", "pos").alias("query_id"), F.concat(F.lit("How is "), "source_entity", F.lit(" related to "), "target_entity", F.lit("?")).alias("query"))
    return graph.retrieve_by_entities(q, n, e).select("query_id", "node_id", "mentioned", "degree", "rank")


@query(
    "prune_sources",
    f"""WITH {_MENTIONS}, gone AS (SELECT chunk_id FROM ch WHERE starts_with(document, 'wiki/')),
nc AS (SELECT DISTINCT substr(md5(norm), 1, 16) AS node_id, chunk_id FROM em), ec AS (SELECT DISTINCT substr(md5(s), 1, 16) AS src, substr(md5(t), 1, 16) AS dst, chunk_id FROM rm),
lost AS (SELECT node_id FROM nc GROUP BY node_id HAVING count(*) FILTER (chunk_id NOT IN (SELECT chunk_id FROM gone)) = 0),
el AS (SELECT src, dst FROM ec GROUP BY ALL HAVING count(*) FILTER (chunk_id NOT IN (SELECT chunk_id FROM gone)) = 0),
kept AS (SELECT src, dst FROM edges WHERE (src, dst) NOT IN (SELECT (src, dst) FROM el) AND src NOT IN (SELECT node_id FROM lost) AND dst NOT IN (SELECT node_id FROM lost))
SELECT 'nodes_removed' AS counter, (SELECT count(*) FROM lost) AS value UNION ALL
SELECT 'nodes_updated', (SELECT count(DISTINCT node_id) FROM nc WHERE chunk_id IN (SELECT chunk_id FROM gone) AND node_id NOT IN (SELECT node_id FROM lost)) UNION ALL
SELECT 'edges_removed', (SELECT count(*) FROM edges) - (SELECT count(*) FROM kept) UNION ALL
SELECT 'edges_updated', (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM ec WHERE chunk_id IN (SELECT chunk_id FROM gone)) WHERE (src, dst) IN (SELECT (src, dst) FROM kept))""",
)
def prune_sources(read):
    """Counters of removing every chunk of one folder."""
    em, rm = _graph(read)
    gone = graph.chunks_once(read("extraction_results")).where("document like 'wiki/%'").select("chunk_id")
    return graph.prune(graph.node_chunks(em), graph.edge_chunks(rm), graph.build_nodes(em), graph.build_edges(rm), gone)["counts"]


@query("louvain")
def louvain(read):
    """Communities depend on the order of moves; checked by modularity in pytest."""
    return graph.louvain(_tables(read)[1])


@query("community_prompts")
def community_prompts(read):
    n, e = _tables(read)
    return graph.community_prompts(n, e, graph.louvain(e))


_SUMMARY_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(summary, '')), '\s+'), lambda w: w <> ''))"


@query("community_rank", f"SELECT id AS community, len(list_intersect(['carbon', 'intensity', 'working', 'group'], {_SUMMARY_WORDS})) / 4.0 AS score FROM communities ORDER BY score DESC, id LIMIT 3")
def community_rank(read):
    return graph.rank_communities(read("communities"), "working group carbon intensity")


@query("community_members", "SELECT id AS community, level, node_id FROM (SELECT id, level, unnest(node_ids) AS node_id FROM communities) WHERE node_id IN (SELECT id FROM graph_nodes)")
def community_members(read):
    m = read("communities").select(F.col("id").alias("community"), "level", F.explode("node_ids").alias("node_id"))
    return m.join(read("graph_nodes").select(F.col("id").alias("node_id")), "node_id", "left_semi").select("community", "level", "node_id")


@query(
    "viewer_feed",
    f"""WITH {_MENTIONS}, d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)
SELECT 'node' AS kind, to_json({{'node_id': node_id, 'name': name, 'type': type, 'degree': coalesce(n, 0)}})::VARCHAR AS payload FROM nodes LEFT JOIN d ON node_id = id
UNION ALL SELECT 'edge', to_json({{'src': src, 'dst': dst, 'rel_type': rel_type, 'weight': weight}})::VARCHAR FROM edges""",
)
def viewer_feed(read):
    return graph.viewer_feed(*_tables(read))


@query("remove_nodes", f"WITH {_MENTIONS}, gone AS (SELECT node_id FROM nodes WHERE type = 'CONCEPT') SELECT 'node' AS what, node_id AS a, NULL AS b FROM nodes WHERE node_id NOT IN (SELECT node_id FROM gone) UNION ALL SELECT 'edge', src, dst FROM edges WHERE src NOT IN (SELECT node_id FROM gone) AND dst NOT IN (SELECT node_id FROM gone)")
def remove_nodes(read):
    n, e = _tables(read)
    kept, left = graph.remove_nodes(n, e, n.where("type = 'CONCEPT'").select("node_id"))
    return kept.select(F.lit("node").alias("what"), F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(left.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query("fused_context")
def fused_context(read):
    """Contexts of all benchmark queries from both arms; their parts have SQL of their own, the assembly is checked by pytest."""
    em, rm = _graph(read)
    d = read("documents")
    e = Engine(d.sparkSession, d, stage(graph.build_nodes(em), "nodes"), stage(graph.build_edges(rm), "edges"), node_chunks=graph.node_chunks(em))
    q = read("benchmark_queries").where("query is not null").select("query_id", "query").dropDuplicates(["query_id"])
    return e.retrieve(q).select("query_id", "query_type", "path", F.round("vector_weight", 4).alias("vector_weight"), F.md5(F.coalesce("context", F.lit(""))).alias("context"), "n_sources")


@query("domain_themes", "SELECT language, array_to_string(list_sort(list_distinct(flatten(list(document_types)))), '|') AS types FROM domain_configs WHERE language IS NOT NULL GROUP BY language")
def domain_themes(read):
    """Lists of several records as one without repeats."""
    d = read("domain_configs").where("language is not null").select("language", F.explode_outer("document_types").alias("t"))
    return d.groupBy("language").agg(F.array_join(F.array_sort(F.collect_set("t")), "|").alias("types"))


# the aggregation language


@query("agg_count", "SELECT count(*) AS count FROM graph_nodes WHERE lower(type) = 'system'")
def agg_count(read):
    return graph.aggregate(read("graph_nodes"), "COUNT", "System")


@query("agg_count_by", "SELECT (SELECT count(*) FROM graph_nodes WHERE lower(coalesce(attributes['year'], '')) = '2014') AS count, (SELECT array_to_string(list(name ORDER BY name), '|') FROM (SELECT name FROM graph_nodes WHERE lower(coalesce(attributes['year'], '')) = '2014' AND name IS NOT NULL ORDER BY name, id LIMIT 20)) AS names")
def agg_count_by(read):
    n = read("graph_nodes").where("name is not null or coalesce(element_at(attributes, 'year'), '') <> '2014'")
    c = graph.aggregate(read("graph_nodes"), "COUNT_BY", attribute="year", value="2014").select("count")
    return c.withColumn("names", graph.aggregate(n, "COUNT_BY", attribute="year", value="2014").select(F.array_join("names", "|")).scalar())


@query("agg_list", "SELECT id, name FROM graph_nodes WHERE lower(type) = 'dataset'")
def agg_list(read):
    return graph.aggregate(read("graph_nodes"), "LIST", "DATASET")


@query("agg_group_by", "SELECT coalesce(attributes['year'], 'unknown') AS value, count(*) AS count FROM graph_nodes GROUP BY ALL")
def agg_group_by(read):
    return graph.aggregate(read("graph_nodes"), "GROUP_BY", attribute="year")


@query("agg_stats", "WITH v AS (SELECT TRY_CAST(trim(attributes['year']) AS DOUBLE) AS x FROM graph_nodes) SELECT count(*) AS count, min(x) AS min, max(x) AS max, round(avg(x), 2) AS avg, sum(x) AS sum FROM v WHERE x IS NOT NULL AND NOT isnan(x)")
def agg_stats(read):
    return graph.aggregate(read("graph_nodes"), "STATS", attribute="year")


@query("database_stats", "SELECT count(*) AS total_chunks, count(DISTINCT coalesce(nullif(trim(source), ''), 'unknown')) AS documents, count(DISTINCT kind) AS kinds FROM documents")
def database_stats(read):
    d = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown"))
    return read("documents").agg(F.count("*").alias("total_chunks"), F.count_distinct(d).alias("documents"), F.count_distinct("kind").alias("kinds"))


@query("document_list", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def document_list(read):
    return read("documents").where("source is not null").select("source").distinct()


# entity resolution

_PAIRS = """v AS (SELECT id, embedding::DOUBLE[] AS e FROM graph_nodes WHERE embedding IS NOT NULL AND len(embedding) > 0),
pr AS (SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.e, b.e) AS similarity FROM v a JOIN v b ON a.id < b.id AND len(a.e) = len(b.e)),
pairs AS (SELECT * FROM pr WHERE similarity >= 0.9 AND NOT isnan(similarity))"""


def _pairs(read):
    return resolution.candidate_pairs(read("graph_nodes").select("id", F.col("embedding").alias("vec")), 0.9)


@query("candidate_pairs", f"WITH {_PAIRS} SELECT id_a, id_b, round(similarity, 6) AS similarity FROM pairs")
def candidate_pairs(read):
    return _pairs(read).withColumn("similarity", F.round("similarity", 6))


_SAME = """sm AS (SELECT node_a AS a, node_b AS b FROM node_matches WHERE same_entity AND confidence >= 0.7 AND node_a <> node_b),
bo AS (SELECT a, b FROM sm UNION SELECT b, a FROM sm),
rc AS (SELECT a AS id, a AS r FROM bo UNION SELECT rc.id, bo.b FROM rc JOIN bo ON rc.r = bo.a),
roots AS (SELECT id, min(r) AS root FROM rc GROUP BY id)"""


#: Edges a cell of the grid: few, so that several cells and rounds are needed on these tables too.
CELL_EDGES = 200


def _roots(read):
    m = read("node_matches").where("same_entity and confidence >= 0.7 and node_a <> node_b")
    return resolution.clusters(m.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), CELL_EDGES)


@query("entity_clusters", f"WITH RECURSIVE {_SAME} SELECT id, root FROM roots")
def entity_clusters(read):
    """Clusters of sure verdicts."""
    return _roots(read)


_MEMBERS = "m AS (SELECT roots.root, g.id, g.name, g.type, g.attributes FROM roots JOIN graph_nodes g USING (id))"


@query(
    "merge_entities",
    f"""WITH RECURSIVE {_SAME}, {_MEMBERS},
nm AS (SELECT * FROM (SELECT root, name, count(*) AS n FROM m WHERE name IS NOT NULL GROUP BY root, name) QUALIFY row_number() OVER (PARTITION BY root ORDER BY n DESC, length(name) DESC, name) = 1)
SELECT s.root, nm.name, o.type, s.n AS n_members FROM (SELECT root, count(*) AS n FROM m GROUP BY root) s LEFT JOIN nm ON s.root = nm.root LEFT JOIN (SELECT root, type FROM m WHERE id = root) o ON s.root = o.root""",
)
def merge_entities(read):
    return resolution.merged_nodes(read("graph_nodes"), _roots(read))


@query("majority_type", f"WITH RECURSIVE {_SAME}, {_MEMBERS} SELECT root, type FROM (SELECT root, type, count(*) AS n, min(id) AS f FROM m WHERE type IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY root ORDER BY n DESC, f) = 1")
def majority_type(read):
    """Of equally frequent types the one whose first member comes first by id."""
    m = read("graph_nodes").where("type is not null").join(_roots(read), "id")
    return resolution.majority_type(m.select("root", "type", F.col("id").alias("ord")))


@query(
    "merge_attributes",
    f"""WITH RECURSIVE {_SAME}, {_MEMBERS}, kv AS (SELECT root, unnest(map_keys(attributes)) AS key, unnest(map_values(attributes)) AS value FROM m WHERE attributes IS NOT NULL),
g AS (SELECT root, key, count(DISTINCT value) AS n, min(value) AS single, count(*) FILTER (TRY_CAST(value AS DOUBLE) IS NULL) AS texts, arg_max(value, (TRY_CAST(value AS DOUBLE), value)) AS top, arg_min(value, (-length(value), value)) AS longest FROM kv WHERE value IS NOT NULL GROUP BY ALL)
SELECT root, key, CASE WHEN n = 1 THEN single WHEN texts = 0 THEN top ELSE longest END AS value FROM g""",
)
def merge_attributes(read):
    return resolution.merge_attributes(read("graph_nodes").join(_roots(read), "id").select("root", "attributes"))


@query("merged_descriptions")
def merged_descriptions(read):
    """Greedy over sentences in order; checked against a plain loop by pytest."""
    m = read("graph_nodes").where("description is not null").join(_roots(read), "id")
    return resolution.merge_descriptions(m.select("root", F.col("id").alias("ord"), "description"))


@query(
    "redirect_edges",
    f"""WITH RECURSIVE {_SAME}, ed AS (SELECT node_a AS src, node_b AS dst, count(*)::DOUBLE AS weight FROM node_matches GROUP BY ALL),
mv AS (SELECT coalesce(x.root, src) AS src, coalesce(y.root, dst) AS dst, weight, ed.src = ed.dst AS was_loop FROM ed LEFT JOIN roots x ON src = x.id LEFT JOIN roots y ON dst = y.id),
lp AS (SELECT DISTINCT src FROM ed WHERE src = dst)
SELECT src, dst, sum(weight) AS weight FROM mv WHERE src <> dst OR src IN (SELECT src FROM lp) GROUP BY ALL""",
)
def redirect_edges(read):
    e = read("node_matches").groupBy(F.col("node_a").alias("src"), F.col("node_b").alias("dst")).agg(F.count("*").cast("double").alias("weight")).withColumn("rel_type", F.lit("COMPARED"))
    return resolution.redirect_edges(e, _roots(read)).select("src", "dst", "weight")


@query(
    "resolved_nodes",
    f"""WITH RECURSIVE {_SAME}, {_MEMBERS},
nm AS (SELECT * FROM (SELECT root, name, count(*) AS n FROM m WHERE name IS NOT NULL GROUP BY root, name) QUALIFY row_number() OVER (PARTITION BY root ORDER BY n DESC, length(name) DESC, name) = 1),
b AS (SELECT s.root AS id, nm.name, o.type FROM (SELECT DISTINCT root FROM m) s LEFT JOIN nm ON s.root = nm.root LEFT JOIN (SELECT root, type FROM m WHERE id = root) o ON s.root = o.root),
lone AS (SELECT * FROM graph_nodes WHERE id NOT IN (SELECT id FROM roots)),
al AS (SELECT DISTINCT m.root AS id, m.name AS alias FROM m JOIN b ON m.root = b.id WHERE m.name IS NOT NULL AND m.name <> b.name UNION SELECT id, alias FROM (SELECT id, unnest(aliases) AS alias FROM lone) WHERE alias IS NOT NULL),
ch AS (SELECT DISTINCT id, chunk FROM (SELECT r.root AS id, unnest(g.source_chunks) AS chunk FROM roots r JOIN graph_nodes g USING (id) UNION ALL SELECT id, unnest(source_chunks) FROM lone) WHERE chunk IS NOT NULL),
n AS (SELECT id, name, type FROM b UNION ALL SELECT id, name, type FROM lone),
mm AS (SELECT root AS id, count(*) AS n FROM m GROUP BY root)
SELECT n.id, n.name, n.type, coalesce(mm.n, 0) AS merged_from, coalesce(a.n, 0) AS aliases, coalesce(c.n, 0) AS chunks FROM n LEFT JOIN mm USING (id)
LEFT JOIN (SELECT id, count(*) AS n FROM al GROUP BY id) a USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM ch GROUP BY id) c USING (id)""",
)
def resolved_nodes(read):
    """The nodes after merging, with the sizes of what each was merged from."""
    t = resolution.apply_merges(read("graph_nodes"), _roots(read))
    out = t["nodes"].select("id", "name", "type")
    for name, key in (("merged_from", "members"), ("aliases", "aliases"), ("chunks", "node_chunks")):
        out = out.join(t[key].groupBy("id").agg(F.count("*").alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


@query(
    "resolved_edges",
    f"""WITH RECURSIVE {_SAME}, ed AS (SELECT node_a AS src, node_b AS dst, coalesce(decided_at::VARCHAR, '?') AS chunk FROM node_matches)
SELECT src, dst, count(DISTINCT chunk) AS chunks FROM (SELECT coalesce(x.root, src) AS src, coalesce(y.root, dst) AS dst, chunk FROM ed LEFT JOIN roots x ON src = x.id LEFT JOIN roots y ON dst = y.id) WHERE src <> dst GROUP BY ALL""",
)
def resolved_edges(read):
    """The support of edges after merging; times of decisions stand in for chunks."""
    e = read("node_matches").select(F.col("node_a").alias("src"), F.col("node_b").alias("dst"), F.coalesce(F.col("decided_at").cast("string"), F.lit("?")).alias("chunk_id"))
    return resolution.redirect_support(e, _roots(read)).groupBy("src", "dst").agg(F.count("*").alias("chunks"))


_LOW = r"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"
_INITIALS = r"array_to_string(list_transform(list_filter(regexp_split_to_array({n}, '\s+'), lambda w: w <> ''), lambda w: w[1]), '')"


@query(
    "rule_verdicts",
    rf"""WITH {_PAIRS}, n AS (SELECT id, {_LOW.format(c='name')} AS n, list_transform(aliases, lambda x: {_LOW.format(c='x')}) AS al FROM graph_nodes),
x AS (SELECT id_a, id_b, a.n AS a, b.n AS b, a.al AS al_a, b.al AS al_b, {_INITIALS.format(n='a.n')} AS ia, {_INITIALS.format(n='b.n')} AS ib FROM pairs JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b)
SELECT id_a, id_b, coalesce(a <> '' AND b <> '' AND (a = b OR coalesce(list_contains(al_a, b), false) OR coalesce(list_contains(al_b, a), false)
  OR (length(a) >= 2 AND a = ib AND regexp_matches(b, '\s')) OR (length(b) >= 2 AND b = ia AND regexp_matches(a, '\s'))), false) AS same_entity FROM x""",
)
def rule_verdicts(read):
    """The default verdict on the candidate pairs."""
    n = read("graph_nodes")
    side = lambda s: n.select(F.col("id").alias(f"id_{s}"), F.col("name").alias(f"name_{s}"), F.col("aliases").alias(f"al_{s}"))
    p = _pairs(read).join(side("a"), "id_a").join(side("b"), "id_b")
    same = resolution.same_by_rule(F.col("name_a"), F.col("al_a"), F.col("name_b"), F.col("al_b"))
    return p.select("id_a", "id_b", F.coalesce(same, F.lit(False)).alias("same_entity"))
