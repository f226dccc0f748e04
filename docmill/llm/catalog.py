"""Queries of the ten problems and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import components, conversations, language, packing, percentiles, scans, subjects, survivors, tokens, vectors
from docmill.scratch import stage
from docmill.session import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(read)``; ``read(table_name)`` gives a table of the data directory."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda t: table(spark, sf_dir, t))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register


_STEP_SQL = "CASE WHEN v < 1000.0 THEN floor(v / 0.1 + 0.5) / 10.0 " + " ".join(
    f"WHEN v < {b!r} THEN floor(v / {s!r} + 0.5) * {s!r}" for b, s in (("1e4", "1.0"), ("1e5", "1e1"), ("1e6", "1e2"), ("1e7", "1e3"), ("1e8", "1e4"))
).replace("'", "") + " END"

_DAYS_SQL = f"""
WITH once AS (
  SELECT id, lower(trim(path)) AS path, CAST(DATE '1970-01-01' + CAST(floor("timestamp" / 86400) AS INTEGER) AS DATE) AS day,
         min(total_time_ms) AS total_time_ms, min(retrieval_time_ms) AS retrieval_time_ms, min(llm_time_ms) AS llm_time_ms
  FROM query_metrics GROUP BY ALL),
long AS (
  SELECT path, day, 'total_time_ms' AS metric, total_time_ms AS v FROM once UNION ALL
  SELECT path, day, 'retrieval_time_ms', retrieval_time_ms FROM once UNION ALL
  SELECT path, day, 'llm_time_ms', llm_time_ms FROM once),
days AS (
  SELECT path, day, metric, {_STEP_SQL} AS value, count(*) AS n
  FROM long WHERE v IS NOT NULL AND NOT isnan(v) AND v >= 0 AND v < 86400000 GROUP BY ALL)
"""


@query(
    "p1_percentiles",
    _DAYS_SQL
    + """,
both_levels AS (
  SELECT 0 AS overall, path, day, metric, value, n FROM days UNION ALL
  SELECT 1, path, NULL, metric, value, sum(n) FROM days GROUP BY path, metric, value),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY overall, path, day, metric ORDER BY value) AS upto,
         sum(n) OVER (PARTITION BY overall, path, day, metric) AS total FROM both_levels),
q(quantile) AS (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE), (0.999::DOUBLE))
SELECT path, day, metric, quantile, CAST(total AS BIGINT) AS n, value FROM ranked, q
WHERE upto >= greatest(1, ceil(quantile * total - 1e-9)) AND upto - n < greatest(1, ceil(quantile * total - 1e-9))
""",
)
def p1_percentiles(read):
    return percentiles.by_path_and_day(read("query_metrics"))


@query("p1_day_summaries", _DAYS_SQL + "SELECT path, day, metric, value, n FROM days")
def p1_day_summaries(read):
    return percentiles.summary(percentiles.query_times(read("query_metrics")), ["path", "day"])


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _bare(c: str) -> str:
    edge = conversations.INVISIBLE
    return f"coalesce(regexp_replace({c}, {_lit(f'^{edge}|{edge}$')}, '', 'g'), '')"


def _roles(roles) -> str:
    return "(" + ", ".join(map(_lit, roles)) + ")"


_DROPPED_SQL = f"""
WITH m0 AS (SELECT lower({_bare('conversation_id')}) AS cid, id, lower({_bare('role')}) AS r, {_bare('content')} AS content,
    CASE WHEN "timestamp" IS NULL OR isnan("timestamp") OR "timestamp" <= 0 THEN NULL WHEN "timestamp" < 1e11 THEN "timestamp" WHEN "timestamp" < 1e14 THEN "timestamp" / 1e3
         WHEN "timestamp" < 1e17 THEN "timestamp" / 1e6 ELSE "timestamp" / 1e9 END AS ts FROM messages),
m1 AS (SELECT cid, id, content, ts, CASE WHEN r IN {_roles(conversations.QUESTION_ROLES)} THEN 'user' WHEN r IN {_roles(conversations.REPLY_ROLES)} THEN 'assistant' WHEN r IN {_roles(conversations.SIDE_ROLES)} THEN 'side' ELSE '?' END AS speaker FROM m0 WHERE cid <> ''),
m2 AS (SELECT * FROM m1 QUALIFY row_number() OVER (PARTITION BY cid, speaker, content, id ORDER BY ts NULLS LAST) = 1),
m3 AS (SELECT *, ts - lag(ts) OVER (PARTITION BY cid, speaker, content ORDER BY ts NULLS LAST, id) AS gap FROM m2),
m4 AS (SELECT *, bool_or(ts IS NULL) OVER (PARTITION BY cid) AS untimed FROM m3 WHERE gap IS NULL OR gap > 1.0001),
k AS (SELECT cid, id, speaker, CASE WHEN untimed THEN 0 ELSE ts END AS at_ FROM m4
  WHERE content <> '' AND speaker <> 'side' AND NOT (speaker = 'assistant' AND regexp_matches(lower(content), {_lit('(?s)^(' + '|'.join(conversations.FAILURES) + ')$')}))),
o AS (SELECT *, lag(speaker) OVER w AS prev, lead(speaker) OVER w AS nxt FROM k WINDOW w AS (PARTITION BY cid ORDER BY at_, id)),
v AS (SELECT cid, bool_or(speaker = '?') AS unknown, bool_or(prev IS NULL AND speaker <> 'user') AS headless, bool_or(speaker = 'user' AND coalesce(nxt, 'user') = 'user') AS unanswered FROM o GROUP BY cid),
d AS (SELECT c.cid AS conversation_id, CASE WHEN unknown IS NULL THEN 'nothing said' WHEN unknown THEN 'unknown speaker' WHEN headless THEN 'no question at the start' WHEN unanswered THEN 'question without reply' END AS reason
  FROM (SELECT DISTINCT cid FROM m1) c LEFT JOIN v ON c.cid = v.cid)
"""


@query("p2_found", _DROPPED_SQL + "SELECT conversation_id FROM d WHERE reason IS NOT NULL")
def p2_found(read):
    return conversations.reassemble(read("messages"), set_clocks=True)[1].select("conversation_id")


@query("p2_dropped", _DROPPED_SQL + "SELECT conversation_id, reason FROM d WHERE reason IS NOT NULL")
def p2_dropped(read):
    return conversations.reassemble(read("messages"), set_clocks=True)[1]


@query("p2_conversations")
def p2_conversations(read):
    return conversations.reassemble(read("messages"), set_clocks=True)[0]


@query("p2_clock_corrected")
def p2_clock_corrected(read):
    return conversations.reassemble(read("messages"), max_clock_offset_s=120.0, set_clocks=True)[0]


def _language_rows(read):
    rows = stage(language.records(read("extraction_results"), read("benchmark_queries"), read("domain_configs")), "records")
    labelled = read("documents").select("text", language.declared(F.col("lang")).alias("label"))
    return rows, language.fit(labelled.unionByName(rows.select("text", F.col("declared").alias("label"))))


@query("p3_found")
def p3_found(read):
    return language.undeclared(*_language_rows(read))


@query("p3_segments")
def p3_segments(read):
    rows, model = _language_rows(read)
    return language.identify(rows.select("record_id", "text"), model).withColumn("confidence", F.round("confidence", 4))


@query("p4_found")
def p4_found(read):
    return survivors.best_values(read("node_groups"), read("graph_nodes"))


@query("p4_survivors")
def p4_survivors(read):
    return survivors.survivors(read("node_groups"), read("graph_nodes"), read("extraction_results"))


@query("p5_found")
def p5_found(read):
    return scans.defects(read("extraction_results"))


@query("p5_repaired")
def p5_repaired(read):
    return scans.repaired(read("extraction_results"))


def _unit_vectors(read):
    rows = vectors.embedding_rows(read("chunk_embeddings"), read("graph_nodes"), read("communities"))
    return stage(vectors.unit_vectors(rows), "unit")


_VECTORS_SQL = """
WITH r AS (SELECT 'chunk_embeddings|' || coalesce(model, '') AS space, vec_id AS id, embedding::DOUBLE[] AS e FROM chunk_embeddings UNION ALL
  SELECT 'graph_nodes', id, embedding::DOUBLE[] FROM graph_nodes UNION ALL SELECT 'communities', id::VARCHAR, embedding::DOUBLE[] FROM communities),
u AS (SELECT * FROM r WHERE id IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x::VARCHAR IN ('nan', 'inf', '-inf'))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT * FROM (SELECT space, len(e) AS dim, count(*) AS n FROM u GROUP BY space, len(e)) QUALIFY row_number() OVER (PARTITION BY space ORDER BY n DESC, dim DESC) = 1),
v AS (SELECT u.* FROM u JOIN s ON u.space = s.space AND len(u.e) = s.dim)
"""


@query("p6_found", _VECTORS_SQL + "SELECT split_part(a.space, '|', 1) AS source_table, a.id AS id_a, b.id AS id_b FROM v a JOIN v b ON a.space = b.space AND a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.9")
def p6_found(read):
    pairs = vectors.similar_pairs(_unit_vectors(read))
    return pairs.select(F.substring_index("space", "|", 1).alias("source_table"), "id_a", "id_b")


#: The query set of the search for all neighbours: the ids whose hash is divisible by 20.
_ASKED = "pmod(xxhash64(id), 20) = 0"


@query("p6_nearest")
def p6_nearest(read):
    near, _ = vectors.nearest(_unit_vectors(read), queries=F.expr(_ASKED), share=0.35, most_cells=1_500)
    return near.select("space", "id", "other", F.round("cosine", 3).alias("cosine"), "rank")


_TRIM = r"lower(regexp_replace({c}, '^[\s\x{{200b}}\x{{feff}}]+|[\s\x{{200b}}\x{{feff}}]+$', '', 'g'))"


@query(
    "p7_found",
    f"""WITH RECURSIVE v AS (SELECT least(node_a, node_b) AS a, greatest(node_a, node_b) AS b, decided_at, CASE WHEN same_entity THEN 0 ELSE 1 END AS no FROM node_matches WHERE node_a <> node_b),
l AS (SELECT a, b FROM v QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY decided_at DESC NULLS LAST, no DESC) = 1 AND no = 0),
al AS (SELECT DISTINCT id, {_TRIM.format(c='x')} AS t FROM (SELECT id, unnest(aliases) AS x FROM graph_nodes)), nm AS (SELECT DISTINCT id, {_TRIM.format(c='name')} AS t FROM graph_nodes),
e AS (SELECT a, b FROM l UNION SELECT id, x FROM (SELECT id, unnest(merged_from) AS x FROM graph_nodes) WHERE x IS NOT NULL UNION SELECT al.id, nm.id FROM al JOIN nm ON al.t = nm.t WHERE al.t <> ''),
bo AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
rc AS (SELECT a AS id, a AS r FROM bo UNION SELECT rc.id, bo.b FROM rc JOIN bo ON rc.r = bo.a),
g AS (SELECT rc.id, min(rc.r) AS group_id, count(DISTINCT rc.r) AS n FROM rc WHERE rc.r IN (SELECT id FROM graph_nodes) GROUP BY rc.id)
SELECT id AS node_id, group_id FROM g WHERE n > 1 AND id IN (SELECT id FROM graph_nodes)""",
)
def p7_found(read):
    return components.node_groups(read("graph_nodes"), read("node_matches"))


@query("p8_ids")
def p8_ids(read):
    return tokens.encode_column(read("documents"))


@query("p8_round_trip")
def p8_round_trip(read):
    return tokens.round_trip(read("documents"))


@query("p9_containers")
def p9_containers(read):
    return packing.pack(packing.token_sizes(read("documents"))).withColumnRenamed("id", "doc_id")


@query("p9_fill")
def p9_fill(read):
    return packing.fill_report(packing.pack(packing.token_sizes(read("documents"))))


@query("p10_found")
def p10_found(read):
    documents = read("documents")
    return subjects.document_subjects(documents, subjects.fit(documents, read("subject_labels"), read("subjects")))


@query("p10_corpus_shares")
def p10_corpus_shares(read):
    documents = read("documents")
    found = subjects.document_subjects(documents, subjects.fit(documents, read("subject_labels"), read("subjects")))
    return found.groupBy("subject").agg(F.count("*").alias("documents"))
