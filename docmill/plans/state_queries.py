"""Queries of the state operators: metrics, caches, chat, manifests, and windows over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import state
from docmill.plans.registry import query
from docmill.sources import files
from docmill.streaming import jobs

_NUM = "CASE WHEN {c}::VARCHAR <> 'nan' THEN {c} END"  # isnan() may be folded away by statistics that leave NaN out
_TOTAL = _NUM.format(c="total_time_ms")


@query(
    "metrics_global",
    f"""SELECT count(*) AS total_queries, round(coalesce(avg({_TOTAL}), 0), 1) AS avg_latency_ms,
  round(CASE WHEN sum(cache_hits) + sum(cache_misses) > 0 THEN 100.0 * sum(cache_hits) / (sum(cache_hits) + sum(cache_misses)) ELSE 0 END, 1)::DOUBLE AS cache_hit_rate, round(coalesce(avg(agent_steps), 0), 1) AS avg_agent_steps FROM query_metrics""",
)
def metrics_global(read):
    return state.metrics_global(read("query_metrics"))


@query("metrics_by_path", f"SELECT path, count(*) AS count, round(avg({_TOTAL}), 1) AS avg_latency_ms FROM query_metrics WHERE path IS NOT NULL GROUP BY path")
def metrics_by_path(read):
    return state.metrics_by(read("query_metrics"), "path")


@query("metrics_by_type", f"SELECT query_type, count(*) AS count, round(avg({_TOTAL}), 1) AS avg_latency_ms FROM query_metrics WHERE query_type IS NOT NULL GROUP BY query_type")
def metrics_by_type(read):
    return state.metrics_by(read("query_metrics"), "query_type")


@query("metrics_timing", "SELECT path, " + ", ".join(f"round(coalesce(avg({_NUM.format(c=c)}), 0), 1) AS {c}" for c in state.STAGE_TIMES) + ", count(*) AS count FROM query_metrics GROUP BY path")
def metrics_timing(read):
    return state.timing_breakdown(read("query_metrics"))


@query("metrics_percentiles", f"SELECT round(quantile_cont({_TOTAL}, 0.5), 1) AS p50, round(quantile_cont({_TOTAL}, 0.95), 1) AS p95, round(quantile_cont({_TOTAL}, 0.99), 1) AS p99 FROM query_metrics")
def metrics_percentiles(read):
    return state.latency_percentiles(read("query_metrics"))


@query("latency_recent", 'SELECT id, "timestamp", total_time_ms FROM (SELECT DISTINCT id, "timestamp", total_time_ms FROM query_metrics WHERE "timestamp" IS NOT NULL) ORDER BY "timestamp" DESC, id DESC LIMIT 100')
def latency_recent(read):
    return state.latest(read("query_metrics").select("id", "timestamp", "total_time_ms").distinct(), 100)


@query("recent_queries", """SELECT id, path, query_type, round(total_time_ms, 0) AS ms FROM (SELECT DISTINCT id, "timestamp", path, query_type, total_time_ms FROM query_metrics WHERE "timestamp" IS NOT NULL) ORDER BY "timestamp" DESC, id DESC LIMIT 20""")
def recent_queries(read):
    m = read("query_metrics").select("id", "timestamp", "path", "query_type", "total_time_ms").distinct()
    return state.latest(m, 20).select("id", "path", "query_type", F.round("total_time_ms", 0).alias("ms"))


@query("tool_usage", "SELECT tool, count(*) AS n FROM (SELECT unnest(from_json(tools_used, '[\"VARCHAR\"]')) AS tool FROM query_metrics WHERE tools_used IS NOT NULL) GROUP BY tool")
def tool_usage(read):
    t = read("query_metrics").select(F.explode(F.from_json("tools_used", "array<string>")).alias("tool"))
    return t.groupBy("tool").agg(F.count("*").alias("n"))


@query("retrieval_log", f"SELECT path, round(avg({_NUM.format(c='retrieval_time_ms')}), 3) AS retrieval, round(avg({_NUM.format(c='rerank_time_ms')}), 3) AS rerank FROM query_metrics GROUP BY path")
def retrieval_log(read):
    m = read("query_metrics")
    return m.groupBy("path").agg(F.round(F.avg(state._number("retrieval_time_ms")), 3).alias("retrieval"), F.round(F.avg(state._number("rerank_time_ms")), 3).alias("rerank"))


@query("embedding_cache_stats", "SELECT model, count(*) AS entries, count(DISTINCT content_hash) AS contents, coalesce(sum(content_length), 0)::BIGINT AS total_length FROM chunk_embeddings GROUP BY model")
def embedding_cache_stats(read):
    c = read("chunk_embeddings")
    return c.groupBy("model").agg(F.count("*").alias("entries"), F.count_distinct("content_hash").alias("contents"), F.coalesce(F.sum("content_length"), F.lit(0)).alias("total_length"))


@query("embedding_reuse", "SELECT d.doc_id, d.text IS NOT NULL AND EXISTS (SELECT 1 FROM documents o WHERE o.text = d.text AND o.doc_id < d.doc_id) AS known FROM documents d WHERE d.text IS NOT NULL")
def embedding_reuse(read):
    """Which texts have their vector already, if documents are embedded in order of their ids."""
    d = read("documents").where("text is not null").select(F.col("doc_id").alias("chunk_id"), "text")
    cache = d.select(F.sha2("text", 256).alias("content_hash"), F.col("chunk_id").alias("vec"), F.col("chunk_id").alias("created_at"))
    known, _ = state.reusable_vectors(d, cache)
    return known.select(F.col("chunk_id").alias("doc_id"), (F.col("vec") < F.col("chunk_id")).alias("known"))


_CACHE = "(SELECT vec_id AS key, CASE model WHEN 'lexi-embed-64' THEN 'lookup_entity' WHEN 'corvo-embed-64' THEN 'retrieve_graph' ELSE 'other' END AS tool, epoch(created_at::TIMESTAMP)::DOUBLE AS created_at FROM chunk_embeddings WHERE created_at IS NOT NULL)"
NOW = 1_768_000_000.0


def _cache(read):
    c = read("chunk_embeddings").where("created_at is not null")
    tool = F.when(F.col("model") == "lexi-embed-64", "lookup_entity").when(F.col("model") == "corvo-embed-64", "retrieve_graph").otherwise("other")
    return c.select(F.col("vec_id").alias("key"), tool.alias("tool"), F.col("created_at").cast("timestamp").cast("double").alias("created_at"))


@query("cache_valid", f"SELECT tool, count(*) AS total, count(*) FILTER ({NOW} - created_at < CASE tool WHEN 'lookup_entity' THEN 600 WHEN 'retrieve_graph' THEN 300 ELSE 120 END) AS valid FROM {_CACHE} GROUP BY tool")
def cache_valid(read):
    return state.cache_statistics(_cache(read), NOW)


@query("cache_evict", f"SELECT key FROM {_CACHE} ORDER BY created_at DESC, key LIMIT 50")
def cache_evict(read):
    return state.evict(_cache(read), 50).select("key")


@query(
    "semantic_cache_match",
    """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS key, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0)
SELECT query_id, key, round(s, 6) AS similarity FROM s WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) = 1""",
)
def semantic_cache_match(read):
    """Cached queries are the vectors whose id isn't divisible by 20; the label stands in for equal parameters."""
    e = read("embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("params"), F.col("embedding").alias("qvec"))
    c = e.where("vec_id % 20 <> 0").select(F.col("vec_id").alias("key"), F.col("label").alias("params"), F.col("embedding").alias("vec"), F.lit(NOW - 1).alias("created_at"))
    return state.semantic_match(q, c, NOW, least=0.3).withColumn("similarity", F.round("similarity", 6))


@query(
    "quota_breaker",
    """WITH a AS (SELECT user_id, event_id, event_type IN ('error', 'view') AS quota FROM events),
g AS (SELECT *, sum((NOT quota)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) AS n FROM g WHERE quota)
SELECT user_id, min(event_id) AS first_stop FROM n WHERE n >= 3 GROUP BY user_id""",
)
def quota_breaker(read):
    """Events stand in for attempts, errors and views for quota errors; three in a row stop."""
    e = read("events").withColumn("quota", F.col("event_type").isin("error", "view"))
    return state.quota_breaks(e, 3, "user_id", "event_id")


@query(
    "pending_items",
    """WITH c AS (SELECT user_id AS item_id, max((event_type = 'purchase')::INT) AS d, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY user_id)
SELECT DISTINCT user_id AS item_id FROM events WHERE user_id NOT IN (SELECT item_id FROM c WHERE d = 1 OR f >= 3)""",
)
def pending_items(read):
    e = read("events")
    c = e.select(F.col("user_id").alias("item_id"), F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("open").alias("status"))
    return state.pending(e.select(F.col("user_id").alias("item_id")).distinct(), c)


_WORDS = r"len(list_filter(regexp_split_to_array(coalesce(content, ''), '\s+'), lambda w: w <> '')) * 13 // 10"


@query(
    "chat_window",
    f"""WITH m AS (SELECT DISTINCT id, conversation_id, content FROM messages WHERE conversation_id IS NOT NULL),
r AS (SELECT id, conversation_id, sum({_WORDS}) OVER (PARTITION BY conversation_id ORDER BY id DESC, content) AS running FROM m)
SELECT conversation_id, id, running::BIGINT AS running FROM r WHERE running <= 200""",
)
def chat_window(read):
    m = read("messages").where("conversation_id is not null").select("id", "conversation_id", "content").distinct()
    return state.chat_window(m, 200).select("conversation_id", "id", F.col("running").cast("long").alias("running"))


@query(
    "conversation_list",
    """WITH f AS (SELECT conversation_id, trim(content) AS c FROM messages WHERE lower(trim(role)) IN ('user', 'human') AND trim(content) <> '' AND conversation_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY "timestamp" NULLS FIRST, id, content) = 1),
z AS (SELECT conversation_id, arg_min_null("timestamp", ("timestamp" IS NOT NULL, "timestamp", id)) AS created_at, max("timestamp") AS updated_at, count(*) AS n_messages FROM messages WHERE conversation_id IS NOT NULL GROUP BY conversation_id)
SELECT z.conversation_id, coalesce(CASE WHEN length(c) > 50 THEN substr(c, 1, 50) || '...' ELSE c END, 'New conversation') AS title, created_at, updated_at, n_messages FROM z LEFT JOIN f ON z.conversation_id = f.conversation_id""",
)
def conversation_list(read):
    return state.conversation_list(read("messages"))


@query("conversation_lines", "SELECT DISTINCT conversation_id, id, CASE WHEN lower(trim(role)) IN ('user', 'human') THEN '**User**' ELSE '**Assistant**' END || ': ' || coalesce(content, '') AS line FROM messages WHERE conversation_id IS NOT NULL AND role IS NOT NULL")
def conversation_lines(read):
    return state.export_lines(read("messages").where("conversation_id is not null and role is not null")).distinct()


@query("delete_conversations", "SELECT id FROM messages WHERE conversation_id NOT IN (SELECT conversation_id FROM messages WHERE content IS NULL AND conversation_id IS NOT NULL) OR conversation_id IS NULL")
def delete_conversations(read):
    m = read("messages")
    gone = m.where("content is null and conversation_id is not null").select("conversation_id").distinct()
    return state.delete_conversations(m.select("conversation_id").distinct(), m, gone)[1].select("id")


_T0 = "(SELECT doc_id::VARCHAR AS path, coalesce(n_chars, 0) AS size, 1.0::DOUBLE AS mtime, md5(coalesce(text, '')) AS content_hash FROM documents WHERE doc_id % 11 <> 0)"
_T1 = "(SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 10 = 1 THEN coalesce(n_chars, 0) + 1 ELSE coalesce(n_chars, 0) END AS size, 2.0::DOUBLE AS mtime, CASE WHEN doc_id % 10 = 1 THEN md5(coalesce(text, '') || '!') ELSE md5(coalesce(text, '')) END AS content_hash FROM documents WHERE doc_id % 10 <> 0)"


@query(
    "manifest_diff",
    f"""SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM {_T0} o FULL JOIN {_T1} n ON o.path = n.path
WHERE o.path IS NULL OR n.path IS NULL OR ((o.size <> n.size OR o.mtime <> n.mtime) AND o.content_hash <> n.content_hash)""",
)
def manifest_diff(read):
    """Two states of the collection: the first lacks some documents, the second lacks others and has changed some."""
    d = read("documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.coalesce("n_chars", F.lit(0)).alias("size"), F.coalesce("text", F.lit("")).alias("t"))
    old = d.where("doc_id % 11 <> 0").select("path", "size", F.lit(1.0).alias("mtime"), F.md5("t").alias("content_hash"))
    changed = F.col("doc_id") % 10 == 1
    new = d.where("doc_id % 10 <> 0").select("path", (F.col("size") + F.when(changed, 1).otherwise(0)).alias("size"), F.lit(2.0).alias("mtime"), F.md5(F.when(changed, F.concat("t", F.lit("!"))).otherwise(F.col("t"))).alias("content_hash"))
    return state.manifest_diff(old, new)


@query("files_by_extension", r"SELECT lower(regexp_extract(source, '\.([^./]+)$', 1)) AS extension, count(*) AS files FROM documents WHERE source IS NOT NULL GROUP BY ALL")
def files_by_extension(read):
    return files.count_by_extension(read("documents").where("source is not null").select(F.col("source").alias("path")))


@query("page_budget", """WITH p AS (SELECT document, page, min(chunk_text) AS text FROM extraction_results WHERE page IS NOT NULL AND chunk_text IS NOT NULL GROUP BY ALL HAVING length(min(chunk_text)) >= 100),
l AS (SELECT document, page, text, 2000 - coalesce(sum(length(text)) OVER (PARTITION BY document ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM p)
SELECT document, page, length(substr(text, 1, room::BIGINT)) AS n_chars FROM l WHERE room > 0""")
def page_budget(read):
    p = read("extraction_results").where("page is not null and chunk_text is not null").groupBy("document", "page").agg(F.min("chunk_text").alias("text"))
    return state.page_budget(p, 2000).select("document", "page", F.length("text").cast("long").alias("n_chars"))


@query("sample_per_folder")
def sample_per_folder(read):
    """The sample is by a hash that the oracle lacks; its shares are checked by pytest."""
    f = read("documents").where("source is not null").select(F.col("source").alias("path")).distinct()
    return state.sample_per_folder(f, 20)


@query("cited_pages", "SELECT document, min(rank) AS first, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages FROM (SELECT document, page, row_number() OVER (ORDER BY chunk_id, extracted_at, chunk_text) AS rank FROM extraction_results WHERE document IS NOT NULL) GROUP BY document")
def cited_pages(read):
    e = read("extraction_results").where("document is not null")
    ranked = e.withColumn("rank", F.row_number().over(state.Window.orderBy("chunk_id", "extracted_at", "chunk_text")))
    return files.pages_of(ranked).select("document", F.col("first").cast("long").alias("first"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("embeddings_with_parents", "SELECT c.vec_id, x.document, x.page FROM chunk_embeddings c JOIN (SELECT chunk_id, min(document) AS document, min(page) AS page FROM extraction_results GROUP BY chunk_id) x ON c.chunk_id = x.chunk_id")
def embeddings_with_parents(read):
    x = read("extraction_results").groupBy("chunk_id").agg(F.min("document").alias("document"), F.min("page").alias("page"))
    return read("chunk_embeddings").select("vec_id", "chunk_id").join(x, "chunk_id").select("vec_id", "document", "page")


# windows over events


def _events(read):
    return read("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS largest FROM events GROUP BY ALL")
def events_tumbling(read):
    t = jobs.tumbling(_events(read), "1 hour")
    return t.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("events_sliding", "SELECT b - INTERVAL (15 * k) MINUTE AS window_start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS b, event_type FROM events), generate_series(0, 3) g(k) GROUP BY ALL")
def events_sliding(read):
    return jobs.sliding(_events(read), "1 hour", "15 minutes").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "events_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
)
def events_session(read):
    s = jobs.sessions(_events(read), "30 minutes")
    return s.withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).withColumn("session_end", F.col("session_end").cast("timestamp_ntz"))
