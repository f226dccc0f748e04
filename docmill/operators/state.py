"""Metrics, caches, chat history, manifests, checkpoints: state as tables, changes as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.similarity import cosine
from docmill.functions.text import excerpt, token_count

STAGE_TIMES = ("rewrite_time_ms", "retrieval_time_ms", "rerank_time_ms", "llm_time_ms", "vector_time_ms", "graph_time_ms")
# Seconds that a tool's result stays valid; others two minutes.
TOOL_TTL = {"retrieve_vector": 300, "retrieve_graph": 300, "lookup_entity": 600, "compare_entities": 600, "database_stats": 300, "aggregate_graph": 600, "exhaustive_search": 300}
DEFAULT_TTL = 120


def _number(c: str) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def metrics_global(m: DataFrame) -> DataFrame:
    """One row: queries, mean latency, cache hits in per cent, mean agent steps."""
    hits, misses = F.sum("cache_hits"), F.sum("cache_misses")
    return m.agg(
        F.count("*").alias("total_queries"),
        F.round(F.coalesce(F.avg(_number("total_time_ms")), F.lit(0.0)), 1).alias("avg_latency_ms"),
        F.round(F.when(hits + misses > 0, 100.0 * hits / (hits + misses)).otherwise(0.0), 1).alias("cache_hit_rate"),
        F.round(F.coalesce(F.avg(F.col("agent_steps").cast("double")), F.lit(0.0)), 1).alias("avg_agent_steps"),
    )


def metrics_by(m: DataFrame, key: str) -> DataFrame:
    """(key, count, avg_latency_ms) of each value; nulls left out."""
    return m.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count"), F.round(F.avg(_number("total_time_ms")), 1).alias("avg_latency_ms"))


def timing_breakdown(m: DataFrame) -> DataFrame:
    """Mean of each stage's time by path, 0 where a path hasn't the stage."""
    return m.groupBy("path").agg(*[F.round(F.coalesce(F.avg(_number(c)), F.lit(0.0)), 1).alias(c) for c in STAGE_TIMES], F.count("*").alias("count"))


def exact_percentiles(df: DataFrame, value: Column, ps: tuple[float, ...], accuracy: int = 10_000) -> DataFrame:
    """(p, value): percentiles of a whole table, interpolated between neighbours, without sorting it.

    An approximate pass bounds each percentile; a second one counts what lies
    below the bounds and orders only the values between them.
    """
    x = df.select(value.cast("double").alias("x")).where("x is not null")
    spark, n = df.sparkSession, x.count()
    if not n:
        return spark.createDataFrame([(float(p), None) for p in ps], "p double, value double")
    slack = 4.0 / accuracy + 2.0 / n
    at = [min(1.0, max(0.0, p + d)) for p in ps for d in (-slack, slack)]
    bounds = x.agg(F.percentile_approx("x", F.array(*[F.lit(a) for a in at]), F.lit(accuracy)).alias("b")).first()  # one row
    wanted = [(float(p), float(lo), float(hi), int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1), p * (n - 1) - int(p * (n - 1))) for p, lo, hi in zip(ps, bounds["b"][::2], bounds["b"][1::2])]
    asked = F.broadcast(spark.createDataFrame(wanted, "p double, lo double, hi double, r0 long, r1 long, w double"))  # one row a percentile
    placed = x.join(asked, F.col("x") <= F.col("hi"))
    per = placed.groupBy("p", "r0", "r1", "w", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("x")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("p").orderBy(F.col("x").asc_nulls_first()))
    ranked = per.withColumn("upto", upto)
    pick = lambda r: F.max(F.when((F.col("upto") > F.col(r)) & (F.col("upto") - F.col("n") <= F.col(r)), F.col("x")))
    got = ranked.groupBy("p", "w").agg(pick("r0").alias("a"), pick("r1").alias("b"))
    return got.select("p", (F.col("a") + F.col("w") * (F.coalesce("b", "a") - F.col("a"))).alias("value"))


def latency_percentiles(m: DataFrame) -> DataFrame:
    """Exact 50th, 95th and 99th percentiles, interpolated."""
    p = exact_percentiles(m, _number("total_time_ms"), (0.5, 0.95, 0.99))
    return p.agg(*[F.round(F.max(F.when(F.col("p") == q, F.col("value"))), 1).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])


def latest(m: DataFrame, n: int, time: str = "timestamp", tie: str = "id") -> DataFrame:
    """The last ``n`` rows, oldest first."""
    return m.where(F.col(time).isNotNull()).orderBy(F.desc(time), F.desc(tie)).limit(n).orderBy(time, tie)


def cache_statistics(cache: DataFrame, now: float) -> DataFrame:
    """(tool, total, valid): entries of each tool, and those younger than its time to live."""
    return cache.groupBy("tool").agg(F.count("*").alias("total"), F.count_if(F.lit(now) - F.col("created_at") < ttl_of(F.col("tool"))).alias("valid"))


def ttl_of(tool: Column) -> Column:
    out = F.lit(DEFAULT_TTL)
    for name, ttl in TOOL_TTL.items():
        out = F.when(tool == name, ttl).otherwise(out)
    return out


def valid_entries(cache: DataFrame, now: float, ttl: Column) -> DataFrame:
    return cache.where(F.lit(now) - F.col("created_at") < ttl)


def evict(cache: DataFrame, most: int, time: str = "created_at", key: str = "key") -> DataFrame:
    """The ``most`` newest entries."""
    return cache.orderBy(F.desc(time), key).limit(most)


def older_than(rows: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    return rows.where(F.col(time) >= now - F.expr(f"INTERVAL {days} DAYS"))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0)


def semantic_match(queries: DataFrame, cache: DataFrame, now: float, ttl: float = 300, least: float = 0.92) -> DataFrame:
    """(query_id, key, similarity): the most similar valid entry with the same parameters, from ``least`` on.

    ``queries(query_id, params, qvec)``, ``cache(key, params, vec, created_at)``.
    """
    fresh = valid_entries(cache, now, F.lit(ttl))
    s = queries.join(fresh, "params").withColumn("similarity", cosine(F.col("qvec"), F.col("vec"))).where(F.col("similarity") >= least)
    best = s.groupBy("query_id").agg(F.min(F.struct((-F.col("similarity")).alias("n"), "key")).alias("b"))
    return best.select("query_id", F.col("b.key").alias("key"), (-F.col("b.n")).alias("similarity"))


def chat_window(messages: DataFrame, most_tokens: int, conversation: str = "conversation_id", order: str = "id", text: str = "content") -> DataFrame:
    """The newest messages of each conversation whose tokens add up to ``most_tokens`` at most; stops at the first that doesn't fit."""
    m = messages.withColumn("tokens", F.coalesce(token_count(F.col(text)), F.lit(0)))
    w = Window.partitionBy(conversation).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return m.withColumn("running", F.sum("tokens").over(w)).where(F.col("running") <= most_tokens)


def conversation_list(messages: DataFrame) -> DataFrame:
    """(conversation_id, title, created_at, updated_at, n_messages): title from the first user message, 50 characters."""
    order = F.struct(F.col("timestamp"), F.col("id"))
    is_user = F.lower(F.trim("role")).isin("user", "human") & (F.trim("content") != "")
    return messages.where("conversation_id is not null").groupBy("conversation_id").agg(
        F.min(F.when(is_user, F.struct("timestamp", "id", "content"))).alias("f"), F.min(order).alias("a"), F.max(order).alias("z"), F.count("*").alias("n_messages")
    ).select("conversation_id", F.coalesce(excerpt(F.trim("f.content"), 50), F.lit("New conversation")).alias("title"), F.col("a.timestamp").alias("created_at"), F.col("z.timestamp").alias("updated_at"), "n_messages")


def delete_conversations(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations of ``gone(conversation_id)``."""
    return conversations.join(gone, "conversation_id", "left_anti"), messages.join(gone, "conversation_id", "left_anti")


def export_lines(messages: DataFrame) -> DataFrame:
    """(conversation_id, id, line): messages as Markdown, one row each, to be written in order of (conversation_id, id)."""
    who = F.when(F.lower(F.trim("role")).isin("user", "human"), "**User**").otherwise("**Assistant**")
    return messages.select("conversation_id", "id", F.concat(who, F.lit(": "), F.coalesce("content", F.lit(""))).alias("line"))


def manifest_diff(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, change): new, modified or deleted files against a manifest(path, size, mtime, content_hash).

    A file is modified if its size or time differs and its content does.
    """
    old = manifest.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("content_hash").alias("_h"))
    both = files.join(old, "path", "full")
    is_new, is_gone = F.col("_h").isNull(), F.col("content_hash").isNull()
    differs = ((F.col("size") != F.col("_s")) | (F.col("mtime") != F.col("_m"))) & (F.col("content_hash") != F.col("_h"))
    change = F.when(is_new, "new").when(is_gone, "deleted").when(differs, "modified")
    return both.withColumn("change", change).where("change is not null").select("path", "change")


def apply_manifest(manifest: DataFrame, files: DataFrame, changes: DataFrame) -> DataFrame:
    """The manifest after ingestion."""
    kept = manifest.join(changes.select("path"), "path", "left_anti")
    return kept.unionByName(files.select(*manifest.columns).join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi"))


def pending(items: DataFrame, checkpoint: DataFrame, most_attempts: int = 3) -> DataFrame:
    """Items (item_id, …) that aren't done and haven't failed for good."""
    done = checkpoint.groupBy("item_id").agg(F.max((F.col("status") == "done").cast("int")).alias("d"), F.count_if(F.col("status") == "failed").alias("f"))
    return items.join(done.where((F.col("d") == 1) | (F.col("f") >= most_attempts)).select("item_id"), "item_id", "left_anti")


def quota_breaks(attempts: DataFrame, limit: int = 5, by: str = "stage", order: str = "attempt") -> DataFrame:
    """(``by``, first_stop): the first attempt at which ``limit`` quota errors in a row were reached.

    ``attempts(by, order, ok, quota)``; a success ends the row, another error too.
    """
    w = Window.partitionBy(by).orderBy(order)
    streaks = attempts.withColumn("g", F.sum((~F.col("quota")).cast("int")).over(w))
    run = streaks.where("quota").withColumn("n", F.row_number().over(Window.partitionBy(by, "g").orderBy(order)))
    return run.where(F.col("n") >= limit).groupBy(by).agg(F.min(order).alias("first_stop"))


def reusable_vectors(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (chunk_id, text) whose vector is known by content, and those still to be embedded."""
    c = chunks.withColumn("content_hash", F.sha2("text", 256))
    one = cache.groupBy("content_hash").agg(F.min_by("vec", "created_at").alias("vec"))
    joined = c.join(one, "content_hash", "left")
    return joined.where("vec is not null"), joined.where("vec is null").drop("vec")


def sample_per_folder(files: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` files, spread over folders: an equal share of each by seeded hash, the rest by hash from all."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    f = files.withColumn("folder", folder).withColumn("h", F.xxhash64("path", F.lit(seed)))
    n = f.agg(F.count_distinct("folder")).scalar()
    nth = F.row_number().over(Window.partitionBy("folder").orderBy("h", "path"))
    ranked = f.withColumn("nth", nth).withColumn("share", F.ceil(F.lit(most) / n))
    first = (F.col("nth") > F.col("share")).cast("int")
    return ranked.orderBy(first, "h", "path").limit(most).select(*files.columns)


def page_budget(pages: DataFrame, most_chars: int, least_chars: int = 100) -> DataFrame:
    """Pages (document, page, text) up to a number of characters per document, the last cut; short pages skipped."""
    p = pages.where(F.length("text") >= least_chars)
    before = F.sum(F.length("text")).over(Window.partitionBy("document").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    left = F.lit(most_chars) - F.coalesce(before, F.lit(0))
    return p.withColumn("left", left).where("left > 0").withColumn("text", F.expr("substring(text, 1, left)")).drop("left")
