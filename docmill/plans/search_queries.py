"""Queries of the ranking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.operators import chunking, search
from docmill.plans.registry import query
from docmill.plans.text_queries import WORDS
from docmill.scratch import stage

ASKED = "retrieval pipeline access log database"
_TOKENS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"


def _index_sql(docs: str = "SELECT doc_id, coalesce(text, '') AS text FROM documents") -> str:
    return f"""d AS ({docs}),
t AS (SELECT doc_id, {_TOKENS.format(c='text')} AS w FROM d),
l AS (SELECT doc_id, len(w) AS len FROM t),
p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
n AS (SELECT count(*) AS n, avg(len) AS avgdl FROM l)"""


def _scores_sql(queries: str) -> str:
    return f"""q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOKENS.format(c='query')}) AS term FROM ({queries})) GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score
      FROM q JOIN p USING (term) JOIN df USING (term) JOIN l USING (doc_id), n GROUP BY ALL HAVING sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf) > 0)"""


_BENCH = "SELECT query_id, query FROM benchmark_queries WHERE query IS NOT NULL"


def _top(k: int, by: str = "query_id", source: str = "s") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id) AS rank FROM {source} QUALIFY rank <= {k})"


def _scored(read, docs=None):
    q = read("benchmark_queries").where("query is not null").select("query_id", "query")
    return search.bm25(search.build_index(docs if docs is not None else read("documents")), q).withColumn("score", F.round("score", 6))


def _best(read, k, docs=None, among=None):
    """The ``k`` best documents of each benchmark query are among these; with ``among``, of each group."""
    q = read("benchmark_queries").where("query is not null").select("query_id", "query")
    return search.bm25_best(search.build_index(docs if docs is not None else read("documents")), q, k, among)


@query(
    "exhaustive_search",
    f"""WITH {_index_sql()}, {_scores_sql(f"SELECT 0 AS query_id, '{ASKED}' AS query")},
r AS (SELECT source, s.score, substr(documents.text, 1, 200) AS excerpt, row_number() OVER (PARTITION BY source ORDER BY s.score DESC, doc_id) AS rank FROM s JOIN documents USING (doc_id))
SELECT source, count(*) AS hits, max(score) AS best_score, array_to_string(list(excerpt ORDER BY rank) FILTER (rank <= 10), '|') AS excerpts FROM r GROUP BY source""",
)
def exhaustive_search(read):
    """Ties of excerpts at equal scores are broken by document."""
    return search.exhaustive(read("documents"), ASKED).withColumn("excerpts", F.array_join("excerpts", "|"))


@query("bm25_topk", f"WITH {_index_sql()}, {_scores_sql(_BENCH)} SELECT query_id, doc_id, score, rank FROM {_top(10)}")
def bm25_topk(read):
    return search.top_k(_best(read, 10), 10, ["query_id"])


@query("keyword_fallback", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'irrigation') OR contains(lower(text), 'canal')")
def keyword_fallback(read):
    return search.keyword_search(read("documents"), "irrigation canal").select("doc_id", "score")


_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_DENSE = f"""(SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) QUALIFY rank <= {{k}})"""


def _dense(read, k, least=None):
    e = read("embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return search.dense_join(q, v, k, least).withColumnRenamed("id", "doc_id")


@query("dense_topk", f"SELECT query_id, doc_id, score, rank FROM {_DENSE.format(k=10)}")
def dense_topk(read):
    """The query set is every vector whose id is divisible by 20, against all vectors."""
    return _dense(read, 10)


@query(
    "similar_entities",
    f"SELECT query_id, doc_id, score, rank FROM {_DENSE.format(k=6)} WHERE score >= 0.3",
)
def similar_entities(read):
    return _dense(read, 6, 0.3)


_TF = f"""w AS (SELECT query_id, doc_id, sum(times * tf)::DOUBLE AS score FROM q JOIN p USING (term) GROUP BY ALL)"""


@query(
    "rrf_fusion",
    f"""WITH {_index_sql()}, {_scores_sql(_BENCH)}, {_TF},
f AS (SELECT query_id, doc_id, sum(part) AS score FROM (
  SELECT query_id, doc_id, 0.6 / (60 + rank) AS part FROM {_top(20)} UNION ALL SELECT query_id, doc_id, 0.4 / (60 + rank) FROM {_top(20, source='w')}) GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score FROM f""",
)
def rrf_fusion(read):
    docs = read("documents")
    index = search.build_index(docs)
    q = read("benchmark_queries").where("query is not null").select("query_id", "query")
    a = search.top_k(search.bm25_best(index, q, 20), 20, ["query_id"])
    b = search.top_k(search.term_counts_best(index, q, 20), 20, ["query_id"])
    return search.rrf([(a, 0.6), (b, 0.4)], "doc_id", ["query_id"]).withColumn("score", F.round("score", 6))


@query(
    "multi_index_search",
    f"""WITH {_index_sql()}, {_scores_sql(_BENCH)},
k AS (SELECT query_id, doc_id, kind, round(s.score * CASE kind WHEN 'Table' THEN 0.9 WHEN 'Image' THEN 0.8 ELSE 1.0 END, 6) AS score,
      row_number() OVER (PARTITION BY query_id, kind ORDER BY s.score DESC, doc_id) AS r FROM s JOIN documents USING (doc_id) QUALIFY r <= 10)
SELECT query_id, doc_id, kind, score, rank FROM {_top(10, source='k')}""",
)
def multi_index_search(read):
    """Each content type's ten best, weighted by type, then the ten best of all; what has no type counts as a text of its own list."""
    d = read("documents").select("doc_id", "kind")
    s = stage(_best(read, 10, among=d.withColumnRenamed("kind", "group")).join(d, "doc_id"), "scored")
    kinds = [r[0] for r in s.select("kind").distinct().collect()]  # one row a content type
    lists = {k or "": search.top_k(s.where(F.col("kind").eqNullSafe(F.lit(k))), 10, ["query_id"]).drop("rank") for k in kinds}
    best = search.multi_index(lists, {"Table": 0.9, "Image": 0.8}, 10, "doc_id", ["query_id"])
    return best.select("query_id", "doc_id", F.nullif("content_type", F.lit("")).alias("kind"), "score", "rank")


_CHILDREN = f"""c0 AS (SELECT doc_id AS parent, {WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL),
c1 AS (SELECT parent, w, unnest(generate_series(0, ceil(greatest(len(w) - 80, 0) / 64)::INT)) AS i FROM c0 WHERE len(w) > 0)"""


@query(
    "parent_expand",
    f"""WITH {_CHILDREN}, {_index_sql("SELECT parent || ':' || i AS doc_id, array_to_string(w[i * 64 + 1 : i * 64 + 80], ' ') AS text FROM c1")}, {_scores_sql(_BENCH)},
x AS (SELECT query_id, split_part(doc_id, ':', 1)::BIGINT AS parent_id, score, rank FROM {_top(10)})
SELECT query_id, parent_id, min(rank) AS rank, arg_min(score, rank) AS score FROM x GROUP BY ALL""",
)
def parent_expand(read):
    d = read("documents").where("text is not null")
    child = d.select(F.col("doc_id").alias("parent"), F.posexplode(chunking.windows(F.col("text"), 80, 16)).alias("i", "text"))
    child = child.select(F.concat_ws(":", "parent", "i").alias("doc_id"), "text")
    top = search.top_k(_best(read, 10, child), 10, ["query_id"]).withColumn("parent_id", F.substring_index("doc_id", ":", 1).cast("long"))
    parents = d.select(F.col("doc_id").alias("parent_id"))
    return search.parent_expand(top, parents, by=["query_id"]).select("query_id", "parent_id", "rank", "score")


_FIELDS = ("source", "kind", "page", "lang", "n_chars")
_RULES = [("kind", "eq", "Text"), ("page", "gte", 10), ("source", "contains", "REPORTS"), ("lang", "ne", "fr"), ("n_chars", "lt", 2000)]
_RULES_SQL = ("coalesce(kind = 'Text', false)", "coalesce(page >= 10, false)", "coalesce(contains(lower(source), 'reports'), false)", "coalesce(lang <> 'fr', false)", "coalesce(n_chars < 2000, false)")


@query("metadata_filter_all", "SELECT doc_id FROM documents WHERE " + " AND ".join(_RULES_SQL))
def metadata_filter_all(read):
    return read("documents").where(search.metadata_filter({f: F.col(f) for f in _FIELDS}, _RULES)).select("doc_id")


@query("metadata_filter_any", "SELECT doc_id FROM documents WHERE " + " OR ".join(_RULES_SQL[2:4]))
def metadata_filter_any(read):
    return read("documents").where(search.metadata_filter({f: F.col(f) for f in _FIELDS}, _RULES[2:4], match_all=False)).select("doc_id")


@query("filter_or_keep", "SELECT doc_id, CASE WHEN lang = 'it' THEN 0.5::DOUBLE ELSE n_chars::DOUBLE END AS score FROM documents WHERE coalesce(lang = 'it', false) OR NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'it')")
def filter_or_keep(read):
    d = read("documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return search.filter_or_keep(d, F.coalesce(F.col("lang") == "it", F.lit(False))).select("doc_id", "score")


@query("metadata_lookup", "SELECT doc_id FROM documents WHERE page::VARCHAR = '7'")
def metadata_lookup(read):
    return read("documents").where(F.col("page").cast("string") == "7").select("doc_id")


@query(
    "lost_in_middle",
    f"""WITH {_index_sql()}, {_scores_sql(_BENCH)}, r AS (SELECT *, rank - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM {_top(7)})
SELECT query_id, doc_id, (CASE WHEN n <= 2 THEN i + 1 WHEN i % 2 = 0 THEN i // 2 + 1 ELSE n - (i - 1) // 2 END)::INT AS place FROM r""",
)
def lost_in_middle(read):
    top = search.top_k(_best(read, 7), 7, ["query_id"])
    return search.lost_in_middle(top, "rank", ["query_id"]).select("query_id", "doc_id", "place")


@query(
    "fusion_caps",
    """SELECT id, greatest(1, round_even(coalesce(cache_hits, 0) * complexity_score, 0)::INT) AS n_vector,
  round(least(1.0, complexity_score * 0.6 + (1 - complexity_score) * 0.4 + 0.2 * least(coalesce(cache_misses, 0) / 5.0, 1.0)), 6)::DOUBLE AS confidence
FROM (SELECT DISTINCT id, cache_hits, cache_misses, complexity_score FROM query_metrics) WHERE complexity_score IS NOT NULL""",
)
def fusion_caps(read):
    """Sizes of the arms and confidence of the answer, with the columns of the metrics as stand-ins for an answer's figures."""
    m = read("query_metrics").select("id", "cache_hits", "cache_misses", "complexity_score").distinct().where("complexity_score is not null")
    c = search.answer_confidence(F.col("complexity_score"), 1 - F.col("complexity_score"), F.lit(0.6), F.lit(0.4), F.coalesce("cache_misses", F.lit(0)))
    return m.select("id", search.arm_sizes(F.coalesce("cache_hits", F.lit(0)), F.col("complexity_score")).alias("n_vector"), F.round(c, 6).alias("confidence"))


@query(
    "retrieval_quality",
    f"""WITH {_index_sql()}, {_scores_sql(_BENCH)},
k AS (SELECT query_id, unnest(expected_keywords) AS kw FROM benchmark_queries),
rel AS (SELECT DISTINCT query_id, doc_id FROM k JOIN documents ON contains(lower(text), lower(kw)) WHERE kw <> ''),
h AS (SELECT t.query_id, t.rank, rel.doc_id IS NOT NULL AS ok FROM {_top(10)} t LEFT JOIN rel ON t.query_id = rel.query_id AND t.doc_id = rel.doc_id)
SELECT query_id, count(*) FILTER (ok) / 10.0 AS precision, round(coalesce(1.0 / min(rank) FILTER (ok), 0.0), 6)::DOUBLE AS reciprocal_rank FROM h GROUP BY query_id""",
)
def retrieval_quality(read):
    """Relevant are documents that hold one of the expected keywords; only retrieved ones are looked at."""
    top = search.top_k(_best(read, 10), 10, ["query_id"])
    kw = read("benchmark_queries").select("query_id", F.explode("expected_keywords").alias("kw")).where("kw <> ''")
    seen = top.select("query_id", "doc_id").join(read("documents").select("doc_id", F.lower("text").alias("t")), "doc_id")
    rel = seen.join(kw, "query_id").where(F.col("t").contains(F.lower("kw"))).select("query_id", "doc_id")
    q = search.retrieval_quality(top, rel, 10)
    return q.select("query_id", "precision", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(
    "keyword_hit_rate",
    f"""WITH {_index_sql()}, {_scores_sql(_BENCH)},
x AS (SELECT t.query_id, string_agg(lower(documents.text), ' ') AS txt FROM {_top(5)} t JOIN documents USING (doc_id) GROUP BY t.query_id),
k AS (SELECT query_id, unnest(expected_keywords) AS kw FROM benchmark_queries)
SELECT query_id, round(avg(CASE WHEN contains(txt, lower(kw)) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM k JOIN x USING (query_id) WHERE kw IS NOT NULL GROUP BY query_id""",
)
def keyword_hit_rate(read):
    top = search.top_k(_best(read, 5), 5, ["query_id"]).join(read("documents").select("doc_id", F.lower("text").alias("t")), "doc_id")
    kw = read("benchmark_queries").select("query_id", F.explode("expected_keywords").alias("kw")).where("kw is not null").withColumn("n", F.monotonically_increasing_id())
    hit = top.select("query_id", "t").join(kw, "query_id").groupBy("query_id", "n").agg(F.max(F.col("t").contains(F.lower("kw")).cast("int")).alias("hit"))
    return hit.groupBy("query_id").agg(F.round(F.avg("hit"), 6).alias("hit_rate"))


@query("reranked_yes_no", f"""WITH {_index_sql()}, {_scores_sql(_BENCH)},
j AS (SELECT t.query_id, t.doc_id, t.rank AS old, CASE WHEN contains(lower(documents.text), 'yes') THEN 1.0::DOUBLE WHEN contains(lower(documents.text), 'no') THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM {_top(10)} t JOIN documents USING (doc_id))
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM j QUALIFY rank <= 5""")
def reranked_yes_no(read):
    """The document's own words stand in for a judge's answer."""
    top = search.top_k(_best(read, 10), 10, ["query_id"]).drop("score").join(read("documents").select("doc_id", "text"), "doc_id")
    return search.rerank(top, F.col("text"), ["query_id"], 5).select("query_id", "doc_id", "score", "rank")


@query("compressed_context", f"SELECT doc_id, CASE WHEN length(text) // 4 < 256 THEN text ELSE array_to_string({WORDS.format(c='text')}[1:200], ' ') END AS text FROM documents WHERE text IS NOT NULL")
def compressed_context(read):
    return read("documents").where("text is not null").select("doc_id", search.compress(F.col("text"), F.lit("")).alias("text"))


@query("contexts_once")
def contexts_once(read):
    """Matching blocks of two texts aren't in SQL; checked by pytest."""
    top = search.top_k(_best(read, 5), 5, ["query_id"]).join(read("documents").select("doc_id", "text"), "doc_id")
    return search.without_near_repeats(top.select("query_id", "rank", "doc_id", "text"), "query_id", "rank", "text").select("query_id", "rank", "doc_id")


@query("filtered_topk", f"WITH {_index_sql()}, {_scores_sql(_BENCH)}, f AS (SELECT s.* FROM s JOIN documents USING (doc_id) WHERE contains(lower(source), 'reports')) SELECT query_id, doc_id, score, rank FROM {_top(3, source='f')}")
def filtered_topk(read):
    d = read("documents").select("doc_id", "source")
    reports = d.where(F.lower("source").contains("reports")).select("doc_id", F.lit("").alias("group"))
    s = _best(read, 3, among=reports).join(d, "doc_id")
    return search.filtered_top_k(s, F.lower("source").contains("reports"), 3, ["query_id"]).select("query_id", "doc_id", "score", "rank")
