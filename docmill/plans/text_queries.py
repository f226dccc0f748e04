"""Queries of the text, chunking and routing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import routing, text
from docmill.operators import chunking
from docmill.plans.registry import any_match, lit, query

WORDS = r"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"


@query("tokens", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n_tokens FROM documents WHERE text IS NOT NULL")
def tokens(read):
    return read("documents").where("text is not null").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query("token_count", f"SELECT doc_id, len({WORDS.format(c='text')}) * 13 // 10 AS n_tokens FROM documents WHERE text IS NOT NULL")
def token_count(read):
    return read("documents").where("text is not null").select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _strip(c: str) -> str:
    return _STRIP.format(c=c)


_UNFENCE = f"""
  s0 AS (SELECT doc_id, {_strip('text')} AS t FROM documents WHERE text IS NOT NULL),
  s1 AS (SELECT doc_id, CASE WHEN starts_with(t, '```markdown') THEN {_strip('substr(t, 12)')} ELSE t END AS t FROM s0),
  s2 AS (SELECT doc_id, CASE WHEN starts_with(t, '```') THEN {_strip('substr(t, 4)')} ELSE t END AS t FROM s1),
  s3 AS (SELECT doc_id, CASE WHEN ends_with(t, '```') THEN {_strip("left(t, length(t) - 3)")} ELSE t END AS t FROM s2)"""
_UNMARK = "t"
for _m in text.MARKERS:
    _UNMARK = f"replace({_UNMARK}, {lit(_m)}, '')"


@query("clean_text", f"WITH {_UNFENCE} SELECT doc_id, md5({_strip(f'''regexp_replace({_UNMARK}, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')''')}) AS h FROM s3")
def clean_text(read):
    return read("documents").where("text is not null").select("doc_id", F.md5(text.clean_extracted_text(F.col("text"))).alias("h"))


@query("clean_table", f"WITH {_UNFENCE} SELECT doc_id, md5({_strip('''regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g')''')}) AS h FROM s3")
def clean_table(read):
    return read("documents").where("text is not null").select("doc_id", F.md5(text.clean_table_output(F.col("text"))).alias("h"))


@query("markdown_tables", f"SELECT doc_id, len(regexp_extract_all(text, {lit(text.TABLE)})) AS n_tables, md5(regexp_replace(text, {lit(text.TABLE)}, '', 'g')) AS rest FROM documents WHERE text IS NOT NULL")
def markdown_tables(read):
    c = F.col("text")
    return read("documents").where("text is not null").select("doc_id", F.size(text.markdown_tables(c)).alias("n_tables"), F.md5(text.remove_tables(c)).alias("rest"))


_NO_CODE = r"regexp_replace(text, '(?s)```.*?```', '', 'g')"


@query("clean_up_text", f"SELECT doc_id, md5(regexp_replace({_NO_CODE}, {lit(text.TABLE)}, '', 'g')) AS h, md5(regexp_replace(text, '(?s)```EXTRACTED TEXT.*?```', '', 'g')) AS named FROM documents WHERE text IS NOT NULL")
def clean_up_text(read):
    c = F.col("text")
    return read("documents").where("text is not null").select("doc_id", F.md5(text.clean_up(c)).alias("h"), F.md5(text.remove_named_blocks(c, "EXTRACTED TEXT")).alias("named"))


@query("plain_text")
def plain_text(read):
    """Markdown to text; its emphasis rules need back references, which the oracle's patterns lack."""
    return read("documents").where("text is not null").select("doc_id", F.length(text.markdown_to_plain(F.col("text"))).alias("n_chars"))


@query("normalize_query", f"SELECT query_id, regexp_replace(regexp_replace(lower({_strip('query')}), '\\s+', ' ', 'g'), '[?.!,;:]+$', '') AS q FROM benchmark_queries")
def normalize_query(read):
    return read("benchmark_queries").select("query_id", text.normalize_query(F.col("query")).alias("q"))


def _language_sql() -> str:
    n = {}
    for lang, parts in routing.INDICATORS.items():
        total = " + ".join(f"contains(q, {lit(p)})::INT" for p in parts)
        asked = " OR ".join(f"contains(q, {lit(p)})" for p in routing.INDICATOR_QUESTIONS[lang])
        n[lang] = f"({total} + CASE WHEN {asked} THEN 2 ELSE 0 END)"
    return f"""
WITH b AS (SELECT query_id, lower(query) AS q FROM benchmark_queries),
n AS (SELECT query_id, {n['es']} AS es, {n['de']} AS de, {n['fr']} AS fr FROM b)
SELECT query_id, CASE WHEN greatest(es, de, fr) < 2 THEN 'en' WHEN es = greatest(es, de, fr) THEN 'es' WHEN de = greatest(es, de, fr) THEN 'de' ELSE 'fr' END AS lang FROM n"""


@query("detect_language", _language_sql())
def detect_language(read):
    return read("benchmark_queries").where("query is not null").select("query_id", routing.language_of_query(F.col("query")).alias("lang"))


@query("generic_names", f"SELECT doc_id, {any_match('''lower(regexp_replace(regexp_extract(source, '([^/]*)/?$', 1), '(.)\\.[^.]*$', '\\1'))''', text.GENERIC_NAMES)} AS generic FROM documents WHERE source IS NOT NULL")
def generic_names(read):
    return read("documents").where("source is not null").select("doc_id", text.is_generic_name(F.col("source")).alias("generic"))


@query("query_keys", "SELECT doc_id, md5(text) AS m, sha256(text) AS s, substr(md5(text), 1, 16) AS short FROM documents WHERE text IS NOT NULL")
def query_keys(read):
    c = F.col("text")
    return read("documents").where("text is not null").select("doc_id", F.md5(c).alias("m"), F.sha2(c, 256).alias("s"), F.substring(F.md5(c), 1, 16).alias("short"))


@query(
    "chunk_metadata",
    """SELECT DISTINCT chunk_id AS child,
  CASE WHEN contains(chunk_id, '_child_chunk_') THEN split_part(chunk_id, '_child_chunk_', 1) || '.txt' WHEN contains(chunk_id, '_description_') THEN split_part(chunk_id, '_chunk_', 1) || '.txt'
       WHEN contains(chunk_id, '_Table_') THEN split_part(chunk_id, '_chunk_', 1) || '.md' END AS parent,
  CASE WHEN contains(chunk_id, '_page_') THEN replace(split_part(chunk_id, '_page_', 1), '__', '/') END AS document,
  CASE WHEN contains(chunk_id, '_page_') THEN regexp_extract(chunk_id, '_page_([^_]*)', 1) END AS page
FROM extraction_results""",
)
def chunk_metadata(read):
    return read("extraction_results").select(text.chunk_metadata(F.col("chunk_id")).alias("m")).select("m.*").distinct()


@query(
    "page_ranges",
    """WITH p AS (SELECT document, list_sort(list_distinct(list(page))) AS p FROM extraction_results WHERE page IS NOT NULL GROUP BY document)
SELECT document, CASE WHEN len(p) = 1 THEN 'p. ' || p[1] WHEN p[-1] - p[1] + 1 = len(p) THEN 'pp. ' || p[1] || '-' || p[-1]
  ELSE 'pp. ' || array_to_string(p[1:3], ', ') || CASE WHEN len(p) > 3 THEN '...' ELSE '' END END AS pages FROM p""",
)
def page_ranges(read):
    e = read("extraction_results").where("page is not null").groupBy("document").agg(F.collect_set("page").alias("p"))
    return e.select("document", text.page_range(F.col("p")).alias("pages"))


def _any_text(xs) -> str:
    return any_match("lower(content)", xs)


@query(
    "error_types",
    f"""SELECT id, CASE WHEN {_any_text(text.QUOTA)} THEN 'QUOTA_EXHAUSTED' WHEN {_any_text(text.RATE)} THEN 'RATE_LIMITED' WHEN {_any_text(text.TRANSIENT)} THEN 'TRANSIENT' ELSE 'PERMANENT' END AS error
FROM messages WHERE content IS NOT NULL""",
)
def error_types(read):
    return read("messages").where("content is not null").select("id", text.error_type(F.col("content")).alias("error"))


@query(
    "word_overlap",
    f"""WITH w AS (SELECT id, list_distinct({WORDS.format(c='lower(name)')}) AS a, list_distinct({WORDS.format(c='lower(description)')}) AS b FROM graph_nodes WHERE name IS NOT NULL AND description IS NOT NULL)
SELECT id, CASE WHEN least(len(a), len(b)) > 0 THEN round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) ELSE 0.0 END AS overlap FROM w""",
)
def word_overlap(read):
    n = read("graph_nodes").where("name is not null and description is not null")
    return n.select("id", F.round(text.word_overlap(F.col("name"), F.col("description")), 6).alias("overlap"))


@query(
    "bullet_items",
    f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: starts_with(x, '- ') OR starts_with(x, '* ')) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(b) AS n, array_to_string(list_transform(b, lambda x: {_strip('substr(x, 3)')}), '|') AS items FROM l WHERE len(b) > 0""",
)
def bullet_items(read):
    d = read("documents").where("text is not null").select("doc_id", text.bullets(F.col("text")).alias("b")).where(F.size("b") > 0)
    return d.select("doc_id", F.size("b").alias("n"), F.array_join("b", "|").alias("items"))


@query("fenced_json", "SELECT doc_id, md5(CASE WHEN regexp_matches(text, '(?s)```json.*?```') THEN regexp_extract(text, '(?s)```json(.*?)```', 1) ELSE text END) AS h FROM documents WHERE text IS NOT NULL")
def fenced_json(read):
    return read("documents").where("text is not null").select("doc_id", F.md5(text.fenced_json(F.col("text"))).alias("h"))


@query("recovered_json")
def recovered_json(read):
    """Parsing and printing JSON again differs between engines in spacing; checked by pytest."""
    d = read("documents").where("text is not null")
    return d.select("doc_id", F.length(text.recover_json(F.col("text"))).alias("n_chars"))


@query("api_sources", "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS excerpt FROM documents")
def api_sources(read):
    return read("documents").select("doc_id", text.excerpt(F.col("text"), 500).alias("excerpt"))


@query("chunk_kinds", "SELECT DISTINCT chunk_id, contains(chunk_id, '_parent_chunk_') AND NOT contains(chunk_id, '_child_chunk_') AS is_parent_only, contains(chunk_id, '_child_chunk_') AS is_child, contains(chunk_id, '_description_') AS is_description, contains(chunk_id, '_Table_') AS is_table, split_part(chunk_id, '_page_', 1) AS stem FROM extraction_results WHERE chunk_id IS NOT NULL")
def chunk_kinds(read):
    e = read("extraction_results").where("chunk_id is not null").select("chunk_id").distinct()
    return e.select("chunk_id", text.chunk_kind(F.col("chunk_id")).alias("k"), text.stem_of(F.col("chunk_id")).alias("stem")).select("chunk_id", "k.*", "stem")


@query("entity_texts", f"SELECT id, CASE WHEN coalesce({_strip('description')}, '') = '' THEN name ELSE name || ': ' || description END AS t FROM graph_nodes")
def entity_texts(read):
    return read("graph_nodes").select("id", text.entity_text(F.col("name"), F.col("description")).alias("t"))


# chunking


def _window_sql(size: int, overlap: int) -> str:
    stride = size - overlap
    return f"""
WITH w AS (SELECT doc_id, {WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, w, unnest(generate_series(0, ceil(greatest(len(w) - {size}, 0) / {stride})::INT)) AS chunk FROM w WHERE len(w) > 0)
SELECT doc_id, chunk::INT AS chunk, array_to_string(w[chunk * {stride} + 1 : chunk * {stride} + {size}], ' ') AS text FROM i"""


@query("overlap_chunks", _window_sql(100, 20))
def overlap_chunks(read):
    d = read("documents").where("text is not null")
    return d.select("doc_id", F.posexplode(chunking.windows(F.col("text"), 100, 20)).alias("chunk", "text"))


@query("hard_split", _window_sql(chunking.words_within(64), 6))
def hard_split(read):
    d = read("documents").where("text is not null")
    return d.select("doc_id", F.posexplode(chunking.hard_split(F.col("text"), 64)).alias("chunk", "text"))


_PARTS = f"list_filter(list_transform(string_split({{t}}, '|~|'), lambda x: {_strip('x')}), lambda x: x <> '')"
_SENTENCES = f"""
a AS (SELECT doc_id, text, {_PARTS.format(t="replace(text, chr(10) || chr(10) || chr(10), '|~|')")} AS p FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, CASE WHEN len(p) <= 1 AND length(text) > 200 THEN {_PARTS.format(t="regexp_replace(text, '([.!?])\\s+', '\\1|~|', 'g')")} ELSE p END AS p FROM a)"""


@query("sentences", f"WITH {_SENTENCES} SELECT doc_id, len(p) AS n, md5(array_to_string(p, chr(10))) AS h FROM s WHERE len(p) > 0")
def sentences(read):
    d = read("documents").where("text is not null").select("doc_id", chunking.sentences(F.col("text")).alias("p")).where(F.size("p") > 0)
    return d.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "\n")).alias("h"))


@query(
    "sentence_groups",
    f"""WITH {_SENTENCES},
i AS (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM s WHERE len(p) > 0)
SELECT doc_id, (i - 1)::INT AS pos, md5(array_to_string(p[greatest(1, i - 5) : least(len(p), i + 5)], ' ')) AS h FROM i""",
)
def sentence_groups(read):
    d = read("documents").where("text is not null").select("doc_id", chunking.sentences(F.col("text")).alias("p"))
    return d.select("doc_id", F.posexplode(chunking.sentence_groups(F.col("p"))).alias("pos", "g")).select("doc_id", "pos", F.md5("g").alias("h"))


_VECTORS = r"""
u AS (SELECT regexp_extract(chunk_id, '^(.*)_page_', 1) AS doc, model, vec_id AS pos, embedding::DOUBLE[] AS vec FROM chunk_embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
z AS (SELECT * FROM (SELECT model, len(vec) AS dim, count(*) AS n FROM u GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, dim DESC) = 1),
v AS (SELECT coalesce(u.model, '') || '|' || u.doc AS doc, pos, vec FROM u JOIN z ON u.model IS NOT DISTINCT FROM z.model AND len(u.vec) = z.dim),
n AS (SELECT *, lead(vec) OVER (PARTITION BY doc ORDER BY pos) AS nxt FROM v),
sim AS (SELECT doc, pos, list_cosine_similarity(vec, nxt) AS similarity FROM n WHERE nxt IS NOT NULL)"""


def _chunk_vectors(read):
    """The usable vectors of the usual size of their model; a document's vectors of one model are a sequence."""
    e = read("chunk_embeddings").where("embedding is not null and size(embedding) > 0")
    e = e.where(~F.exists("embedding", lambda x: F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    e = e.select(F.coalesce("model", F.lit("")).alias("model"), F.regexp_extract("chunk_id", "^(.*)_page_", 1).alias("d"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    usual = e.groupBy("model", F.size("vec").alias("dim")).agg(F.count("*").alias("n")).groupBy("model").agg(F.max(F.struct("n", "dim"))["dim"].alias("dim"))
    e = e.join(F.broadcast(usual), "model").where(F.size("vec") == F.col("dim"))  # one row a model
    return e.select(F.concat_ws("|", "model", "d").alias("doc"), "pos", "vec")


@query("adjacent_similarity", f"WITH {_VECTORS} SELECT doc, pos, round(similarity, 6) AS similarity FROM sim")
def adjacent_similarity(read):
    return chunking.adjacent_similarity(_chunk_vectors(read), "doc", "pos", "vec").withColumn("similarity", F.round("similarity", 6))


@query("semantic_breakpoints", f"WITH {_VECTORS}, r AS (SELECT doc, pos, round(similarity, 6) AS similarity FROM sim), l AS (SELECT doc, quantile_cont(similarity, 0.25) AS lim FROM r GROUP BY doc) SELECT doc, pos FROM r JOIN l USING (doc) WHERE similarity < lim")
def semantic_breakpoints(read):
    s = chunking.adjacent_similarity(_chunk_vectors(read), "doc", "pos", "vec").withColumn("similarity", F.round("similarity", 6))
    return chunking.breakpoints(s, "doc", "pos", 0.75)


@query(
    "semantic_chunks",
    f"""WITH {_VECTORS}, l AS (SELECT doc, quantile_cont(similarity, 0.25) AS lim FROM sim GROUP BY doc),
e AS (SELECT doc, pos FROM sim JOIN l USING (doc) WHERE similarity < lim),
m AS (SELECT v.doc, v.pos, CASE WHEN e.pos IS NULL THEN 0 ELSE 1 END AS ends FROM v LEFT JOIN e ON v.doc = e.doc AND v.pos = e.pos),
c AS (SELECT doc, pos, coalesce(sum(ends) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS chunk FROM m)
SELECT doc, chunk, string_agg(pos, ' ' ORDER BY pos) AS text FROM c GROUP BY doc, chunk""",
)
def semantic_chunks(read):
    v = _chunk_vectors(read).withColumn("text", F.col("pos"))
    return chunking.semantic_chunks(v, "doc", "pos", "text", "vec", 0.75)


def _name_sql() -> str:
    p, c = chunking.words_within(512), chunking.words_within(64)
    cut = lambda size, carry, w, i: f"{w}[{i} * {size - carry} + 1 : {i} * {size - carry} + {size}]"
    n = lambda size, carry, w: f"generate_series(0, ceil(greatest(len({w}) - {size}, 0) / {size - carry})::INT)"
    return f"""
WITH w AS (SELECT doc_id, {WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, w, unnest({n(p, 51, 'w')}) AS i FROM w WHERE len(w) > 0),
b AS (SELECT 'd' || doc_id || '_parent_chunk_' || (i + 1) AS parent_id, {cut(p, 51, 'w', 'i')} AS pw FROM a),
c AS (SELECT parent_id, pw, unnest({n(c, 6, 'pw')}) AS j FROM b)
SELECT parent_id, parent_id || '_child_chunk_' || (j + 1) AS child_id, md5(array_to_string({cut(c, 6, 'pw', 'j')}, ' ')) AS h FROM c"""


@query("parent_child_chunks", _name_sql())
def parent_child_chunks(read):
    d = read("documents").where("text is not null").select(F.concat(F.lit("d"), "doc_id").alias("name"), "text")
    return chunking.parents_and_children(d, "name", "text").select("parent_id", "child_id", F.md5("child_text").alias("h"))


@query("table_chunks")
def table_chunks(read):
    """Greedy filling with a carry that depends on it; checked against a plain loop by pytest."""
    d = read("documents").where("kind = 'Table' and text is not null")
    t = d.select("doc_id", F.explode(text.markdown_tables(F.col("text"))).alias("t"))
    return chunking.split_tables(t, "doc_id", "t", 64).select("doc_id", "chunk", F.length("text").alias("n_chars"))


@query("description_chunks")
def description_chunks(read):
    n = read("graph_nodes").where("description is not null")
    return chunking.description_chunks(n, "id", "description", 32)


# routing


def _classify_sql(q: str) -> tuple[str, str]:
    kind = " ".join(f"WHEN {any_match(q, p)} THEN '{n}'" for n, p in routing.QUERY_PATTERNS.items())
    conf = " ".join(f"WHEN {any_match(q, p)} THEN 0.8::DOUBLE" for p in routing.QUERY_PATTERNS.values())
    kind += " " + " ".join(f"WHEN {any_match(q, [p])} THEN '{n}'" for p, n, _ in routing.QUESTION_WORDS)
    conf += " " + " ".join(f"WHEN {any_match(q, [p])} THEN {c}::DOUBLE" for p, _, c in routing.QUESTION_WORDS)
    return f"CASE {kind} ELSE 'unknown' END", f"CASE {conf} ELSE 0.3::DOUBLE END"


_KIND, _CONF = _classify_sql("q")
_ROUTED = f"""b AS (SELECT query_id, query, lower({_strip('query')}) AS q, coalesce(len(expected_topics), 0) AS n_entities FROM benchmark_queries WHERE query IS NOT NULL),
c AS (SELECT *, {_KIND} AS query_type, {_CONF} AS confidence FROM b)"""


def _case(i: int) -> str:
    value = (lambda v: repr(v) + "::DOUBLE") if i < 2 else lit
    return "CASE query_type " + " ".join(f"WHEN '{n}' THEN {value(w[i])}" for n, w in routing.WEIGHTS.items()) + " END"


def _classified(read):
    b = read("benchmark_queries").where("query is not null")
    c = b.select("query_id", "query", F.coalesce(F.size("expected_topics"), F.lit(0)).alias("n_entities"), routing.classify(F.col("query")).alias("c"))
    return c.select("query_id", "query", F.greatest("n_entities", F.lit(0)).alias("n_entities"), "c.*")


@query("route_rules", f"WITH {_ROUTED} SELECT query_id, query_type, confidence FROM c")
def route_rules(read):
    return _classified(read).select("query_id", "query_type", "confidence")


@query(
    "route_decision",
    f"""WITH {_ROUTED}
SELECT query_id,
  CASE WHEN query_type = 'factual' AND confidence > 0.7 THEN 1.0::DOUBLE WHEN query_type = 'exploratory' THEN 0.0::DOUBLE WHEN query_type = 'relational' AND n_entities = 0 THEN 0.5::DOUBLE ELSE {_case(0)} END AS vector_weight,
  CASE WHEN query_type = 'factual' AND confidence > 0.7 THEN 0.0::DOUBLE WHEN query_type = 'exploratory' THEN 1.0::DOUBLE WHEN query_type = 'relational' AND n_entities = 0 THEN 0.5::DOUBLE ELSE {_case(1)} END AS graph_weight,
  CASE WHEN query_type = 'factual' AND confidence > 0.7 THEN 'vector_only' WHEN query_type = 'exploratory' THEN 'graph_only' ELSE {_case(2)} END AS mode,
  query_type = 'exploratory' OR {_case(0)} < 0.15 AS skip_vector,
  CASE WHEN query_type = 'relational' AND n_entities = 0 THEN false ELSE (query_type = 'factual' AND confidence > 0.7) OR {_case(1)} < 0.15 END AS skip_graph
FROM c""",
)
def route_decision(read):
    r = routing.route(F.col("query_type"), F.col("confidence"), F.col("n_entities"))
    return _classified(read).select("query_id", r.alias("r")).select("query_id", "r.*")


@query("chat_weights", f"WITH {_ROUTED} SELECT query_id, CASE WHEN query_type = 'exploratory' THEN 0.3::DOUBLE ELSE {_case(0)} END AS vector_weight, CASE WHEN query_type = 'exploratory' THEN 0.7::DOUBLE ELSE {_case(1)} END AS graph_weight FROM c")
def chat_weights(read):
    return _classified(read).select("query_id", routing.chat_weights(F.col("query_type")).alias("w")).select("query_id", "w.*")


_SUBQ = r"greatest(1, len(regexp_extract_all(query, '(?m)^\s*[-•*]\s+.+')) + len(regexp_extract_all(query, '(?m)^\s*\d+[.)]\s+.+')))"
_KEYS = " + ".join(f"{any_match('lower(query)', [p])}::INT" for p in routing.KEYWORDS)
_SCORE = f"""(0.25 * CASE WHEN query_type IN ('analytical', 'comparative') THEN 1.0 WHEN query_type IN ('relational', 'exploratory') THEN 0.5 ELSE 0.0 END
  + 0.2 * least(n_entities / 4.0, 1.0) + 0.2 * least(({_SUBQ} - 1) / 3.0, 1.0) + 0.2 * least(({_KEYS}) / 3.0, 1.0) + 0.15 * greatest(0.0, least(1.0, (0.7 - confidence) / 0.5)))::DOUBLE"""
_COMPLEX = f"""{_ROUTED},
f AS (SELECT *, {_SCORE} AS raw, {any_match('lower(query)', routing.DATABASE_META)} AS meta, {any_match('lower(query)', routing.AGGREGATION)} AS agg, {any_match('lower(query)', routing.AMBIGUOUS)} AS vague FROM c),
x AS (SELECT query_id, round(greatest(raw, CASE WHEN meta THEN 0.75 WHEN agg OR vague THEN 0.65 ELSE 0.0 END), 6) AS score,
  CASE WHEN meta OR agg THEN 'complex' WHEN vague THEN 'ambiguous' WHEN raw >= 0.55 THEN 'complex' WHEN raw >= 0.35 THEN 'moderate' ELSE 'simple' END AS level FROM f)"""


def _complexity(read):
    x = routing.complexity(F.col("query"), F.col("query_type"), F.col("confidence"), F.col("n_entities"))
    return _classified(read).select("query_id", x.alias("x")).select("query_id", F.round("x.score", 6).alias("score"), "x.level")


@query("complexity", f"WITH {_COMPLEX} SELECT query_id, score, level FROM x")
def complexity(read):
    return _complexity(read)


@query("path_selection", f"WITH {_COMPLEX} SELECT query_id, CASE WHEN score >= 0.55 THEN 'agent' WHEN score >= 0.35 THEN 'enhanced' ELSE 'fast' END AS path, CASE WHEN score >= 0.35 AND score < 0.55 THEN 15 ELSE 10 END AS top_k FROM x")
def path_selection(read):
    return _complexity(read).select("query_id", routing.path_of(F.col("score")).alias("p")).select("query_id", "p.*")


@query(
    "fallback_weights",
    f"""WITH {_ROUTED},
k AS (SELECT query_id, {_case(0)} AS v, {_case(1)} AS g, (length(query) % 7) / 10.0 AS vc, (length(query) % 5) / 10.0 AS gc FROM c),
a AS (SELECT *, CASE WHEN vc < 0.3 THEN 0.3 * (1 - vc / 0.3) ELSE 0.0 END AS sa, CASE WHEN gc < 0.3 THEN 0.3 * (1 - gc / 0.3) ELSE 0.0 END AS sb FROM k)
SELECT query_id, round(least(1.0, greatest(0.0, v - sa) + sb)::DOUBLE, 6) AS vector_weight, round(greatest(0.0, least(1.0, g + sa) - sb)::DOUBLE, 6) AS graph_weight, vc < 0.3 AND gc < 0.3 AS adaptive FROM a""",
)
def fallback_weights(read):
    c = _classified(read)
    v, g = (routing._by_type(F.col("query_type"), {k: x[i] for k, x in routing.WEIGHTS.items()}) for i in range(2))
    f = routing.fallback(v, g, F.lit(False), F.lit(False), (F.length("query") % 7) / 10, (F.length("query") % 5) / 10)
    return c.select("query_id", f.alias("f")).select("query_id", F.round("f.vector_weight", 6).alias("vector_weight"), F.round("f.graph_weight", 6).alias("graph_weight"), "f.adaptive")


@query(
    "relation_questions",
    "WITH b AS (SELECT query_id, lower(query) AS q FROM benchmark_queries WHERE query IS NOT NULL) SELECT query_id, CASE "
    + " ".join(f"WHEN regexp_matches(q, {lit(p)}) THEN {_strip(f'regexp_extract(q, {lit(p)}, 1)')}" for p in routing.RELATION_QUESTIONS)
    + " END AS source, CASE "
    + " ".join(f"WHEN regexp_matches(q, {lit(p)}) THEN {_strip(f'regexp_extract(q, {lit(p)}, 2)')}" for p in routing.RELATION_QUESTIONS)
    + f" END AS target, {any_match('q', routing.GLOBAL_QUESTIONS)} AS is_global FROM b",
)
def relation_questions(read):
    b = read("benchmark_queries").where("query is not null")
    return b.select("query_id", routing.relation_question(F.col("query")).alias("r"), routing.is_global(F.col("query")).alias("is_global")).select("query_id", "r.*", "is_global")
