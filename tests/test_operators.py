"""What SQL can't check: greedy and iterative operators against plain loops, edge cases, sinks, streams, agent."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docmill.agent import Agent, history, parse
from docmill.config import embedding_limits, ontology_of, settings_from, settings_of
from docmill.engine import Engine
from docmill.functions import render, routing, text
from docmill.hooks import dictionary_entities, hash_embedder
from docmill.operators import chunking, graph, resolution, search, state
from docmill.sources import files
from docmill.streaming import jobs


def one(df):
    return df.first()[0]


def column(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_hard_split_is_greedy(spark):
    def greedy(t, most, carry):
        out, own = [], []
        for w in t.split():
            if own and len([*own, w]) * 13 // 10 > most:
                out.append(" ".join(own))
                own = own[-carry:]
            own.append(w)
        return [*out, " ".join(own)] if own else out

    rng = random.Random(3)
    for most in (8, 20, 64):
        t = " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 300)))
        assert column(spark, t, lambda c: chunking.hard_split(c, most, 2)) == greedy(t, most, 2)
    assert column(spark, "", lambda c: chunking.hard_split(c, 10)) == []
    assert column(spark, None, lambda c: chunking.hard_split(c, 10)) == []
    with pytest.raises(ValueError):
        chunking.windows(F.lit("x"), 5, 5)


def test_table_chunks():
    t = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | word word word |" for i in range(30)) + "\nnot a row"
    parts = chunking.table_chunks(t, 60)
    assert len(parts) > 1 and all(p.startswith("| a | b |\n|---|---|") for p in parts)
    seen = {r for p in parts for r in p.split("\n")[2:]}
    assert len(seen) == 30 and all(chunking.estimated_tokens(p) <= 60 for p in parts)
    assert set(parts[0].split("\n")[2:]) & set(parts[1].split("\n")[2:])  # they overlap
    assert chunking.table_chunks("") == [] and chunking.table_chunks("text only") == []
    assert chunking.table_chunks("| x |\n|---|", 10) == ["| x |\n|---|"]
    assert chunking.table_chunks(t, 60, columns=["p", "q"])[0].startswith("| p | q |")


def test_semantic_split_keeps_all_words():
    t = " ".join(f"Sentence number {i} speaks of topic {i // 7}." for i in range(60))
    parts = chunking.semantic_split(t, 40, lambda xs: [[len(x) % 7 + 1, len(x) % 5, 1] for x in xs])
    assert all(chunking.estimated_tokens(p) <= 40 for p in parts)
    assert set(" ".join(parts).split()) == set(t.split())


def test_boxes():
    b = lambda y1, y2, label: {"x1": 0, "y1": y1, "x2": 10, "y2": y2, "label": label}
    g = chunking.group_boxes([b(0, 5, "Text"), b(20, 40, "Table"), b(41, 45, "Caption"), b(80, 90, "Text")])
    assert [x["label"] for x in g] == ["Text", "Table", "Text"] or [x["label"] for x in g] == ["Text", "Table"]
    assert any(x["label"] == "Table" and "Caption" in x["parts"] for x in g)


def test_pages_of_long_documents(spark):
    assert column(spark, 5, lambda c: chunking.distributed_pages(c, 10), "int") == [1, 2, 3, 4, 5]
    p = column(spark, 100, lambda c: chunking.distributed_pages(c, 10), "int")
    assert len(p) == 10 and p[:4] == [1, 2, 3, 4] and p[-3:] == [98, 99, 100]


def test_json_ladders(spark):
    assert column(spark, 'x ```json\n{"entities": [{"name": "A"}]}\n``` y', lambda c: text.json_from_response(c, "entities")) == '[{"name":"A"}]'
    assert column(spark, 'sure: [{"name": "B"}] done', lambda c: text.json_from_response(c, "entities")) == '[{"name":"B"}]'
    assert column(spark, "nothing", lambda c: text.json_from_response(c, "entities")) is None
    assert column(spark, '{"other": 1}', lambda c: text.json_from_response(c, "entities")) == "[]"
    fr = '{"relations": [{"Entité_source": "A", "cible": "B", "relation": "UTILISE", "note": "say \\"nom\\": x"}]}'
    assert column(spark, fr, lambda c: text.json_from_response(c, "relations")) == '[{"source":"A","target":"B","note":"say \\"nom\\": x","type":"UTILISE"}]' or '"type":"UTILISE"' in column(spark, fr, lambda c: text.json_from_response(c, "relations"))
    v = column(spark, 'ok {"same_entity": true, "confidence": 0.9}', text.verdict_from_response)
    assert v.same_entity and v.confidence == 0.9
    assert not column(spark, "garbage", text.verdict_from_response).same_entity
    c = column(spark, "TYPE: Factual\nCONFIDENCE: 0.85\nENTITIES: [A, B]\nREASONING: why", text.classification_from_response)
    assert (c.type, c.confidence, c.entities) == ("factual", 0.85, ["A", "B"])
    assert column(spark, "Step 3\nExpanded Queries:\n- one\n- two", text.expanded_queries) == ["one", "two"]
    assert column(spark, "{'a': 1}", text.recover_json) == '{"a":1}'
    assert column(spark, "no braces", text.recover_json) == "no braces"


def test_markup(spark):
    assert column(spark, "# T\n**b** and [l](u) `c`\n- i", text.markdown_to_plain) == "T\nb and l c\ni"
    assert column(spark, "<p>a&amp;b</p><script>x</script><b>c</b>", text.html_to_plain) == "a&b\n c" or "a&b" in column(spark, "<p>a&amp;b</p><b>c</b>", text.html_to_plain)


def test_ranking_parser(spark):
    r = column(spark, "Document 3: score = 7.5\nDocument 1\ndocument 2, Score: 9", search.parse_ranking)
    assert [(x.document, x.score) for x in r] == [(3, 7.5), (1, 5.0), (2, 9.0)]


def test_fusion_numbers(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "k string, rank int")
    got = {r.k: r.score for r in search.rrf([(a, 0.6), (b, 0.4)], "k").collect()}
    assert got == pytest.approx({"x": 0.6 / 61, "y": 0.6 / 62 + 0.4 / 61, "z": 0.4 / 62})
    assert column(spark, 5, lambda c: search.arm_sizes(c, F.lit(0.5)), "int") == 2  # half to even
    assert column(spark, 0, lambda c: search.arm_sizes(c, F.lit(0.5)), "int") == 1


def test_metadata_filter(spark):
    df = spark.createDataFrame([("1", "Ab", None), ("2", "cd", 7)], "id string, a string, n int")
    fields = {"a": F.col("a"), "n": F.col("n")}
    ids = lambda rules, all_=True: {r.id for r in df.where(search.metadata_filter(fields, rules, all_)).collect()}
    assert ids([("n", "ne", 3)]) == {"2"}  # a missing value fails ne as well
    assert ids([("a", "contains", "B")]) == {"1"} and ids([("n", "in", [7, 8])]) == {"2"} and ids([]) == {"1", "2"}
    assert ids([("missing", "eq", 1)]) == set() and ids([("a", "gt", 1)]) == set()
    with pytest.raises(ValueError):
        ids([("a", "like", 1)])


def test_empty_index(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    q = spark.createDataFrame([("q", "x")], "query_id string, query string")
    assert search.bm25(search.build_index(docs), q).count() == 0
    nulls = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "alpha beta", None)], "doc_id long, text string, source string")
    got = search.bm25(search.build_index(nulls), spark.createDataFrame([("q", "alpha alpha")], "query_id string, query string")).collect()
    assert [r.doc_id for r in got] == [3] and got[0].score > 0


def test_best_of_many_queries(spark):
    """Without pairs of queries and documents, but as from all of them: ties, repeated words, groups, a document given twice, null texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(150)]
    docs = spark.createDataFrame([(f"d{i:03d}", texts[i % 120], rng.choice(["a", "b", None])) for i in range(200)] + [("d007", "w1 w2 w3", "a"), ("e", None, "a")], "doc_id string, text string, group string")
    q = spark.createDataFrame([(i, " ".join(rng.choices([*words, "none"], k=rng.randint(1, 5)))) for i in range(60)] + [(60, "none"), (61, "")], "query_id int, query string").repartition(3)
    index = search.build_index(docs)
    listed = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    scored = search.bm25(index, q).withColumn("score", F.round("score", 6))
    best = search.bm25_best(index, q, 5)
    assert listed(search.top_k(best, 5, ["query_id"])) == listed(search.top_k(scored, 5, ["query_id"]))
    assert scored.count() > 4 * best.count()
    counts = search.term_counts(index, q)
    assert listed(search.top_k(search.term_counts_best(index, q, 5), 5, ["query_id"])) == listed(search.top_k(counts, 5, ["query_id"]))
    by = ["query_id", "group"]
    grouped = search.bm25_best(index, q, 2, docs.select("doc_id", "group")).join(docs.select("doc_id", "group"), "doc_id")
    assert listed(search.top_k(grouped, 2, by)) == listed(search.top_k(scored.join(docs.select("doc_id", "group"), "doc_id"), 2, by))
    assert search.bm25_best(index, q.where("false"), 5).count() == 0


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_fusion", "fused_context", "multi_index_search", "filtered_topk", "reranked_yes_no", "keyword_hit_rate", "retrieval_quality", "contexts_once", "lost_in_middle", "parent_expand"])
def test_ranked_queries_make_no_pairs(spark, data, monkeypatch, name):
    from docmill.plans import catalog

    def pairs(*_):
        raise AssertionError("all pairs of queries and documents")

    monkeypatch.setattr(search, "bm25", pairs)
    monkeypatch.setattr(search, "term_counts", pairs)
    catalog.queries()[name](spark, data)


def test_routing(spark):
    kind = lambda q: column(spark, q, lambda c: routing.classify(c)["query_type"])
    assert kind("What is the relationship between A and B?") == "relational"
    assert kind("Résume le document") == "exploratory" and kind("¿Qué dice?") == "unknown" and kind("qué dice") == "factual"
    assert kind("Warum?") == "analytical" and kind("") == "unknown"
    f = lambda v, g: column(spark, 1.0, lambda c: routing.fallback(F.lit(0.6), F.lit(0.4), F.lit(False), F.lit(False), F.lit(v), F.lit(g)), "double")
    assert f(0.0, 1.0).graph_weight == pytest.approx(0.7) and f(0.3, 0.3).vector_weight == pytest.approx(0.6) and f(0.0, 0.0).adaptive
    o = column(spark, 1.0, lambda c: routing.override("vector_only", routing.route(F.lit("exploratory"), F.lit(0.8), F.lit(0))), "double")
    assert not o.skip_vector and o.skip_graph
    assert column(spark, "x", lambda c: text.error_type(c, F.lit("TimeoutError"))) == "TRANSIENT"


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "R", float(w)) for a, b, w in pairs], "src string, dst string, rel_type string, weight double")


def test_louvain_finds_cliques(spark):
    cliques = [[f"{c}{i}" for i in range(5)] for c in "abcd"]
    e = edges_of(spark, [(x, y, 1) for k in cliques for x in k for y in k if x < y] + [("a0", "b0", 1), ("b1", "c0", 1), ("c1", "d0", 1)])
    c = graph.louvain(e)
    part = {r.node_id: r.community for r in c.collect()}
    assert len(part) == 20
    assert graph.modularity(e, c).first()[0] > 0.6
    assert {r.node_id: r.community for r in graph.louvain(e).collect()} == part  # the same again
    assert graph.louvain(edges_of(spark, []).where("false")).count() == 0


def test_walks(spark):
    e = edges_of(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "a", 1), ("c", "c", 1)])
    starts = spark.createDataFrame([("a",)], "start string")
    assert {(r.node_id, r.distance) for r in graph.neighbours(e, starts, 2, "out").collect()} == {("b", 1), ("c", 1)}
    pairs = spark.createDataFrame([("a", "c"), ("a", "a")], "src string, dst string")
    assert [tuple(r.path) for r in graph.simple_paths(e, pairs).orderBy("length").collect()] == [("a", "c"), ("a", "b", "c")]


def test_resolution(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.99, 0.05]), ("c", [0.0, 1.0]), ("d", None), ("e", [0.0, 0.0]), ("f", [1.0])], "id string, vec array<double>")
    for block in (1, 2, 100):
        assert [(r.id_a, r.id_b) for r in resolution.candidate_pairs(v, 0.9, block).collect()] == [("a", "b")]
    p = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y"), ("z", "z")], "a string, b string")
    roots = {r.id: r.root for r in resolution.clusters(p).collect()}
    assert set(roots.values()) == {"n000", "x"} and len(roots) == 63
    t = spark.createDataFrame([(["One two three. Four five six.", "ONE two three. New words here."],)], "t array<string>")
    assert t.select(resolution.join_sentences(F.col("t"))).first()[0] == "One two three. Four five six. New words here."
    same = lambda a, b: column(spark, 1, lambda c: resolution.same_by_rule(F.lit(a), F.array().cast("array<string>"), F.lit(b), F.array(F.lit("AI"))), "int")
    assert same("Machine Learning", "ML") and same("ai", "Other") and not same("Java", "JavaScript") and not same("", "")


def test_components_over_several_rounds(spark):
    rng = random.Random(21)
    e = [(f"v{rng.randint(0, 300):03d}", f"v{rng.randint(0, 300):03d}") for _ in range(120)] + [("hub", f"w{i}") for i in range(150)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(80)]
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in e:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {v: find(v) for v in parent if sum(find(u) == find(v) for u in parent) > 1}
    df = spark.createDataFrame(e + e[:1] * 500 + [(None, "q"), ("z", "z")], "a string, b string")
    assert {r.id: r.root for r in resolution.clusters(df, cell_edges=25).collect()} == want


def test_resolve_merges(spark):
    shape = "id string, name string, type string, description string, source_chunks array<string>, attributes map<string,string>, aliases array<string>"
    rows = [
        ("1", "Machine Learning", "CONCEPT", "Learning from data.", ["c1", "c2"], {"year": "1959"}, ["statistical learning"]),
        ("2", "ML", "FIELD", "Learning from data. It needs examples.", ["c2", "c3"], {"year": "1960", "kind": "x"}, []),
        ("3", "Python", "LANGUAGE", "A language.", ["c4"], None, ["Py"]),
        ("4", "Deep Learning", "CONCEPT", None, None, {}, None),
    ]
    n = spark.createDataFrame(rows, shape)
    e = edges_of(spark, [("1", "3", 1), ("2", "3", 2), ("4", "1", 1), ("2", "1", 5)])
    v = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [1.0, 0.1]), ("3", [0.0, 1.0]), ("4", [0.9, 0.3])], "id string, vec array<double>")
    r = resolution.resolve(n, e, v, 0.75)
    nodes = {x.id: x for x in r["nodes"].collect()}
    assert set(nodes) == {"1", "3", "4"} and nodes["1"].name == "Machine Learning" and nodes["1"].type == "CONCEPT"
    assert nodes["1"].description == "Learning from data. It needs examples." and nodes["1"].attributes == {"year": "1960", "kind": "x"}
    rows_of = lambda d: {tuple(x) for x in d.collect()}
    assert rows_of(r["aliases"]) == {("1", "ML"), ("3", "Py")} and rows_of(r["members"]) == {("1", "1"), ("1", "2")}
    assert rows_of(r["node_chunks"]) == {("1", "c1"), ("1", "c2"), ("1", "c3"), ("3", "c4")}
    assert {(x.src, x.dst): x.weight for x in r["edges"].collect()} == {("1", "3"): 3.0, ("4", "1"): 1.0}
    assert dict(rows_of(r["counts"])) == {"candidate_pairs": 3, "verified_pairs": 1, "clusters": 1, "entities_merged": 1, "relationships_updated": 4}
    # decided before: sure ones stand, unsure ones aren't asked again
    decided = spark.createDataFrame([("2", "1", True, 0.2), ("4", "1", True, 0.9)], "id_a string, id_b string, same_entity boolean, confidence double")
    assert {x.id: x.root for x in resolution.resolve(n, e, v, 0.75, decided=decided)["roots"].collect()} == {"1": "1", "4": "1"}
    d = spark.createDataFrame([("2", "3", "Two. One."), ("1", "3", "One.")], "src string, dst string, description string")
    assert rows_of(resolution.merged_edge_descriptions(d, r["roots"])) == {("1", "3", "One. Two.")}
    none = resolution.resolve(n.where("false"), e.where("false"), v.where("false"))
    assert none["nodes"].count() == 0 and none["edges"].count() == 0


def test_names_in_queries(spark):
    long = "The Very Long Name Of The Joint Committee On Regional Water Supply"
    n = spark.createDataFrame([("a", long), ("b", "Water"), ("c", None), ("d", " ")], "node_id string, name string")
    q = spark.createDataFrame([("q1", f"who leads {long.lower()}?"), ("q2", ""), ("q3", "waters")], "query_id string, query string")
    assert {tuple(r) for r in graph.mentioned(q, n).collect()} == {("q1", "a"), ("q1", "b")}
    assert graph.mentioned(q, n.where("false")).count() == 0
    assert column(spark, f"See {long} and water", lambda c: dictionary_entities(c, [long, "Water", "Fire", ""])) == ["Water", long]
    assert column(spark, None, lambda c: dictionary_entities(c, ["x"])) in (None, []) and column(spark, "x", lambda c: dictionary_entities(c, [])) == []


def test_crud_and_node_link(spark):
    n = spark.createDataFrame([("a", "A"), ("b", "B")], "node_id string, name string")
    e = edges_of(spark, [("a", "b", 1)])
    more = graph.add_nodes(n, spark.createDataFrame([("b", "other"), ("c", "C")], n.schema))
    assert {tuple(r) for r in more.collect()} == {("a", "A"), ("b", "B"), ("c", "C")}
    new = graph.update_nodes(n, spark.createDataFrame([("b", "new"), ("z", "no")], n.schema))
    assert {tuple(r) for r in new.collect()} == {("a", "A"), ("b", "new")}
    grown = graph.add_edges(e, edges_of(spark, [("a", "b", 2), ("b", "a", 1), ("a", "gone", 1)]), n)
    assert {(r.src, r.dst): r.weight for r in grown.collect()} == {("a", "b"): 3.0, ("b", "a"): 1.0}
    left = graph.remove_nodes(n, grown, spark.createDataFrame([("b",)], "node_id string"))
    assert left[0].count() == 1 and left[1].count() == 0
    back = files.read_node_link(files.node_link_lines(n, e), "node_id string, name string", "src string, dst string, rel_type string, weight double")
    assert sorted(map(tuple, back[0].collect())) == sorted(map(tuple, n.collect())) and back[1].first().src == "a"


def test_near_repeats(spark):
    t = "The committee met on Monday and discussed the budget of the coming year in detail."
    df = spark.createDataFrame([("q", 2, t + "!"), ("q", 1, t), ("q", 3, "Something else entirely."), ("q", 4, None), ("r", 1, t)], "query_id string, rank int, text string")
    assert {(r.query_id, r.rank) for r in search.without_near_repeats(df, "query_id", "rank", "text").collect()} == {("q", 1), ("q", 3), ("r", 1)}


def test_exact_percentiles(spark):
    import numpy as np

    rng = random.Random(8)
    for n in (1, 2, 3, 50, 5000):
        v = [rng.choice([rng.lognormvariate(3, 2), 7.0]) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
        got = {r.p: r.value for r in state.exact_percentiles(df, F.col("v"), (0.0, 0.5, 0.95, 1.0)).collect()}
        assert got == pytest.approx({p: float(np.percentile(v, p * 100)) for p in (0.0, 0.5, 0.95, 1.0)})
    assert state.exact_percentiles(df.where("false"), F.col("v"), (0.5,)).first().value is None


def test_state(spark):
    a = spark.createDataFrame([("s", i, not q, q) for i, q in enumerate([True, True, False, True, True, True, True])], "stage string, attempt int, ok boolean, quota boolean")
    assert state.quota_breaks(a, 3).first().first_stop == 5
    m = spark.createDataFrame([("f", 1, 1.0, "h")], "path string, size long, mtime double, content_hash string")
    n = spark.createDataFrame([("f", 2, 2.0, "h"), ("g", 1, 1.0, "i")], m.schema)
    assert [(r.path, r.change) for r in state.manifest_diff(m, n).collect()] == [("g", "new")]  # same content, so unchanged
    after = state.apply_manifest(m, n, state.manifest_diff(m, n))
    assert after.count() == 2
    f = spark.createDataFrame([(f"d{i % 3}/f{i}",) for i in range(30)], "path string")
    assert state.sample_per_folder(f, 6).count() == 6
    assert {r.path.split("/")[0] for r in state.sample_per_folder(f, 6).collect()} == {"d0", "d1", "d2"}


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta", "s"), (2, "beta", "t")], "doc_id long, text string, source string")
    index = search.build_index(docs)
    files.write_index(index, f"{tmp_path}/i", 2)
    q = spark.createDataFrame([("q", "beta")], "query_id string, query string")
    again = files.read_index(spark, f"{tmp_path}/i")
    assert sorted(map(tuple, search.bm25(again, q).collect())) == sorted(map(tuple, search.bm25(index, q).collect()))
    tables = {"nodes": docs}
    for _ in range(4):
        files.backup(tables, f"{tmp_path}/b")
    files.keep_backups(spark, f"{tmp_path}/b", 2)
    assert len(files.list_backups(spark, f"{tmp_path}/b")) == 2
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# Title\nSome words about rivers and lakes.")
    (tmp_path / "in" / "sub" / "b.html").write_text("<p>Words about rivers.</p>")
    (tmp_path / "in" / "c.bin").write_bytes(b"\x00")
    e = Engine.from_files(spark, f"{tmp_path}/in")
    assert e.info()["documents"] == 2
    assert {r.extension: r.files for r in files.count_by_extension(files.scan(spark, f"{tmp_path}/in")).collect()} == {"md": 1, "html": 1, "bin": 1}
    r = e.ask("What are rivers?").first()
    assert r.n_sources >= 1 and "rivers" in r.context
    up = files.upsert(docs, spark.createDataFrame([(2, "new", "t")], docs.schema), ["doc_id"])
    assert {(r.doc_id, r.text) for r in up.collect()} == {(1, "alpha beta"), (2, "new")}


def test_engine_on_graph(spark, data):
    x = spark.read.parquet(f"{data}/extraction_results.parquet")
    d = spark.read.parquet(f"{data}/documents.parquet")
    e = Engine(spark, d).with_graph(x)
    assert e.info()["nodes"] > 0
    q = spark.read.parquet(f"{data}/benchmark_queries.parquet").select("query_id", "query")
    assert e.query(q).count() == q.count()
    said = iter(["THOUGHT: look\nACTION: database_stats", "THOUGHT: so\nACTION: final_answer\nARGUMENTS: {\"answer\": \"42\"}"])
    r = Agent(e, lambda question, past: next(said)).run("How many?")
    assert r.answer == "42" and len(r.steps) == 2 and "nodes" in r.steps[0].observation


def test_retrieve_fuses_both_arms(spark):
    docs = [(i, f"Passage {i} speaks of rivers and bridges{' often' * i}.", f"s{i}", i) for i in range(1, 7)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, page int")
    n = spark.createDataFrame([("a", "Alpha Works", "alpha works", "ORG"), ("b", "Beta", "beta", "ORG"), ("c", "Gamma", "gamma", "ORG")], "node_id string, name string, name_norm string, type string")
    e = edges_of(spark, [("a", "b", 2), ("b", "c", 1)])
    nc = spark.createDataFrame([("a", f"k{i:02d}") for i in range(30)] + [("b", "k99")], "node_id string, chunk_id string")
    q = spark.createDataFrame([("rel", "How is Alpha Works related to Beta?"), ("plain", "rivers bridges"), ("none", "zzz"), ("all", "Summarize all rivers")], "query_id string, query string")
    eng = Engine(spark, d, n, e, node_chunks=nc)
    routed = {r.query_id: r for r in eng.route(q).collect()}
    assert routed["rel"].n_entities == 2 and routed["rel"].graph_weight > routed["rel"].vector_weight and routed["none"].n_entities == 0
    got = {r.query_id: r for r in eng.retrieve(q).collect()}
    assert set(got) == {"rel", "plain", "none", "all"}
    rel = got["rel"]
    assert rel.context.startswith("=== KNOWLEDGE GRAPH CONTEXT ===") and "- Alpha Works R Beta" in rel.context and rel.sources[0].startswith("k")
    assert sum(x.startswith("k") and x != "k99" for x in rel.sources) <= 20
    plain_ = got["plain"].context
    assert plain_.startswith("=== DOCUMENT CONTEXT ===") and "[1] (Source: s" in plain_ and got["plain"].n_sources >= 3
    assert got["none"].context is None and got["none"].sources == []
    # a graph in the middle of passages that weigh more
    mixed = spark.createDataFrame([("m", "rivers bridges Beta passage speaks")], "query_id string, query string")
    m = Engine(spark, d, n, e, node_chunks=nc).retrieve(mixed).first()
    if m.vector_weight >= m.graph_weight and m.context.count("(Source:") > 2:
        assert 0 < m.context.index("[1] (Source") < m.context.index("KNOWLEDGE GRAPH")
    # a judge and parents
    from docmill.hooks import Hooks

    judged = Engine(spark, d, hooks=Hooks(judge=lambda query, passage: F.when(passage.contains("Passage 3 "), "yes").otherwise("no"))).retrieve(q.where("query_id = 'plain'")).first()
    assert judged.sources[0] == "3"
    child = d.withColumn("parent_id", F.concat(F.lit("p"), (F.col("doc_id") % 2).cast("string")))
    parents = spark.createDataFrame([("p0", "Even text.", "P"), ("p1", "Odd text.", "P")], "parent_id string, text string, source string")
    assert set(Engine(spark, child, parents=parents).retrieve(q.where("query_id = 'plain'")).first().sources) == {"p0", "p1"}
    spark.conf.set("spark.docmill.top_k", "2")
    spark.conf.set("spark.docmill.compression", "true")
    try:
        s = settings_from(spark)
        assert s.top_k == 2 and s.compression and s.communities == 3
    finally:
        spark.conf.unset("spark.docmill.top_k")
        spark.conf.unset("spark.docmill.compression")


def test_agent_protocol():
    t, a = parse('THOUGHT: both\nACTION_1: retrieve_vector\nARGUMENTS_1: {"query": "x"}\nACTION_2: lookup_entity\nARGUMENTS_2: {"entity_name": "y"}')
    assert t == "both" and a == [("retrieve_vector", {"query": "x"}), ("lookup_entity", {"entity_name": "y"})]
    assert parse("ACTION_1: retrieve_vector\nACTION_2: final_answer")[1] == [("final_answer", {})]
    assert parse('ACTION: lookup_entity\nARGUMENTS: {entity_name: "z"}')[1] == [("lookup_entity", {"entity_name": "z"})]
    assert parse("ACTION: unknown_tool")[1] == [] and parse("") == ("", [])
    nested = parse('**THOUGHT:** a: b\nwith lines\n**ACTION:** aggregate_graph\n**ARGUMENTS:** {"operation": "COUNT", "more": {"x": [1, 2]}} and so on')
    assert nested == ("a: b\nwith lines", [("aggregate_graph", {"operation": "COUNT", "more": {"x": [1, 2]}})])
    assert parse("ACTION: retrieve_graph\nARGUMENTS: {'query': 'x'}")[1] == [("retrieve_graph", {"query": "x"})]
    assert parse("ACTION: retrieve_graph\nARGUMENTS: {broken")[1] == [("retrieve_graph", {})]
    assert history([]) == ""


def test_render(spark):
    df = spark.createDataFrame([([("A", "T", "d")], [("A", "USES", "B")], [[("A", "USES", "B"), ("B", "IN", "C")]], ["topic"])], "e array<struct<name:string,type:string,description:string>>, r array<struct<src:string,rel:string,dst:string>>, p array<array<struct<src:string,rel:string,dst:string>>>, t array<string>")
    got = df.select(render.graph_context(F.col("e"), F.col("r"), F.col("p"), F.col("t"))).first()[0]
    assert "- A (T): d" in got and "- A USES B" in got and "1. A [USES] → B [IN] → C" in got and "- topic" in got
    assert column(spark, [], render.found_documents, "array<string>") == "No relevant documents found."
    v = column(spark, 'x {"claims": [{"claim": "c", "supported": false}], "overall_supported": false, "summary": "s"}', render.claims)
    assert not v.supported and v.claims[0].claim == "c"
    assert column(spark, "?", render.claims).supported


def test_settings():
    o = ontology_of({"entities": [{"name": "E", "attributes": ["a", {"name": "b", "type": "number"}]}], "query_routing": {"factual": {"vector": 0.9, "graph": 0.1}}, "graph": {"resolution": 2.0}})
    assert [a.type for a in o.entities[0].attributes] == ["string", "number"] and o.weights["factual"] == (0.9, 0.1) and o.community_resolution == 2.0
    assert ontology_of(None).min_confidence == 0.7
    assert embedding_limits("nomic-embed-text:latest")[1] == 768 and embedding_limits("none")[1] == 1024
    with pytest.raises(ValueError):
        settings_of(nonsense=1)


def test_embedder_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "a b")], "i int, t string")
    got = {r.i: r.v for r in df.select("i", hash_embedder(16)(F.col("t")).alias("v")).collect()}
    assert got[2] is None and got[3] is None and got[1] == got[4] and abs(sum(x * x for x in got[1]) - 1) < 1e-5


def test_streams(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet")
    src = tmp_path / "events"
    batch.repartition(3).write.parquet(str(src))
    stream = jobs.event_stream(spark, str(src), batch.schema)
    q = jobs.tumbling(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("t1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = jobs.tumbling(batch.withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    key = lambda d: sorted((r.window_start, r.event_type, r.n) for r in d.collect())
    assert key(spark.table("t1")) == key(want)
    both = tmp_path / "twice"
    batch.write.parquet(str(both))
    batch.write.mode("append").parquet(str(both))
    q = jobs.without_repeats(jobs.event_stream(spark, str(both), batch.schema, 10), "60 days").groupBy().count().writeStream.outputMode("complete").format("memory").queryName("t2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("t2").first()[0] == batch.count()


def test_incremental_ingest(spark, tmp_path):
    shape = "path string, size long, mtime double, content_hash string, text string"
    src = tmp_path / "files"
    spark.createDataFrame([("a", 1, 1.0, "h1", "x"), ("b", 1, 1.0, "h2", "y")], shape).coalesce(1).write.parquet(str(src))
    run = lambda: jobs.ingest_into(spark.readStream.schema(shape).parquet(str(src)), f"{tmp_path}/manifest", f"{tmp_path}/out", f"{tmp_path}/ck", lambda d: d.select("path", F.upper("text").alias("t"))).start().awaitTermination(120)
    run()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    spark.createDataFrame([("a", 1, 1.0, "h1", "x"), ("b", 2, 2.0, "h3", "z")], shape).coalesce(1).write.mode("append").parquet(str(src))
    run()
    assert sorted((r.path, r.t) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", "X"), ("b", "Y"), ("b", "Z")]


def test_ingest_again_modified_and_deleted(spark, tmp_path):
    shape = "path string, size long, mtime double, content_hash string, text string, deleted boolean"
    src, out, man = tmp_path / "files", f"{tmp_path}/out", f"{tmp_path}/manifest"

    def deliver(rows, checkpoint="ck"):
        if rows:
            spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(src))
        files_ = spark.readStream.schema(shape).parquet(str(src))
        jobs.ingest_into(files_, man, out, f"{tmp_path}/{checkpoint}", lambda d: d.select("path", F.upper("text").alias("t"))).start().awaitTermination(120)

    live = lambda: sorted((r.path, r.t) for r in jobs.live_rows(spark, out, man).collect())
    deliver([("a", 1, 1.0, "h1", "x", False), ("b", 1, 1.0, "h2", "y", None)])
    assert live() == [("a", "X"), ("b", "Y")]
    deliver([], "other")  # the first batch once more
    assert live() == [("a", "X"), ("b", "Y")] and spark.read.parquet(out).count() == 2
    deliver([("b", 2, 2.0, "h3", "z", False), ("b", 2, 3.0, "h4", "zz", False), ("a", 1, 1.0, "h1", "x", False)])
    deliver([("b", 2, 4.0, "h5", "w", False)])
    assert live() == [("a", "X"), ("b", "W")]
    assert jobs.manifest(spark, man).count() == 2
    deliver([("b", 2, 4.0, "h5", "w", False)])  # unchanged since
    assert live() == [("a", "X"), ("b", "W")] and {r.batch for r in jobs.manifest(spark, man).collect()} == {0, 2}
    deliver([("a", 1, 1.0, "h1", "x", True), ("never", 1, 1.0, "h", "n", True)])
    assert live() == [("b", "W")]
    assert "batch=0" in jobs.drop_stale(spark, out, man) and live() == [("b", "W")]
    deliver([("a", 1, 1.0, "h1", "x", False)])
    assert live() == [("a", "X"), ("b", "W")]


def test_sinks_of_metrics(spark, tmp_path):
    m = spark.createDataFrame([(1, 1.0, "fast"), (2, 3.0, "agent"), (3, 2.0, None)], "id int, timestamp double, path string")
    files.metrics_csv(m, f"{tmp_path}/c")
    files.metrics_json(m, f"{tmp_path}/j")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/c").count() == 3
    assert {r.id for r in spark.read.json(f"{tmp_path}/j").collect()} == {1, 2, 3}
    assert [r.id for r in files.newest(m, 2, "timestamp").collect()] == [2, 3]


def test_dates_and_dry_run(spark):
    c = spark.createDataFrame([("a/b",), ("x",), ("none",)], "document string")
    d = spark.createDataFrame([("a__b", 1.0), ("x", 2.0)], "stem string, mtime double")
    assert {r.document: r.file_date for r in files.date_of(c, d).collect()} == {"a/b": 1.0, "x": 2.0, "none": None}
    f = spark.createDataFrame([("p.md", 1, 1.0, "h"), ("q.md", 1, 1.0, "i")], "path string, size long, mtime double, content_hash string")
    got = {(r.what, r.key): r.n for r in files.dry_run(f, f.where("path = 'p.md'")).collect()}
    assert got == {("extension", "md"): 2, ("change", "new"): 1}


def test_caps_and_boxes(spark):
    rows = [(f"e{i}", i, f"c{i}_{j}") for i in range(3) for j in range(5)] + [("e9", 9, "c0_0")]
    df = spark.createDataFrame(rows, "entity string, rank int, chunk string")
    got = [r.chunk for r in search.capped_chunks(df, "entity", "rank", "chunk", 2, 5).collect()]
    assert got == ["c0_0", "c0_1", "c1_0", "c1_1", "c2_0"]
    o = lambda a, b, c, d: spark.range(1).select(render.overlaps_in_height(F.lit(a), F.lit(b), F.lit(c), F.lit(d))).first()[0]
    assert o(0, 10, 5, 20) and not o(0, 10, 10, 20)


def test_multi_index_and_members(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 0.5)], "k string, score double")
    b = spark.createDataFrame([("t", 1.0)], "k string, score double")
    assert [(r.k, r.content_type) for r in search.multi_index({"text": a, "table": b}, {"table": 0.9}, 2, "k").orderBy("rank").collect()] == [("x", "text"), ("t", "table")]
    m = spark.createDataFrame([("r", "A", 1), ("r", "B", 2), ("r", "B", 3), ("s", "C", 1), ("s", "D", 2)], "root string, type string, ord int")
    assert {r.root: r.type for r in resolution.majority_type(m).collect()} == {"r": "B", "s": "C"}
    d = spark.createDataFrame([("r", 1, "One two three. Four five six."), ("r", 2, "one two three. New words here."), ("s", 1, "")], "root string, ord int, description string")
    assert {r.root: r.description for r in resolution.merge_descriptions(d).collect()} == {"r": "One two three. Four five six. New words here."}


def test_descriptions_of_a_large_cluster():
    """Sentences meet through their words: as in the plain loop, without comparing all of them."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    bags = [rng.sample(words, rng.randint(1, 9)) for _ in range(400)]
    kept = []
    for i, b in enumerate(bags):
        if not any(len({*b} & {*bags[j]}) / min(len(b), len(bags[j])) > 0.8 for j in kept):
            kept.append(i)
    assert resolution.unsaid(bags) == kept and resolution.unsaid([[], []]) == [0, 1]
    many = [[f"a{i}", f"b{i}", f"c{i}", "the"] for i in range(2000)]
    began = time.time()
    assert resolution.unsaid([*many, *many]) == list(range(2000))
    assert time.time() - began < 60


def test_state_with_a_time_to_live(spark, tmp_path):
    src = tmp_path / "kv"
    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "key string, value double").coalesce(1).write.parquet(str(src))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("key string, value double").parquet(str(src))
        q = jobs.ttl_cache(stream, 60_000).writeStream.outputMode("append").format("memory").queryName("t3").option("checkpointLocation", f"{tmp_path}/ck").start()
        for _ in range(60):  # processing time goes on, so the query never ends by itself
            if q.lastProgress and spark.table("t3").count() >= 3:
                break
            time.sleep(0.5)
        q.stop()
        assert sorted((r.key, r.value, r.hit) for r in spark.table("t3").collect()) == [("a", 1.0, False), ("a", 2.0, True), ("b", 3.0, False)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
