"""The engine over a collection: ingest, query, aggregate; one plan per query, or one for a table of queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.config import Settings, settings_from
from docmill.functions import routing
from docmill.functions.render import cited_passage, graph_context
from docmill.hooks import Hooks
from docmill.operators import chunking, graph, search, state
from docmill.operators.resolution import resolve
from docmill.scratch import stage
from docmill.sources import files


@dataclass
class Engine:
    """Tables of one collection.

    documents(doc_id, text, source, …) are the passages; nodes and edges the
    graph, node_chunks(node_id, chunk_id) what it was drawn from;
    communities(id, summary). With a column ``parent_id`` and parents(parent_id,
    text, source) the passages found are replaced by their parents. Everything is
    optional but the documents.
    """

    spark: SparkSession
    documents: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    communities: DataFrame | None = None
    node_chunks: DataFrame | None = None
    parents: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    hooks: Hooks = field(default_factory=Hooks)
    _index: search.Index | None = None

    @classmethod
    def from_files(cls, spark: SparkSession, *paths: str, settings: Settings | None = None) -> Engine:
        """A collection of text, Markdown and HTML files, cut into parent chunks."""
        s = settings or settings_from(spark)
        texts = files.read_texts(spark, *paths)
        d = texts.select(F.col("path").alias("source"), F.posexplode(chunking.hard_split(F.col("text"), s.parent_tokens)).alias("i", "text"))
        return cls(spark, d.select(F.xxhash64("source", "i").alias("doc_id"), "text", "source", (F.col("i") + 1).alias("page")), settings=s)

    @property
    def index(self) -> search.Index:
        if self._index is None:
            self._index = search.build_index(self.documents)
        return self._index

    def entities(self, queries: DataFrame) -> DataFrame:
        """(query_id, node_id): the nodes that each query names."""
        if self.nodes is None:
            return queries.select("query_id", F.lit(None).cast("string").alias("node_id")).where("false")
        return graph.mentioned(queries, self.nodes)

    def route(self, queries: DataFrame) -> DataFrame:
        """(query_id, query, n_entities, query_type, confidence, weights and skips) of ``queries(query_id, query)``."""
        n = self.entities(queries).groupBy("query_id").agg(F.count("*").alias("n_entities"))
        c = queries.select("query_id", "query", self.hooks.classify(F.col("query")).alias("c")).select("query_id", "query", "c.*").join(n, "query_id", "left")
        c = c.withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))
        r = c.withColumn("r", routing.route(F.col("query_type"), F.col("confidence"), F.col("n_entities"), self.settings.skip_below))
        o = r.withColumn("o", routing.override(self.settings.strategy, F.col("r")))
        return o.select("query_id", "query", "n_entities", "query_type", "confidence", "r.vector_weight", "r.graph_weight", "r.mode", "o.skip_vector", "o.skip_graph")

    def passages(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, score, rank): lexical and, with an embedder, dense ranks, fused."""
        k = self.settings.top_k
        q = queries.select("query_id", self.hooks.rewrite(F.col("query")).alias("query"))
        lists = [(search.top_k(search.bm25_best(self.index, q, k), k, ["query_id"]), 1.0 if self.hooks.embed is None else 1 - self.settings.dense_weight)]
        if self.hooks.embed is not None:
            embed = self.hooks.embed
            v = self.documents.select(F.col("doc_id").alias("id"), embed(F.col("text")).alias("vec"))
            qv = q.select("query_id", embed(F.col("query")).alias("qvec"))
            lists.append((search.dense_join(qv, v, k).withColumnRenamed("id", "doc_id"), self.settings.dense_weight))
        fused = search.top_k(search.rrf(lists, "doc_id", ["query_id"]), k, ["query_id"])
        return fused

    def facts(self, queries: DataFrame) -> DataFrame:
        """(query_id, node_id, mentioned, degree, rank) from the graph; empty without one."""
        if self.nodes is None or self.edges is None:
            return queries.selectExpr("query_id", "cast(null as string) as node_id", "false as mentioned", "0L as degree", "0 as rank").where("false")
        return graph.retrieve_by_entities(queries, self.nodes, self.edges, self.settings.traversal_depth)

    def relations(self, facts: DataFrame) -> DataFrame:
        """(query_id, src, rel, dst, weight): edges between the ``facts(query_id, node_id)`` of a query, by name."""
        ends = [facts.select("query_id", F.col("node_id").alias(side)) for side in ("src", "dst")]
        e = self.edges.join(ends[0], "src").join(ends[1], ["query_id", "dst"])
        name = lambda side: self.nodes.select(F.col("node_id").alias(side), F.col("name").alias(f"{side}_name"))
        return e.join(name("src"), "src").join(name("dst"), "dst").select("query_id", F.col("src_name").alias("src"), F.col("rel_type").alias("rel"), F.col("dst_name").alias("dst"), "weight")

    def graph_arm(self, routed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, graph_context, graph_confidence) and the entities (query_id, node_id, rank) of the queries that ask the graph.

        Confidence is 0.3 for each entity that a query names, 1 at most; below 0.3
        the summaries that share most of the query's words are added.
        """
        asked = routed.where("not skip_graph").select("query_id", "query")
        found = stage(self.facts(asked).select("query_id", "node_id", "mentioned", "rank"), "facts")
        listed = lambda df, order, item, most: df.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_n") <= most).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", item.alias("x")))), lambda s: s["x"]).alias("l"))
        if self.nodes is None or self.edges is None:
            none = asked.select("query_id", F.lit(None).cast("string").alias("graph_context"), F.lit(0.0).alias("graph_confidence"))
            return none, found
        described = F.col("description") if "description" in self.nodes.columns else F.lit(None).cast("string")
        e = listed(found.join(self.nodes.select("node_id", "name", "type", described.alias("description")), "node_id"), ["rank"], F.struct("name", "type", "description"), 10)
        r = listed(self.relations(found), [F.desc("weight"), "src", "dst"], F.struct("src", "rel", "dst"), 15)
        sure = found.where("mentioned").groupBy("query_id").agg(F.least(F.lit(1.0), F.count("*") * 0.3).alias("c"))
        topics = asked.select("query_id", F.array().cast("array<string>").alias("t"))
        if self.communities is not None:
            shared = F.size(F.array_intersect("qw", "sw"))
            words_of = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
            q = asked.join(sure, "query_id", "left_anti").select("query_id", words_of(F.col("query")).alias("qw"))
            s = self.communities.select("id", "summary", words_of(F.col("summary")).alias("sw"))
            # summaries are met through their words, so a query sees only those that share one
            hit = q.select("query_id", "qw", F.explode("qw").alias("w")).join(s.select("id", "summary", "sw", F.explode("sw").alias("w")), "w").drop("w").distinct().withColumn("n", shared)
            t = listed(hit, [F.desc("n"), "id"], F.col("summary"), self.settings.communities).withColumnRenamed("l", "t")
            topics = asked.select("query_id").join(t, "query_id", "left")
        no_path = F.array().cast("array<array<struct<src:string,rel:string,dst:string>>>")
        all_ = asked.select("query_id").join(e.withColumnRenamed("l", "e"), "query_id", "left").join(r.withColumnRenamed("l", "r"), "query_id", "left").join(topics, "query_id", "left").join(sure, "query_id", "left")
        return all_.select("query_id", F.nullif(graph_context(F.col("e"), F.col("r"), no_path, F.col("t")), F.lit("")).alias("graph_context"), F.coalesce("c", F.lit(0.0)).alias("graph_confidence")), found

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """(query_id, query_type, path, vector_weight, graph_weight, confidence, context, sources, n_sources) of each query.

        Both arms are asked as the route says; an arm of low confidence gives its
        weight to the other; each arm's results are cut to its share. Passages
        are judged, replaced by their parents and compressed where the engine has
        the means. Where passages weigh more and there are more than two, the
        weakest stand in the middle and the graph's facts between the halves; else
        the facts come first. ``sources`` are the chunks of the entities used (20
        each, 100 in all), then the passages, each once.
        """
        s = self.settings
        routed = stage(self.route(queries), "routed")
        hits = self.passages(routed.where("not skip_vector").select("query_id", "query"))
        docs = self.documents
        if self.parents is not None:
            of = docs.select("doc_id", "parent_id").where("parent_id is not null")
            hits = search.parent_expand(hits.join(of, "doc_id"), self.parents.select("parent_id"), by=["query_id"]).withColumnRenamed("parent_id", "doc_id")
            hits = search.top_k(hits.drop("rank"), s.top_k, ["query_id"])
            docs = self.parents.withColumnRenamed("parent_id", "doc_id")
        hits = stage(hits.join(docs, "doc_id").select("query_id", "doc_id", "score", "rank", "text", "source", (F.col("page") if "page" in docs.columns else F.lit(None).cast("int")).alias("page")), "hits")
        if s.rerank and self.hooks.judge is not None:
            asked = hits.join(queries.select("query_id", "query"), "query_id")
            hits = stage(search.rerank(asked, self.hooks.judge(F.col("query"), F.col("text")), ["query_id"], s.reranked).drop("query"), "reranked")
        facts, found = self.graph_arm(routed)
        # scores of ranks that were fused, made comparable with the graph's confidence
        sure = hits.groupBy("query_id").agg(F.least(F.lit(1.0), F.avg(F.col("score") * (search.RRF + 1))).alias("vector_confidence"), F.count("*").alias("n_hits"))
        w = routed.join(sure, "query_id", "left").join(facts, "query_id", "left").join(found.groupBy("query_id").agg(F.count("*").alias("n_found")), "query_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        w = w.withColumn("vc", F.coalesce("vector_confidence", F.lit(0.0))).withColumn("gc", F.coalesce("graph_confidence", F.lit(0.0)))
        both = ~F.col("skip_vector") & ~F.col("skip_graph")
        w = w.withColumn("f", routing.fallback(F.col("vector_weight"), F.col("graph_weight"), F.col("skip_vector"), F.col("skip_graph"), F.col("vc"), F.col("gc"), s.fallback_below))
        share = lambda arm: F.when(both, F.col(f"f.{arm}_weight")).otherwise(F.col(f"{arm}_weight"))
        w = w.withColumns({"wv": F.when(~F.col("skip_vector"), share("vector")).otherwise(0.0), "wg": F.when(~F.col("skip_graph"), share("graph")).otherwise(0.0)})
        # an arm that was forced on without weight takes part with what it has
        w = w.withColumn("wv", F.when((F.col("wv") + F.col("wg") == 0) & ~F.col("skip_vector"), 1.0).otherwise(F.col("wv")))
        cap = lambda n, weight: F.when((zero(F.col(n)) > 0) & (F.col(weight) > 0), search.arm_sizes(F.col(n), F.col(weight))).otherwise(0)
        w = stage(w.withColumns({"most_hits": cap("n_hits", "wv"), "most_found": cap("n_found", "wg")}), "weights")
        used = hits.join(w.select("query_id", "most_hits"), "query_id").where(F.col("rank") <= F.col("most_hits")).drop("most_hits")
        if s.compression:
            summary = self.hooks.summarise(F.col("text")) if self.hooks.summarise is not None else F.lit("")
            used = used.withColumn("text", search.compress(F.col("text"), summary)).where("text is not null")
        used = stage(used, "used")
        placed = search.lost_in_middle(used, "rank", ["query_id"]) if s.lost_in_middle else used.withColumn("place", F.col("rank"))
        t = placed.withColumn("t", cited_passage(F.col("place"), F.col("text"), F.col("source"), F.col("page")))
        parts = t.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]).alias("p"))
        fact = F.when((F.col("wg") > 0) & F.col("graph_context").isNotNull(), F.concat(F.lit("=== KNOWLEDGE GRAPH CONTEXT ===\n"), "graph_context"))
        join = lambda c: F.array_join(c, "\n\n")
        head = F.lit("=== DOCUMENT CONTEXT ===\n")
        n, half = F.size("p"), F.floor(F.size("p") / 2).cast("int")
        between = (F.col("wv") >= F.col("wg")) & (n > 2) & F.lit(s.lost_in_middle)
        context = (
            F.when(F.col("p").isNull() | (n < 1), fact)
            .when(fact.isNull(), F.concat(head, join(F.col("p"))))
            .when(between, F.concat(head, join(F.slice("p", F.lit(1), half)), F.lit("\n\n"), fact, F.lit("\n\n"), join(F.slice("p", half + 1, n))))
            .otherwise(F.concat(fact, F.lit("\n\n"), head, join(F.col("p"))))
        )
        own = used.select("query_id", F.lit(1).alias("arm"), "rank", F.lit(0).alias("nth"), F.col("doc_id").cast("string").alias("chunk"))
        if self.node_chunks is not None:
            entity = found.join(w.select("query_id", "most_found"), "query_id").where(F.col("rank") <= F.col("most_found"))
            nth = F.row_number().over(Window.partitionBy("query_id", "node_id").orderBy("chunk_id"))
            ch = entity.join(self.node_chunks, "node_id").withColumn("nth", nth).where(F.col("nth") <= s.chunks_per_entity)
            ch = ch.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "nth"))).where(F.col("_n") <= s.chunks_from_graph)
            own = own.unionByName(ch.select("query_id", F.lit(0).alias("arm"), "rank", "nth", F.col("chunk_id").alias("chunk")))
        once = own.groupBy("query_id", "chunk").agg(F.min(F.struct("arm", "rank", "nth")).alias("o"))
        sources = once.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "chunk"))), lambda x: x["chunk"]).alias("sources"))
        score = routing.complexity(F.col("query"), F.col("query_type"), F.col("confidence"), F.col("n_entities"))
        out = w.join(parts, "query_id", "left").join(sources, "query_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
        sure_of = search.answer_confidence(F.col("vc"), F.col("gc"), F.col("wv"), F.col("wg"), F.size("sources").cast("double"))
        return out.select(
            "query_id", "query_type", routing.path_of(score["score"], s.top_k)["path"].alias("path"), F.col("wv").alias("vector_weight"), F.col("wg").alias("graph_weight"), sure_of.alias("confidence"), context.alias("context"), "sources", F.size("sources").alias("n_sources")
        )

    def query(self, queries: DataFrame) -> DataFrame:
        """(query_id, query_type, path, context, n_sources): the fused context of each query (:meth:`retrieve`)."""
        return self.retrieve(queries).select("query_id", "query_type", "path", "context", "n_sources")

    def ask(self, question: str) -> DataFrame:
        return self.query(self.spark.createDataFrame([("q", question)], "query_id string, query string"))

    def search_graph(self, question: str) -> DataFrame:
        """Relation between two named entities, else communities for a global question, else entities and their surroundings."""
        q = self.spark.createDataFrame([("q", question)], "query_id string, query string")
        asked = q.select(routing.relation_question(F.col("query")).alias("r"), routing.is_global(F.col("query")).alias("g")).first()
        if asked["r"]["source"] and self.nodes is not None:
            found = graph.retrieve_by_relationship(self.edges, self.nodes, asked["r"]["source"], asked["r"]["target"].rstrip("?.! "))
            if not found.isEmpty():
                return found
        if asked["g"] and self.communities is not None:
            return graph.rank_communities(self.communities, question, self.settings.communities)
        return self.facts(q)

    def aggregate(self, op: str, **what) -> DataFrame:
        return graph.aggregate(self.nodes, op, **what)

    def exhaustive(self, question: str) -> DataFrame:
        return search.exhaustive(self.documents, question)

    def info(self) -> dict[str, int]:
        """Numbers of documents, sources, nodes and edges."""
        d = self.documents.agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("documents")).first().asDict()
        for name in ("nodes", "edges", "communities"):
            df = getattr(self, name)
            d[name] = df.count() if df is not None else 0
        return d

    def with_graph(self, extraction: DataFrame) -> Engine:
        """The engine with the graph of extracted entities and relations, and its communities."""
        ch = graph.chunks_once(extraction)
        em = graph.entity_mentions(ch)
        rm = graph.relation_mentions(ch, em)
        em, rm = stage(em, "mentions"), stage(rm, "relations")
        self.nodes, self.edges, self.node_chunks = stage(graph.build_nodes(em), "nodes"), stage(graph.build_edges(rm), "edges"), stage(graph.node_chunks(em), "node-chunks")
        size = graph.louvain(self.edges, self.settings.resolution).groupBy("community").agg(F.count("*").alias("n"))
        self.communities = size.select(F.col("community").alias("id"), graph.default_summary(F.col("n")).alias("summary"))
        return self

    def resolved(self, vectors: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
        return resolve(nodes, self.edges, vectors, self.settings.same_entity_similarity, self.hooks.same_entity)

    def refresh(self, manifest: DataFrame, current: DataFrame) -> DataFrame:
        """Changes since a manifest; the index is built anew on its next use."""
        self._index = None
        return state.manifest_diff(manifest, current)


#: Tools by name: what an agent may call, on an engine with keyword arguments.
TOOLS = {
    "retrieve_vector": lambda e, query, **_: e.passages(e.spark.createDataFrame([("q", query)], "query_id string, query string")),
    "retrieve_graph": lambda e, query, **_: e.search_graph(query),
    "lookup_entity": lambda e, entity_name, **_: graph.lookup(e.nodes, entity_name),
    "compare_entities": lambda e, entity_a, entity_b, **_: graph.lookup(e.nodes, entity_a).unionByName(graph.lookup(e.nodes, entity_b)),
    "database_stats": lambda e, **_: e.spark.createDataFrame([{"name": k, "value": int(v)} for k, v in e.info().items()], "name string, value long"),
    "exhaustive_search": lambda e, query, **_: e.exhaustive(query),
    "aggregate_graph": lambda e, operation, **kw: e.aggregate(operation, type_=kw.get("entity_type"), attribute=kw.get("attribute"), value=kw.get("attribute_value")),
}
#: Tools that need a model: they only end or redirect the agent's loop.
MODEL_TOOLS = ("synthesize", "verify_claim", "ask_clarification", "final_answer")
