"""Files in, tables out, and the sinks: vectors, postings, graphs, exports, versioned copies."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.functions.text import html_to_plain, markdown_to_plain
from docmill.operators.search import Index

# File extensions by kind.
OFFICE = ("doc", "docx", "ppt", "pptx", "xls", "xlsx", "odt", "odp", "ods", "rtf")
HTML, TEXT, MARKDOWN = ("html", "htm"), ("txt",), ("md", "markdown")
IMAGES = ("jpg", "jpeg", "png", "bmp", "tiff", "gif")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind_of(path: Column) -> Column:
    """pdf, office, html, text, markdown, image or other."""
    e = extension(path)
    return (
        F.when(e == "pdf", "pdf").when(e.isin(*OFFICE), "office").when(e.isin(*HTML), "html").when(e.isin(*TEXT), "text").when(e.isin(*MARKDOWN), "markdown").when(e.isin(*IMAGES), "image").otherwise("other")
    )


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, stem, size, mtime, kind): all files below the paths; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return f.select("path", stem.alias("stem"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), kind_of(F.col("path")).alias("kind"))


def with_hash(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content_hash) of files, their contents read once."""
    f = spark.read.format("binaryFile").load(paths)
    return f.select("path", F.sha2("content", 256).alias("content_hash"))


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of HTML, Markdown and plain files below the paths, as plain text."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", F.col("content").cast("string").alias("raw"))
    kind = kind_of(F.col("path"))
    text = F.when(kind == "html", html_to_plain(F.col("raw"))).when(kind == "markdown", markdown_to_plain(F.col("raw"))).otherwise(F.col("raw"))
    return f.where(kind.isin("html", "markdown", "text")).select("path", text.alias("text"))


def count_by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"))


def explode_pages(df: DataFrame, render, schema: str) -> DataFrame:
    """Connector for page rendering and layout models: ``render`` maps an iterator of pandas frames to page rows."""
    return df.mapInPandas(render, schema)


def collect_chunks(texts: DataFrame, least_words: int = 3) -> DataFrame:
    """Chunk rows (name, text) that are to be embedded: no parents, ``least_words`` words at least."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    only_parent = F.col("name").contains("_parent_chunk_") & ~F.col("name").contains("_child_chunk_")
    return texts.where(~only_parent & (n >= least_words))


def with_parents(vectors: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """(chunk_id, parent_id, vec, text, parent_text): vectors with their chunk and its parent, each parent once."""
    p = parents.groupBy("parent_id").agg(F.min("parent_text").alias("parent_text"))
    return vectors.join(children, "chunk_id").join(p, "parent_id", "left")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_vectors(df: DataFrame, path: str, by: str = "model") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_index(index: Index, path: str, buckets: int = 64) -> None:
    """Postings laid out by term, so that a query reads few files."""
    index.postings.repartition(buckets, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.totals.write.mode("overwrite").parquet(f"{path}/totals")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "totals")))


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, names: tuple[str, ...] = ("nodes", "edges", "node_chunks", "edge_chunks")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def is_valid_graph(tables: dict[str, DataFrame]) -> bool:
    return "nodes" in tables and not tables["nodes"].isEmpty()


def node_link_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): a graph as one JSON text per node and link."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    return n.unionByName(edges.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), *[c for c in edges.columns if c not in ("src", "dst")])).alias("json")))


def read_node_link(lines: DataFrame, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (source and target as src and dst) of :func:`node_link_lines`."""
    n = lines.where("kind = 'node'").select(F.from_json("json", node_schema).alias("x")).select("x.*")
    e = lines.where("kind = 'link'").select(F.from_json("json", edge_schema.replace("src ", "source ", 1).replace("dst ", "target ", 1)).alias("x")).select("x.*")
    return n, e.withColumnRenamed("source", "src").withColumnRenamed("target", "dst")


def dry_run(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(what, key, n): files by extension, and changes against a manifest."""
    from docmill.operators.state import manifest_diff

    a = count_by_extension(files).select(F.lit("extension").alias("what"), F.col("extension").alias("key"), F.col("files").alias("n"))
    c = manifest_diff(manifest, files).groupBy("change").agg(F.count("*").alias("n"))
    return a.unionByName(c.select(F.lit("change").alias("what"), F.col("change").alias("key"), "n"))


def backup(tables: dict[str, DataFrame], root: str, now: datetime | None = None) -> str:
    """Write a copy under a name of its time, and return its path."""
    path = f"{root}/{(now or datetime.now(timezone.utc)).strftime('%Y%m%dT%H%M%S%f')}"
    write_graph(tables, path)
    return path


def list_backups(spark: SparkSession, root: str) -> list[str]:
    """Paths of the copies, newest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return sorted((s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()), reverse=True)


def keep_backups(spark: SparkSession, root: str, most: int = 5) -> list[str]:
    """Delete all but the newest ``most`` copies; returns what was deleted."""
    gone = list_backups(spark, root)[most:]
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return gone


def newest(log: DataFrame, most: int = 50, time: str = "finished_at") -> DataFrame:
    """The last runs of an append-only log."""
    return log.orderBy(F.desc(time)).limit(most)


def metrics_csv(metrics: DataFrame, path: str) -> None:
    """All rows, newest first, as CSV with a header."""
    metrics.orderBy(F.desc("timestamp"), F.desc("id")).write.mode("overwrite").option("header", "true").csv(path)


def metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.orderBy(F.desc("timestamp"), F.desc("id")).write.mode("overwrite").json(path)


def date_of(chunks: DataFrame, dates: DataFrame) -> DataFrame:
    """Chunks (document, …) with file_date of ``dates(stem, mtime)``, by document name or its encoded form."""
    d = dates.groupBy("stem").agg(F.max("mtime").alias("mtime"))
    a = chunks.join(d.withColumnsRenamed({"stem": "document", "mtime": "_a"}), "document", "left")
    b = a.withColumn("_e", F.replace("document", F.lit("/"), F.lit("__"))).join(d.withColumnsRenamed({"stem": "_e", "mtime": "_b"}), "_e", "left")
    return b.withColumn("file_date", F.coalesce("_a", "_b")).drop("_a", "_b", "_e")


def pages_of(cited: DataFrame) -> DataFrame:
    """(document, first, pages): of cited (rank, document, page) each document's sorted pages, in order of first citation."""
    page = F.regexp_extract(F.col("page").cast("string"), r"(\d+)", 1).try_cast("int")
    return cited.groupBy("document").agg(F.min("rank").alias("first"), F.array_sort(F.collect_set(page)).alias("pages"))


def documents_once(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, in order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_n", nth).where("_n = 1").drop("_n")
