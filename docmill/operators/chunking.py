"""Chunkers: one text in, many chunks out."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.similarity import cosine
from docmill.functions.text import clean_up, strip, words


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words, each ``size - overlap`` after the one before, up to the one that reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    w, stride = words(text), size - overlap
    n = F.size(w)
    last = F.ceil(F.greatest(n - size, F.lit(0)) / stride).cast("int")
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * stride + 1, size), " "))
    return F.when(n > 0, made).otherwise(F.array().cast("array<string>"))


def words_within(tokens: int) -> int:
    """The most words whose estimated token count stays within ``tokens``."""
    return (10 * (tokens + 1) - 1) // 13


def hard_split(text: Column, max_tokens: int, overlap: int | None = None) -> Column:
    """Greedy chunks of at most ``max_tokens`` estimated tokens; each begins with the last ``overlap`` words of the one before.

    The estimate grows with the number of words alone, so greedy filling is the
    same as windows of a fixed number of words.
    """
    size = max(1, words_within(max_tokens))
    carry = max(1, int(max_tokens * 0.1)) if overlap is None else overlap
    return windows(text, size, min(carry, size - 1))


def sentences(text: Column, pattern: str = r"\n\n\n", long_text: int = 200) -> Column:
    """Non-empty parts between ``pattern``; a long text without one is cut after sentence ends."""
    cut = lambda p: F.filter(F.transform(F.split(text, p), strip), lambda x: x != "")
    parts = cut(pattern)
    return F.when((F.size(parts) <= 1) & (F.length(text) > long_text), cut(r"(?<=[.!?])\s+")).otherwise(parts)


def sentence_groups(parts: Column, buffer: int = 5) -> Column:
    """Each sentence with ``buffer`` neighbours on either side, joined by blanks."""
    n = F.size(parts)
    made = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.array_join(F.slice(parts, F.greatest(F.lit(1), i - buffer), F.least(n, i + buffer) - F.greatest(F.lit(1), i - buffer) + 1), " "),
    )
    return F.when(n > 0, made).otherwise(F.array().cast("array<string>"))


def adjacent_similarity(df: DataFrame, doc: str, pos: str, vec: str) -> DataFrame:
    """(``doc``, ``pos``, similarity) of each vector with the next one of its document; the last has none."""
    nxt = F.lead(vec).over(Window.partitionBy(doc).orderBy(pos))
    return df.withColumn("_next", nxt).where("_next is not null").select(doc, pos, cosine(F.col(vec), F.col("_next")).alias("similarity"))


def breakpoints(similar: DataFrame, doc: str, pos: str, amount: float = 0.95, method: str = "percentile") -> DataFrame:
    """(``doc``, ``pos``) after which a chunk ends: similarity strictly below the document's threshold.

    percentile: the (1 - amount) quantile, interpolated; deviation: mean less ``amount`` population deviations.
    """
    limit = F.percentile("similarity", 1 - amount) if method == "percentile" else F.avg("similarity") - amount * F.stddev_pop("similarity")
    limits = similar.groupBy(doc).agg(limit.alias("limit"))
    return similar.join(limits, doc).where(F.col("similarity") < F.col("limit")).select(doc, pos)


def semantic_chunks(parts: DataFrame, doc: str, pos: str, text: str, vec: str, amount: float = 0.95, method: str = "percentile") -> DataFrame:
    """(``doc``, chunk, text): sentences joined up to each breakpoint, chunks numbered from 0."""
    ends = breakpoints(adjacent_similarity(parts, doc, pos, vec), doc, pos, amount, method).withColumn("_end", F.lit(1))
    marked = parts.join(ends, [doc, pos], "left")
    before = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    numbered = marked.withColumn("chunk", F.coalesce(F.sum("_end").over(before), F.lit(0)).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda s: s[text]), " ")
    return numbered.groupBy(doc, "chunk").agg(joined.alias("text"))


def parents_and_children(df: DataFrame, name: str, text: str, parent_tokens: int = 512, child_tokens: int | None = None) -> DataFrame:
    """(parent_id, child_id, parent_text, child_text) with ids that carry the lineage.

    Parents are cut without overlap beyond the default, children out of parents.
    """
    child_tokens = child_tokens or max(1, parent_tokens // 8)
    p = df.select(name, F.posexplode(hard_split(F.col(text), parent_tokens)).alias("i", "parent_text"))
    p = p.withColumn("parent_id", F.format_string("%s_parent_chunk_%d", F.col(name), F.col("i") + 1))
    c = p.select("parent_id", "parent_text", F.posexplode(hard_split(F.col("parent_text"), child_tokens)).alias("j", "child_text"))
    return c.select("parent_id", F.format_string("%s_child_chunk_%d", F.col("parent_id"), F.col("j") + 1).alias("child_id"), "parent_text", "child_text")


def description_chunks(df: DataFrame, name: str, text: str, max_tokens: int = 512) -> DataFrame:
    """(chunk_id, text) of descriptions, cleaned and cut."""
    c = df.select(name, F.posexplode(hard_split(clean_up(F.col(text)), max_tokens)).alias("i", "chunk"))
    return c.select(F.format_string("%s_chunk_%d", F.col(name), F.col("i") + 1).alias("chunk_id"), F.col("chunk").alias("text"))


def estimated_tokens(text: str) -> int:
    return len(text.split()) * 13 // 10


def table_chunks(table: str, max_tokens: int = 512, overlap_share: float = 0.25, columns: list[str] | None = None) -> list[str]:
    """A Markdown table cut by rows within ``max_tokens``, its header on each chunk.

    The last rows of a chunk that fit into the overlap begin the next one. Lines
    that aren't table rows are left out; ``columns`` replace the header's names.
    """
    lines = [x.strip() for x in table.splitlines() if x.strip().startswith("|")]
    if not lines:
        return []
    head = "| " + " | ".join(columns) + " |" if columns else lines[0]
    ruled = len(lines) > 1 and set(lines[1]) <= set("|-: \t")
    rule = lines[1] if ruled and not columns else "|" + "---|" * (len(columns) if columns else max(1, head.count("|") - 1))
    rows = lines[2:] if ruled else lines[1:]
    fixed = estimated_tokens(head) + estimated_tokens(rule)
    budget, chunks, own, used = math.floor(max_tokens * overlap_share), [], [], fixed
    for r in rows:
        n = estimated_tokens(r)
        if own and used + n > max_tokens:
            chunks.append("\n".join([head, rule, *own]))
            kept, left = [], budget
            for x in reversed(own):
                left -= estimated_tokens(x)
                if left < 0:
                    break
                kept.insert(0, x)
            own = kept if fixed + sum(map(estimated_tokens, kept)) + n <= max_tokens else []
            used = fixed + sum(map(estimated_tokens, own))
        own.append(r)
        used += n
    if own or not rows:
        chunks.append("\n".join([head, rule, *own]))
    return chunks


def split_tables(df: DataFrame, id_col: str, table_col: str, max_tokens: int = 512, overlap_share: float = 0.25) -> DataFrame:
    """(id, chunk, text) of Markdown tables."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(i, k, c) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, c in enumerate(table_chunks(t or "", max_tokens, overlap_share))]
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["id", "chunk", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(table_col).alias("t")).mapInArrow(run, f"id {kind}, chunk int, text string").withColumnRenamed("id", id_col)


def semantic_split(text: str, max_tokens: int, embed, pattern: str = r"(?<=[.!?])\s+", amount: float = 0.95, buffer: int = 5) -> list[str]:
    """Chunks within ``max_tokens``: cut at the least similar neighbours again and again, then by words.

    ``embed`` maps a list of texts to vectors. A part that a cut leaves unchanged
    is cut by words with a tenth of overlap.
    """
    import re

    import numpy as np

    done, queue = [], [text]
    while queue:
        part = queue.pop(0)
        if estimated_tokens(part) <= max_tokens:
            if part.strip():
                done.append(part)
            continue
        own = [s for s in re.split(pattern, part) if s.strip()]
        pieces = [part]
        if len(own) > 1:
            v = np.asarray(embed([" ".join(own[max(0, i - buffer) : i + buffer + 1]) for i in range(len(own))]), float)
            norm = np.linalg.norm(v, axis=1)
            sim = (v[1:] * v[:-1]).sum(1) / np.maximum(norm[1:] * norm[:-1], 1e-12)
            ends = np.flatnonzero(sim < np.percentile(sim, (1 - amount) * 100)) + 1
            pieces = [" ".join(x) for x in np.split(np.array(own, object), ends) if len(x)]
        if len(pieces) > 1:
            queue[:0] = pieces
        else:
            w, size = part.split(), max(1, words_within(max_tokens))
            step = size - min(max(1, int(max_tokens * 0.1)), size - 1)
            done.extend(" ".join(w[i : i + size]) for i in range(0, max(1, len(w) - size + step), step))
    return done


def distributed_pages(n_pages: Column, most: int) -> Column:
    """Pages to read of a long document: 40 % from its beginning, 30 % from its middle, 30 % from its end."""
    head = F.ceil(F.lit(most * 0.4)).cast("int")
    tail = F.floor(F.lit(most * 0.3)).cast("int")
    mid = most - head - tail
    start = F.floor((n_pages - mid) / 2).cast("int")
    span = lambda a, n: F.when(n > 0, F.sequence(a, a + n - 1)).otherwise(F.array().cast("array<int>"))
    picked = F.array_sort(F.array_distinct(F.concat(span(F.lit(1), head), span(start + 1, mid), span(n_pages - tail + 1, tail))))
    return F.when(n_pages <= most, F.when(n_pages > 0, F.sequence(F.lit(1), n_pages)).otherwise(F.array().cast("array<int>"))).otherwise(picked)


def group_boxes(boxes: list[dict]) -> list[dict]:
    """Layout boxes of a page, each table or picture joined with captions and texts that follow it or overlap it in height.

    Boxes are {x1, y1, x2, y2, label}; the result is in order of (y1, x1), with
    the union box and the labels that went into it.
    """
    order = sorted(boxes, key=lambda b: (b["y1"], b["x1"]))
    used, out = set(), []
    for i, b in enumerate(order):
        if i in used:
            continue
        group = [b]
        used.add(i)
        if b["label"] in ("Table", "Picture"):
            for j, c in enumerate(order):
                if j in used or c["label"] not in ("Caption", "Text"):
                    continue
                if abs(j - i) == 1 or min(b["y2"], c["y2"]) - max(b["y1"], c["y1"]) > 0:
                    group.append(c)
                    used.add(j)
        out.append({
            "x1": min(g["x1"] for g in group), "y1": min(g["y1"] for g in group), "x2": max(g["x2"] for g in group), "y2": max(g["y2"] for g in group),
            "label": b["label"], "parts": [g["label"] for g in group],
        })
    return out
