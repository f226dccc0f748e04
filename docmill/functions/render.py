"""Results as text: contexts, observations, citations; and measures of layouts and images."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import excerpt


def graph_context(entities: Column, relations: Column, paths: Column, topics: Column) -> Column:
    """Sections of 10 entities (name, type, description), 15 relations (src, rel, dst), 5 paths [(src, rel, dst)] and 3 topics; empty ones left out."""
    some = lambda c: c.isNotNull() & (F.size(c) > 0)
    lines = lambda c, n, f: F.array_join(F.transform(F.slice(c, 1, n), f), "\n")
    way = lambda p: F.concat(F.array_join(F.transform(p, lambda s: F.concat(s["src"], F.lit(" ["), s["rel"], F.lit("]"))), " → "), F.lit(" → "), F.element_at(p, -1)["dst"])
    numbered = F.array_join(F.transform(F.slice(paths, 1, 5), lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), way(p))), "\n")
    parts = [
        F.when(some(entities), F.concat(F.lit("RELEVANT ENTITIES:\n"), lines(entities, 10, lambda e: F.concat(F.lit("- "), e["name"], F.lit(" ("), e["type"], F.lit("): "), F.coalesce(e["description"], F.lit("")))))),
        F.when(some(relations), F.concat(F.lit("\nRELATIONSHIPS:\n"), lines(relations, 15, lambda r: F.concat(F.lit("- "), r["src"], F.lit(" "), r["rel"], F.lit(" "), r["dst"])))),
        F.when(some(paths), F.concat(F.lit("\nCONNECTION PATHS:\n"), numbered)),
        F.when(some(topics), F.concat(F.lit("\nRELATED TOPICS:\n"), lines(topics, 3, lambda t: F.concat(F.lit("- "), t)))),
    ]
    return F.concat_ws("\n", *parts)


def found_documents(texts: Column) -> Column:
    """Observation of a search: the number of hits and the first five, cut at 200 characters."""
    listed = F.array_join(F.transform(F.slice(texts, 1, 5), lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(t, 1, 200), F.lit("..."))), "\n")
    return F.when(F.size(texts) > 0, F.concat(F.lit("Found "), F.size(texts).cast("string"), F.lit(" relevant documents:\n"), listed)).otherwise("No relevant documents found.")


def cited_passage(rank: Column, text: Column, document: Column, page: Column) -> Column:
    """'[n] (Source: d, p.x)' above a passage."""
    where = F.concat(F.lit(" (Source: "), document, F.when(page.isNotNull(), F.concat(F.lit(", p."), page.cast("string"))).otherwise(""), F.lit(")"))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("]"), F.coalesce(where, F.lit("")), F.lit("\n"), text)


def claims(answer: Column) -> Column:
    """[(claim, supported, doc_idx, confidence)] of a verification answer; unreadable ones give an empty list."""
    braces = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    v = F.from_json(braces, "claims array<struct<claim string, supported boolean, doc_idx int, confidence double>>, overall_supported boolean, summary string")
    empty = F.array().cast("array<struct<claim string, supported boolean, doc_idx int, confidence double>>")
    return F.struct(F.coalesce(v["overall_supported"], F.lit(True)).alias("supported"), F.coalesce(v["claims"], empty).alias("claims"), F.coalesce(v["summary"], F.lit("Verification complete")).alias("summary"))


def overlaps_in_height(top_a: Column, bottom_a: Column, top_b: Column, bottom_b: Column) -> Column:
    return F.least(bottom_a, bottom_b) - F.greatest(top_a, top_b) > 0


@F.pandas_udf(T.BooleanType())
def is_relevant_image(content: pd.Series) -> pd.Series:
    """Whether an image has more than 1,000 pixels that aren't white, and colours that vary by 10 or more; unreadable ones don't."""
    try:
        from PIL import Image
    except ImportError:  # without an image library none can be judged
        return pd.Series([None] * len(content), dtype="object")
    out = []
    for b in content:
        try:
            img = Image.open(io.BytesIO(b))
            grey, rgb = np.asarray(img.convert("L")), np.asarray(img, float)
            out.append(bool((grey < 255).sum() > 1000 and rgb.reshape(-1, rgb.shape[-1] if rgb.ndim == 3 else 1).var(0).mean() >= 10))
        except Exception:
            out.append(False)
    return pd.Series(out)


def api_source(text: Column) -> Column:
    return excerpt(text, 500)
