"""Places for models: each is a column function with a deterministic default, so a pipeline runs without any."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions import routing
from docmill.functions.text import tokens
from docmill.operators import resolution

DIMENSION = 256


def hash_embedder(dimension: int = DIMENSION) -> Callable[[Column], Column]:
    """Vectors of hashed words with random signs, of length 1; null and wordless texts give null, in their place."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dimension, np.float32)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dimension] += 1.0 if h >> 31 else -1.0
            n = float(np.linalg.norm(v))
            out.append((v / n).tolist() if n else None)
        return pd.Series(out)

    return embed


def with_instruction(query: Column, instruction: str = "Represent this question for retrieving passages: ") -> Column:
    return F.concat(F.lit(instruction), query)


def echo(prompt: Column) -> Column:
    """Stands in for a model that answers a prompt."""
    return prompt


def dictionary_entities(text: Column, names: list[str]) -> Column:
    """Entities of a text that a list names: its word sequences are looked up in one map."""
    by = {" ".join(re.findall(r"\w+", n.lower())): n for n in sorted(names, reverse=True)}
    by.pop("", None)
    if not by:
        return F.array().cast("array<string>")
    lookup = F.create_map(*(F.lit(x) for kv in by.items() for x in kv))
    w, most = tokens(text), max(len(k.split()) for k in by)
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(w, lambda x, i: F.array_join(F.slice(w, i + 1, n), " "))))
    return F.filter(F.transform(F.array_distinct(grams), lambda g: F.try_element_at(lookup, g)), lambda x: x.isNotNull())


@dataclass(frozen=True)
class Hooks:
    """What a pipeline calls; replace any field to plug a model in."""

    embed: Callable[[Column], Column] | None = None
    complete: Callable[[Column], Column] = echo
    classify: Callable[[Column], Column] = routing.classify
    rewrite: Callable[[Column], Column] = echo
    same_entity: Callable[..., Column] = resolution.same_by_rule
    judge: Callable[[Column, Column], Column] | None = None  # of query and passage: an answer with yes or no
    summarise: Callable[[Column], Column] | None = None

    def embedder(self) -> Callable[[Column], Column]:
        return self.embed or hash_embedder()
