"""Problem 4: one surviving record for each group of duplicates, field by field.

Every member offers a candidate for each field: a vector of qualities (how
complete, how trustworthy, how well supported, how recent). Candidates that another one of
the group equals or beats in everything and beats in something are dominated;
those left are the skyline, from which a lexicographic order of the qualities
takes one. Members without a usable value lie behind every other layer. What
is null in the best record is filled from the first of the successive layers
(skylines of what the layers before leave) that has a value, field by field.
Candidates of equal quality are reduced to one before any group is gathered, and
the skyline is first taken within salted parts of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.scratch import stage

#: Texts that stand for a missing value.
PLACEHOLDERS = (
    r"[\p{P}\p{S}\s]*",
    r"[\[(<]?\s*(n/?a|none|null|nil|nan|unknown|undefined|empty|missing|blank|tbd|tba|todo|pending|entity|node|item|object|name|description|unnamed|untitled|placeholder|not (available|applicable|specified|known|found|provided)|see above|see below|as above|ditto|to be (done|added|defined|determined))\s*[\])>]?\.?",
    r"(description|name|value|text|summary|content) (is )?(pending|missing|unknown|unavailable|not available|to follow|tbd)\.?",
    r"no (description|name|value|text|summary|content|information|data)( is)?( available| provided| found| given)?\.?",
)
#: What failed extraction leaves behind.
RESIDUE = (
    r"^\s*(```|~~~|[{\[]|<[a-z!/])",
    r"^\s*(error|exception|warning|fatal)\b\s*[:\-–]",
    r"traceback \(most recent call last\)",
    r"could not be parsed|failed to parse|parse error|jsondecodeerror|model output",
    r"^\s*(i'm sorry|i am sorry|sorry|i apologi[sz]e|i cannot|i can't|as an ai)\b",
    r"(provided|given) (context|text|document)s? (does|do) not contain",
    r"\"(name|type|entities|description)\"\s*:",
)
#: Small words that a regular name may have in lower case.
JOINING = "of|and|the|for|in|on|de|du|des|la|le|les|der|die|das|und|von|del|y|e|di|et"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^[\s​﻿]+|[\s​﻿]+$", "")


def usable(c: Column) -> Column:
    """Neither missing, nor a placeholder, nor residue of a failed extraction."""
    low = F.lower(trimmed(c))
    ok = ~low.rlike("(?s)^(" + "|".join(PLACEHOLDERS) + ")$")
    for r in RESIDUE:
        ok = ok & ~low.rlike("(?s)" + r)
    return ok


def regular(name: Column) -> Column:
    """Written as names are: words with a capital first, single spaces, no marks, digits, abbreviations or article."""
    return name.rlike(rf"^(?!The )\p{{Lu}}[\p{{L}}'’-]*\p{{Ll}}[\p{{L}}'’-]*( (\p{{Lu}}[\p{{L}}'’-]*\p{{Ll}}[\p{{L}}'’-]*|&|{JOINING}))*$")


def word_plausibility(names: DataFrame) -> DataFrame:
    """(w, lm): of each word in ``names(name)``, the binary order of magnitude of its rarest letter triple over all names."""
    words = names.select(F.explode(F.split(F.lower("name"), r"\s+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit("<"), "w", F.lit(">"))
    triples = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("w"))), lambda i: F.substring(padded, i, F.lit(3))))
    each = words.select("w", "n", F.explode(triples).alias("t"))
    rate = each.groupBy("t").agg(F.floor(F.log2(F.sum("n"))).cast("long").alias("rate"))
    return each.join(rate, "t").groupBy("w").agg(F.min("rate").alias("lm"))


def latest_times(nodes: DataFrame, extraction: DataFrame) -> DataFrame:
    """(node_id, recency): epoch seconds of the last extraction among the source chunks of each node that has one."""
    at = extraction.where("chunk_id is not null").groupBy("chunk_id").agg(F.max("extracted_at").alias("at"))
    own = nodes.select(F.col("id").alias("node_id"), F.explode(F.array_distinct("source_chunks")).alias("chunk_id"))
    return own.join(at, "chunk_id").groupBy("node_id").agg(F.unix_timestamp(F.max("at").cast("timestamp")).alias("recency"))


def members(groups: DataFrame, nodes: DataFrame, extraction: DataFrame | None = None) -> DataFrame:
    """(group_id, node_id, name, description, support, recency): each member once, with its distinct non-blank source chunks.

    ``recency`` is 0 without ``extraction`` and for nodes without a known chunk.
    """
    chunks = F.size(F.array_distinct(F.filter(F.transform(F.coalesce("source_chunks", F.array().cast("array<string>")), trimmed), lambda x: x != "")))
    own = nodes.select(F.col("id").alias("node_id"), "name", "description", chunks.alias("support"))
    once = groups.select("group_id", "node_id").where("group_id is not null and node_id is not null").distinct()
    m = once.join(own, "node_id")
    if extraction is None:
        return m.withColumn("recency", F.lit(0).cast("long"))
    return m.join(latest_times(nodes, extraction), "node_id", "left").withColumn("recency", F.coalesce("recency", F.lit(0).cast("long")))


def name_candidates(m: DataFrame) -> DataFrame:
    """Qualities of each usable name: regular and mentioned in full by the group's descriptions; words; spelling."""
    good = m.where(usable(F.col("name"))).select("group_id", "node_id", F.col("name"), "support", "recency")
    phrase = rf"\p{{Lu}}[\p{{L}}\p{{N}}'’-]*(?: (?:{JOINING}|&|\p{{Lu}}[\p{{L}}\p{{N}}'’-]*))*"
    said = m.where("description is not null").select("group_id", F.explode(F.array_distinct(F.regexp_extract_all("description", F.lit(phrase), F.lit(0)))).alias("name"))
    said = said.distinct().withColumn("mentioned", F.lit(1))
    # a misspelt word stands in few names of its group
    words = good.select("group_id", F.explode(F.array_distinct(F.split(F.lower("name"), r"\s+"))).alias("w"), "node_id")
    votes = words.groupBy("group_id", "w").agg(F.count("*").alias("n"))
    known = words.join(votes, ["group_id", "w"]).join(word_plausibility(good), "w")
    worst = known.groupBy("group_id", "node_id").agg(F.min("n").alias("votes"), F.min("lm").alias("lm"))
    scored = good.join(said, ["group_id", "name"], "left").join(worst, ["group_id", "node_id"])
    return scored.select(
        "group_id",
        F.lit("name").alias("field"),
        (regular(F.col("name")).cast("long") * 2 + F.coalesce("mentioned", F.lit(0))).alias("d1"),
        F.size(F.split("name", r"\s+")).cast("long").alias("d2"),
        (F.col("votes") * 64 + F.col("lm")).alias("d3"),
        "support",
        "recency",
        "node_id",
    )


def description_candidates(m: DataFrame) -> DataFrame:
    """Qualities of each usable description: distinct words; a finished last sentence; few words in all."""
    # a mark of the cut isn't part of the text
    whole = F.regexp_replace(F.col("description"), r"(?i)(\s*[\[(<]\s*(cut|truncated|more|continued|snip|\.\.\.|…)\s*[\])>]|\.\.\.+|…)\s*$", "")
    words = F.regexp_extract_all(F.lower(whole), F.lit(r"[\p{L}\p{N}'’]+"), F.lit(0))
    finished = trimmed(F.col("description")).rlike(r"(?<!\.\.)[.!?。][\"'”’»)\]]*$")
    good = m.where(usable(F.col("description"))).withColumn("w", words).withColumn("finished", finished)
    # the last word of an unfinished text may be a part of one, which would count as another word
    good = good.withColumn("w", F.when(F.col("finished"), F.col("w")).otherwise(F.slice("w", 1, F.greatest(F.lit(0), F.size("w") - 1))))
    return good.select(
        "group_id",
        F.lit("description").alias("field"),
        F.size(F.array_distinct("w")).cast("long").alias("d1"),
        F.col("finished").cast("long").alias("d2"),
        (-F.size("w")).cast("long").alias("d3"),
        "support",
        "recency",
        "node_id",
    )


_DIMS = ("d1", "d2", "d3", "support", "recency")


def _undominated(parts: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by``, the candidates that no other dominates."""
    item = F.struct(*_DIMS, "node_id")
    packed = parts.groupBy(*by).agg(F.collect_list(item).alias("all"))

    def beats(y, x):
        no_worse, better = F.lit(True), F.lit(False)
        for d in _DIMS:
            no_worse, better = no_worse & (y[d] >= x[d]), better | (y[d] > x[d])
        return no_worse & better

    kept = F.filter("all", lambda x: ~F.exists("all", lambda y: beats(y, x)))
    return packed.select(*by, F.explode(kept).alias("x")).select(*by, "x.*")


def skyline(candidates: DataFrame, salts: int = 16) -> DataFrame:
    """The undominated candidates (group_id, field, d1, d2, d3, support, recency, node_id).

    Of candidates that agree in d1, d2, d3 and recency only the best supported is
    kept beforehand (of several the one with the smallest id), so what is gathered
    per group is bounded by the number of different qualities.
    """
    best = candidates.groupBy("group_id", "field", "d1", "d2", "d3", "recency").agg(F.min(F.struct((-F.col("support")).alias("m"), "node_id")).alias("b"))
    slim = best.select("group_id", "field", "d1", "d2", "d3", "recency", (-F.col("b.m")).alias("support"), F.col("b.node_id").alias("node_id"))
    salted = slim.withColumn("salt", F.pmod(F.xxhash64("d1", "d2"), F.lit(salts)))
    return _undominated(_undominated(salted, ["group_id", "field", "salt"]).drop("salt"), ["group_id", "field"])


def choose(front: DataFrame) -> DataFrame:
    """(group_id, field, node_id): of each skyline the first by d1, d2, d3, support and recency, then the smallest id."""
    key = F.struct((-F.col("d1")).alias("a"), (-F.col("d2")).alias("b"), (-F.col("d3")).alias("c"), (-F.col("support")).alias("d"), (-F.col("recency")).alias("e"), "node_id")
    return front.groupBy("group_id", "field").agg(F.min(key).alias("k")).select("group_id", "field", F.col("k.node_id").alias("node_id"))


def layers(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``layer``: 1 for the skyline of its group and field, 2 for that of the rest, and so on.

    What is gathered per group and field are its different qualities.
    """
    kind = candidates.schema["group_id"].dataType.simpleString()
    shape = f"group_id {kind}, field string, d1 long, d2 long, d3 long, support long, recency long"
    distinct = candidates.select("group_id", "field", *(F.col(d).cast("long").alias(d) for d in _DIMS)).distinct()

    def run(t: pa.Table) -> pa.Table:
        v = np.stack([t.column(d).to_numpy() for d in _DIMS], axis=1)
        layer = np.zeros(len(v), np.int32)
        # what dominates a candidate stands before it
        order = np.lexsort(-v.T[::-1])
        v = v[order]
        for i in range(len(v)):
            layer[i] = 1 + layer[:i][(v[:i] >= v[i]).all(1)].max(initial=0)
        return t.take(pa.array(order)).append_column("layer", pa.array(layer, pa.int32()))

    found = distinct.groupBy("group_id", "field").applyInArrow(run, shape + ", layer int")
    return candidates.join(found, ["group_id", "field", *_DIMS])


def filled(base: DataFrame, m: DataFrame, candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group_id, type, attributes, community_id) of each ``base(group_id, record)``.

    What is missing in the record (null, a blank type, no attributes) comes from
    the first layer that has a value: those of the names, then those of the
    descriptions of members without a usable name, then members with neither.
    Within a layer the order is that of :func:`choose`.
    """
    values = nodes.select(F.col("id").alias("node_id"), "type", "attributes", "community_id")
    there = {"type": trimmed(F.col("type")) != "", "attributes": F.size("attributes") > 0, "community_id": F.col("community_id").isNotNull()}
    own = base.select("group_id", F.col("record").alias("node_id")).join(values, "node_id")
    lack = own.where(~F.coalesce(there["type"] & there["attributes"] & there["community_id"], F.lit(False))).select("group_id")
    tier = F.when(F.col("field") == "name", 1).otherwise(2)
    place = F.struct(tier.alias("tier"), "layer", *((-F.col(d)).alias(d) for d in _DIMS))
    ranked = layers(candidates.join(lack, "group_id", "left_semi")).groupBy("group_id", "node_id").agg(F.min(place).alias("place"))
    last = F.struct(F.lit(3).alias("tier"), F.lit(1).alias("layer"), *(F.lit(0).cast("long").alias(d) for d in _DIMS[:3]), (-F.col("support")).cast("long").alias("support"), (-F.col("recency")).cast("long").alias("recency"))
    every = m.join(lack, "group_id", "left_semi").join(ranked, ["group_id", "node_id"], "left").join(values, "node_id")
    every = every.select("group_id", F.struct(F.coalesce("place", last).alias("place"), "node_id").alias("place"), *there)
    first = every.groupBy("group_id").agg(*(F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("place"))).alias(f"{c}_other") for c, ok in there.items()))
    return own.join(first, "group_id", "left").select("group_id", *(F.when(ok, F.col(c)).otherwise(F.coalesce(f"{c}_other", c)).alias(c) for c, ok in there.items()))


def best_values(groups: DataFrame, nodes: DataFrame, extraction: DataFrame | None = None) -> DataFrame:
    """(group_id, field, node_id): whose name and whose description survive.

    With ``extraction`` the time of a member's last source chunk is a quality too.

    A field that no member has a usable value for has no row. Repeated rows count
    once; members without a row in ``nodes``, null groups and null ids are left
    out; empty tables give an empty result.
    """
    m = stage(members(groups, nodes, extraction), "members")
    return choose(skyline(name_candidates(m).unionByName(description_candidates(m))))


def survivors(groups: DataFrame, nodes: DataFrame, extraction: DataFrame | None = None) -> DataFrame:
    """One record per group: name and description with the member each is from, the other fields of the best record.

    The best record is the one whose name survives, else the one whose
    description does; groups without any usable value keep their smallest id.
    Other fields that it lacks are :func:`filled` from further members.
    """
    m = stage(members(groups, nodes, extraction), "members")
    candidates = stage(name_candidates(m).unionByName(description_candidates(m)), "candidates")
    picks = stage(choose(skyline(candidates)), "picks")
    by = lambda f: picks.where(F.col("field") == f).select("group_id", F.col("node_id").alias(f"{f}_from"))
    every = groups.where("group_id is not null and node_id is not null").join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").groupBy("group_id").agg(F.min("node_id").alias("least"), F.countDistinct("node_id").alias("n_members"))
    base = every.join(by("name"), "group_id", "left").join(by("description"), "group_id", "left").withColumn("record", F.coalesce("name_from", "description_from", "least"))
    n1 = nodes.select(F.col("id").alias("name_from"), F.col("name"))
    n2 = nodes.select(F.col("id").alias("description_from"), "description")
    base = stage(base, "records")
    rest = filled(base, m, candidates, nodes)
    return base.join(n1, "name_from", "left").join(n2, "description_from", "left").join(rest, "group_id", "left").select(
        "group_id", F.col("record").alias("node_id"), "n_members", "name_from", "name", "description_from", "description", "type", "attributes", "community_id"
    )
