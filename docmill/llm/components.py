"""Problem 7: one group identifier for all records that are linked, directly or through others.

Verdicts, merge histories and aliases are turned into edges, and these into
components on a two-dimensional grid (:mod:`docmill.operators.components`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.operators.components import connected_components
from docmill.scratch import stage


def node_links(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """Edges (a, b) between node ids, by verdict, merge history and alias.

    A pair's verdict is the last by ``decided_at`` in either order (a null time
    counts as the earliest; of several at the last time, one that isn't true
    wins); null is no link. An alias meets a name through a vertex of its own,
    named after the folded text, so a text that many nodes share gives as many
    edges as it has nodes, not as pairs. Blank texts meet nothing.
    """
    pair = matches.where("node_a is not null and node_b is not null and node_a <> node_b").select(
        F.least("node_a", "node_b").alias("a"),
        F.greatest("node_a", "node_b").alias("b"),
        F.col("decided_at").alias("at"),  # a null orders before every time
        F.when(F.col("same_entity"), 0).otherwise(1).alias("no"),
    )
    # of the verdicts at the last time, the largest "no" counts
    verdict = pair.groupBy("a", "b").agg(F.max(F.struct("at", "no")).alias("last")).where("last.no = 0").select("a", "b")
    merged = nodes.where("id is not null").select(F.col("id").alias("a"), F.explode("merged_from").alias("b")).where("b is not null")
    folded = lambda c: F.lower(F.regexp_replace(c, r"(?U)^[\s​﻿]+|[\s​﻿]+$", ""))
    aliases = nodes.where("id is not null").select("id", F.explode("aliases").alias("x")).select("id", folded(F.col("x")).alias("text"), F.lit(1).alias("is_alias"))
    names = nodes.where("id is not null").select("id", folded(F.col("name")).alias("text"), F.lit(0).alias("is_alias"))
    spelled = aliases.unionByName(names).where("text <> ''").distinct()
    both = spelled.groupBy("text").agg(F.min("is_alias").alias("lo"), F.max("is_alias").alias("hi")).where("lo = 0 and hi = 1").select("text")
    # the prefix keeps texts apart from ids
    met = spelled.join(both, "text").select(F.col("id").alias("a"), F.concat(F.lit("￿"), "text").alias("b"))
    return verdict.unionByName(merged).unionByName(met)


def node_groups(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """(node_id, group_id) for each row of ``nodes`` in a group of two rows or more.

    ``group_id`` is the smallest id of the group that has a row. Repeated rows of
    one id count once; rows with a null id belong to no group.
    """
    cc = stage(connected_components(node_links(nodes, matches)), "components")
    ids = nodes.where("id is not null").select(F.col("id").alias("v")).distinct()
    member = ids.join(cc, "v")
    group = member.groupBy("component").agg(F.min("v").alias("group_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return member.join(group, "component").select(F.col("v").alias("node_id"), "group_id")
