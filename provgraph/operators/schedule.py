"""Priorities and execution order."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import has_type
from ..graph import ProvGraph
from ..plans import fixpoint
from . import metrics, traverse


def priorities(g: ProvGraph, temporal: bool = False, view: str = "doc") -> DataFrame:
    """(node_id, priority, ordinal): type weight + 2 per predecessor + 1 per successor, + 50 on a
    critical path (more than two successors within three hops); ``temporal`` adds a start-time term.
    """
    d = metrics.degree_centrality(g, view).select(F.col("node_id").alias("_n"), "in_degree", "out_degree")
    far = traverse.successors(g, max_depth=3, view=view).groupBy("start").agg(F.count("*").alias("near"))
    rows = g.nodes.join(d, F.col("node_id") == F.col("_n")).join(far, F.col("node_id") == F.col("start"), "left")
    base = F.when(has_type("MainActivity"), 100.0).when(has_type("SubActivity"), 50.0).when(has_type("StorageActivity"), 30.0).otherwise(10.0)
    value = base + 2.0 * F.col("in_degree") + 1.0 * F.col("out_degree") + F.when(F.coalesce("near", F.lit(0)) > 2, 50.0).otherwise(0.0)
    if temporal:
        slot = F.pmod(F.xxhash64(F.col("start_time").cast("string")), F.lit(1000))
        value = value + F.when(F.col("start_time").isNotNull(), 1000.0 / (1 + slot)).otherwise(0.0)
    return rows.select("node_id", value.alias("priority"), "ordinal")


def top_priorities(scores: DataFrame, count: int = 5, highest: bool = True) -> DataFrame:
    """The ``count`` highest or lowest, ties by arrival."""
    by = F.desc("priority") if highest else F.asc("priority")
    return scores.orderBy(by, "ordinal").limit(count).select("node_id", "priority")


def topological_levels(g: ProvGraph, view: str = "wrap") -> DataFrame:
    """(node_id, level): distributed peeling; nodes on or behind a cycle are not listed."""
    return fixpoint.levels(g.nodes.select(F.col("node_id").alias("node")), g.view(view).select("src", "dst")).withColumnRenamed("node", "node_id")


def execution_order(g: ProvGraph, scores: DataFrame | None = None, view: str = "doc") -> DataFrame:
    """(component, position, node_id): per weak component, Kahn's order with a priority queue.

    Of the nodes that may start, the one with the highest priority goes first, ties by falling id;
    nodes that become ready later rank by priority and then by the time they became ready. Components
    do not depend on each other, so each is ordered in its own group; one component is one task's
    work. Nodes on or behind a cycle are not listed.
    """
    scores = priorities(g, view=view) if scores is None else scores
    where = traverse.connected_components(g, view).withColumnRenamed("node_id", "_n")
    n = scores.select("node_id", "priority", "ordinal").join(where, F.col("node_id") == F.col("_n")).drop("_n")
    linked = g.adjacency(view)
    into = linked.groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("needs"))
    ends = linked.select(F.explode(F.array("src", "dst")).alias("end")).distinct()
    alone = n.join(ends, F.col("node_id") == F.col("end"), "left_anti").select("component", F.lit(0).cast("long").alias("position"), "node_id")
    n = n.join(ends, F.col("node_id") == F.col("end"), "left_semi")
    rows = n.join(into, F.col("node_id") == F.col("dst"), "left").select("component", "node_id", "priority", "ordinal", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))

    def order(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ordinal")
        missing, after, rank = {}, defaultdict(list), dict(zip(part["node_id"], part["priority"], strict=True))
        for node, needs in zip(part["node_id"], part["needs"], strict=True):
            missing[node] = len(needs)
            for other in needs:
                after[other].append(node)
        first = sorted((x for x in rank if not missing[x]), key=lambda x: (rank[x], x), reverse=True)
        queue = [(-rank[x], k, x) for k, x in enumerate(first)]
        heapq.heapify(queue)
        tick, out = len(queue), []
        while queue:
            node = heapq.heappop(queue)[2]
            out.append(node)
            for x in after[node]:
                missing[x] -= 1
                if not missing[x]:
                    heapq.heappush(queue, (-rank[x], tick, x))
                    tick += 1
        return pd.DataFrame({"component": part["component"].iloc[0], "position": range(len(out)), "node_id": out})

    return rows.groupBy("component").applyInPandas(order, "component string, position long, node_id string").unionByName(alone)


def priority_issues(g: ProvGraph, scores: DataFrame | None = None, view: str = "doc") -> DataFrame:
    """(issue, subject, n): zero and negative priorities, conflicts (more than three nodes in a bucket
    of ten from 50 on), and dependencies on a node of higher priority.
    """
    scores = priorities(g, view=view) if scores is None else scores
    p = scores.select("node_id", "priority")
    zero = p.filter("priority = 0").select(F.lit("zero_priority").alias("issue"), F.col("node_id").alias("subject"), F.lit(1).cast("long").alias("n"))
    negative = p.filter("priority < 0").select(F.lit("negative_priority"), "node_id", F.lit(1).cast("long"))
    bucket = (F.floor(F.col("priority") / 10) * 10).cast("long")
    conflict = p.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).filter("bucket >= 50 AND n > 3").select(F.lit("conflict"), F.col("bucket").cast("string"), "n")
    return zero.union(negative).union(conflict).union(violations(g, scores, view).select(F.lit("dependency_violation"), F.concat_ws(" -> ", "src", "dst"), F.lit(1).cast("long")))


def violations(g: ProvGraph, scores: DataFrame, view: str = "doc") -> DataFrame:
    """(src, dst): adjacency pairs whose predecessor has the higher priority."""
    p = scores.select("node_id", "priority")
    a = g.adjacency(view)
    a = a.join(p.select(F.col("node_id").alias("src"), F.col("priority").alias("p_src")), "src").join(p.select(F.col("node_id").alias("dst"), F.col("priority").alias("p_dst")), "dst")
    return a.filter("p_src > p_dst").select("src", "dst")
