"""Loops to a fixed point: frontier joins, components, pointer doubling, peeling.

Every round writes what it found to the shared folder, so plans stay short and a lost executor
costs one round. Rounds stop when a round finds nothing new, which the driver sees as a row count.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize, sweep


#: So many links are joined on the driver (16 bytes each) at the end of ``contract``, where rounds cost more than work.
FEW = 100_000
#: So many steps are taken one by one in ``reach_counts``; for more, distances are doubled.
NEAR = 16


def reach(edges: DataFrame, starts: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth): what each start reaches along (src, dst); depth is the least number of steps.

    ``starts`` has ``node``; without it every source starts. A start is reached only if it lies on
    a cycle. From some starts, or to a depth, the frontier moves one step a round; from all starts
    without a bound, distances double each round.
    """
    edges = materialize(edges.select("src", "dst").filter("src <> dst").distinct(), "reach-edges")
    if starts is None and max_depth is None:
        return _closure(materialize(edges.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("depth")), "reach-1"))
    return reach_written(edges, starts, max_depth)


def reach_written(edges: DataFrame, starts: DataFrame | None, max_depth: int | None) -> DataFrame:
    """``reach`` step by step along a written table (src, dst), which may name an edge twice."""
    first = edges.select(F.col("src").alias("start"), F.col("dst").alias("node"))
    if starts is not None:
        first = first.join(starts.select(F.col("node").alias("start")).distinct(), "start", "left_semi").distinct()
    seen = frontier = materialize(first.withColumn("depth", F.lit(1)), "reach-1")
    depth = 1
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        step = frontier.join(edges, frontier.node == edges.src).select("start", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), f"reach-{depth}")
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = materialize(seen, "reach-seen")
    return seen


def _closure(seen: DataFrame) -> DataFrame:
    """All pairs from those one step apart.

    With all distances up to d known, a shortest way of d + 1 to 2d steps begins with one of
    exactly d; so pairs exactly d apart are joined with all known pairs. A closure of depth D
    takes log2(D) rounds.
    """
    d = 1
    while True:
        ahead = seen.select(F.col("start").alias("node"), F.col("node").alias("next"), F.col("depth").alias("more"))
        step = seen.filter(F.col("depth") == d).join(ahead, "node").groupBy("start", F.col("next").alias("node")).agg((F.min("more") + d).alias("depth"))
        new = materialize(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"), f"closure-{2 * d}")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
        d *= 2


def reach_counts(edges: DataFrame, itself: bool = True) -> DataFrame:
    """(start, n_reached, farthest, total): how many nodes each source reaches, and its greatest and total depth.

    From a node whose way never forks and ends, the way's length says all three, so its pairs are not listed: a chain
    of n nodes has n squared of them. Other starts list what they reach, step by step, or by doubling if that is far.
    A start that lies on a cycle counts as reached, unless ``itself`` is False.
    """
    edges = materialize(edges.select("src", "dst").filter("src <> dst"), "reach-edges")
    ways = materialize(edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("parent"), F.max("dst").alias("other")), "reach-ways")
    walked, endless = _walked(ways.filter("parent = other"))
    forks = ways.filter("parent <> other").select("node")
    ended = walked if endless is None else walked.join(endless, "node", "left_anti")
    plain = ended.join(forks.select(F.col("node").alias("last")), "last", "left_anti")
    plain = plain.select(F.col("node").alias("start"), F.col("steps").alias("n_reached"), F.col("steps").cast("int").alias("farthest"), F.expr("steps * (steps + 1) div 2").alias("total"))
    rest = forks.union(ended.join(forks.select(F.col("node").alias("last")), "last", "left_semi").select("node"))
    rest = materialize(rest if endless is None else rest.union(endless), "reach-rest")
    if rest.isEmpty():
        return plain
    seen = None if plain.isEmpty() else reach_written(edges, rest, NEAR)
    if seen is None or not seen.filter(F.col("depth") == NEAR).isEmpty():
        first = edges.distinct().select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("depth"))
        seen = _closure(materialize(first, "reach-1")).join(rest.select(F.col("node").alias("start")), "start", "left_semi")
    listed = (seen if itself else seen.filter("start <> node")).groupBy("start").agg(F.count("*").alias("n_reached"), F.max("depth").alias("farthest"), F.sum("depth").alias("total"))
    return plain.unionByName(listed)


def shortest_paths(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(start, node, path): all shortest paths from each start to each node it reaches, itself not."""
    edges = materialize(edges.select("src", "dst").filter("src <> dst").distinct(), "paths-edges")
    first = edges.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("path"))
    if starts is not None:
        first = first.join(starts.select(F.col("node").alias("start")).distinct(), "start", "left_semi")
    seen = frontier = materialize(first, "paths-1")
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier.node == edges.src).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        done = seen.select("start", "node").distinct()
        frontier = materialize(step.filter("start <> node").join(done, ["start", "node"], "left_anti"), "paths-next")
        seen = seen.unionByName(frontier)
    return seen


def shortest_counts(edges: DataFrame) -> DataFrame:
    """(start, node, depth, ways): distance and number of shortest paths, without listing them."""
    edges = materialize(edges.select("src", "dst").filter("src <> dst").distinct(), "count-edges")
    depth = 1
    seen = frontier = materialize(edges.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("depth"), F.lit(1.0).alias("ways")), "counts-1")
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(edges, frontier.node == edges.src).filter("start <> dst").groupBy("start", F.col("dst").alias("node")).agg(F.lit(depth).alias("depth"), F.sum("ways").alias("ways"))
        frontier = materialize(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "counts-next")
        seen = seen.unionByName(frontier)
    return seen


def contract(links: DataFrame) -> DataFrame | None:
    """(node, root) of every node of ``links`` (a, b), long numbers: one root per connected component; None without links.

    Each round gives all nodes new numbers by a hash of that round, which maps no two to one; every
    node moves to the least number among its neighbours' and its own. Links between nodes that moved
    apart go on, until none is left. Hashes differ from round to round, so a long chain shrinks by a
    constant factor each time. Numbers have a fixed width, so that a round sums up in hash tables
    instead of sorting. A round's tables go when the next is written.
    """
    links = materialize(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b"), "links")
    member = None
    turn = 0
    while (left := links.count()):
        if left <= FEW:
            parent = _joined(links)
            if member is not None:
                step = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
                parent = member.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            before, member = member, materialize(parent, "link-members")
            discard(before)
            break
        turn += 1

        def new(c: str) -> Column:
            return F.xxhash64(F.lit(turn), F.col(c))  # noqa: B023  a permutation of the long numbers

        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(new("b")).alias("least"))
        parent = materialize(least.select(F.col("a").alias("node"), F.least(new("a"), F.col("least")).alias("root")), "link-parents")
        before = member
        if before is None:
            member = parent
        else:
            step = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            member = materialize(before.join(step, "root", "left").select("node", F.coalesce("next", new("root")).alias("root")), "link-members")
        ends = [parent.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
        moved = links.join(ends[0], "a").join(ends[1], "b").filter("root_a <> root_b")
        apart = materialize(moved.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "links")
        discard(links, before, None if parent is member else parent)
        links = apart
    discard(links)
    return member


def _joined(links: DataFrame) -> DataFrame:
    """(node, root) of at most ``FEW`` links, joined on the driver; a root is one of the numbers."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for a, b in zip(*(c.to_pylist() for c in links.select("a", "b").toArrow().columns), strict=True):
        up[top(a)] = top(b)
    rows = pa.table({"node": pa.array(list(up), pa.int64()), "root": pa.array([top(x) for x in list(up)], pa.int64())})
    return links.sparkSession.createDataFrame(rows)


def number_of(node: Column | str, seed: int = 0) -> Column:
    """A long number for a node id: a hash, so ``numbered`` looks for ids that share one."""
    return F.xxhash64(F.lit(seed), node)


def numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(number, n_rows) per id of ``nodes`` (node), and a seed at which ``number_of`` tells all ids apart.

    Two ids under one number have different hashes of another seed, but with a chance of 2^-64; then
    the next seed is tried.
    """
    seed = 0
    while True:
        by = nodes.groupBy(number_of("node", seed).alias("number")).agg(F.count("*").alias("n_rows"), F.min(F.xxhash64("node", F.lit(seed))).alias("low"), F.max(F.xxhash64("node", F.lit(seed))).alias("high"))
        found = materialize(by.select("number", "n_rows", (F.col("low") != F.col("high")).alias("shared")), "numbers")
        if found.filter("shared").isEmpty():
            return found.select("number", "n_rows"), seed
        seed += 1


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): weakly connected, named by the least node; nodes without edges are their own."""
    ends = edges.select("src", "dst").filter("src <> dst")
    _, seed = numbered(nodes.select("node").union(ends.select(F.explode(F.array("src", "dst")))))
    member = contract(ends.select(number_of("src", seed).alias("a"), number_of("dst", seed).alias("b")))
    if member is None:
        return nodes.select("node", F.col("node").alias("component"))
    known = nodes.select("node", number_of("node", seed).alias("number"))
    placed = known.join(member.select(F.col("node").alias("number"), "root"), "number", "left")
    linked = ends.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    named = linked.join(member.select(F.col("node").alias("number"), "root"), number_of(linked.node, seed) == F.col("number")).groupBy(F.col("root").alias("_root")).agg(F.min("node").alias("component"))
    return placed.join(named, F.col("root") == F.col("_root"), "left").select("node", F.coalesce("component", "node").alias("component"))


def chase(parents: DataFrame) -> DataFrame:
    """(node, last, steps) for a table (node, parent) with one parent each: follow to the end.

    Pointer doubling: after round k a row knows what lies 2^k steps ahead. A walk that runs into
    a cycle ends before the first node that it would visit again.
    """
    jump, endless = _walked(parents)
    if endless is None:
        return jump
    return jump.join(endless, "node", "left_anti").select("node", "last", "steps").unionByName(_walk_into_cycles(parents, endless))


def _walked(parents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, last, steps) by pointer doubling, and the nodes whose walk has no end, if there are any.

    A round writes its table before it asks whether a row moved on, so that its join runs once.
    """
    jump = materialize(parents.select("node", F.col("parent").alias("last"), F.lit(1).cast("long").alias("steps")), "chase")
    limit = jump.count()
    far = F.col("steps") > limit
    while True:
        ahead = jump.select(F.col("node").alias("last"), F.col("last").alias("next"), F.col("steps").alias("more"))
        going = jump.filter(~far).select("node", "last", "steps").join(ahead, "last", "left")
        moved = going.select("node", F.coalesce("next", "last").alias("last"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved"))
        before, jump = jump, materialize(moved.union(jump.filter(far).select("node", "last", "steps", F.lit(False))), "chase")
        discard(before)
        sweep(jump.sparkSession)
        if jump.filter("moved").isEmpty():
            break
    endless = jump.filter(far).select("node")
    return jump.select("node", "last", "steps"), None if endless.isEmpty() else endless


def _walk_into_cycles(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """Step by step, each walk with its visited nodes; as many rounds as the longest walk has nodes."""
    parents = materialize(parents.select("node", "parent"), "walk-parents")
    walk = starts.select(F.col("node").alias("start"), F.col("node").alias("last"), F.array("node").alias("path"))
    done = None
    while True:
        ahead = walk.join(parents, walk.last == parents.node, "left").select("start", "last", "path", "parent")
        goes = F.col("parent").isNotNull() & ~F.coalesce(F.array_contains("path", F.col("parent")), F.lit(False))
        ahead = materialize(ahead.withColumn("goes", goes), "walk")
        ended = ahead.filter("NOT goes").select(F.col("start").alias("node"), "last", (F.size("path") - 1).cast("long").alias("steps"))
        done = ended if done is None else done.unionByName(ended)
        walk = ahead.filter("goes").select("start", F.col("parent").alias("last"), F.concat("path", F.array("parent")).alias("path"))
        if walk.isEmpty():
            return done


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): length of the longest way from a node without predecessor; nodes on or behind a
    cycle are left out.

    A node with one predecessor lies a known number of steps behind its nearest ancestor with
    none or several, which pointer doubling finds. Only those with several are settled in rounds,
    each when all its predecessors are.
    """
    edges = materialize(edges.select("src", "dst").filter("src <> dst").distinct(), "level-edges")
    degree = edges.groupBy(F.col("dst").alias("n")).agg(F.count("*").alias("needs"))
    many = materialize(degree.filter("needs > 1"), "level-joins")
    single = materialize(edges.join(degree.filter("needs = 1"), F.col("dst") == F.col("n"), "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("parent")), "level-chains")
    walked = chase(single).join(single.select(F.col("node").alias("last")), "last", "left_anti").select("node", F.col("last").alias("anchor"), "steps")
    heads = nodes.select("node").join(single.select("node"), "node", "left_anti").select("node", F.col("node").alias("anchor"), F.lit(0).cast("long").alias("steps"))
    at = materialize(walked.unionByName(heads), "level-anchors")
    core = edges.join(many, F.col("dst") == F.col("n"), "left_semi").join(at, F.col("src") == F.col("node")).select("dst", "anchor", (F.col("steps") + 1).alias("steps"))
    core = materialize(core, "level-core")
    known = materialize(heads.select("node").join(many.select(F.col("n").alias("node")), "node", "left_anti").select("node", F.lit(0).cast("long").alias("level")), "levels")
    while True:
        ready = core.join(known, core.anchor == known.node).groupBy("dst").agg(F.count("*").alias("has"), F.max(F.col("level") + F.col("steps")).alias("level"))
        ready = ready.join(many, (F.col("dst") == F.col("n")) & (F.col("has") == F.col("needs"))).select(F.col("dst").alias("node"), "level")
        new = materialize(ready.join(known.select("node"), "node", "left_anti"), "levels")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    known = known.select(F.col("node").alias("k"), "level")
    return at.join(known, F.col("anchor") == F.col("k")).select("node", (F.col("level") + F.col("steps")).cast("long").alias("level"))
