"""Source-to-sink paths in a table of flow nodes and edges."""

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.functions.shared import written

#: Steps that are planned together before the frontier is written.
STRIDE = 5
#: Nodes of a path at most, as published.
MAX_NODES = 20


def sink_distances(nodes: DataFrame, edges: DataFrame, max_steps: int | None = None) -> DataFrame:
    """(node, distance): the fewest steps to a Sink node, of all nodes that reach one within ``max_steps`` (None: at all).

    Walks backward from the sinks, some steps in one job, until no new node is met. A path ends at
    its first sink, so nothing leads on through one.
    """
    sinks = nodes.filter("node_type = 'Sink'").select(F.col("id").alias("node"))
    inner = edges.join(sinks.select(F.col("node").alias("src")), "src", "left_anti").select("src", F.col("dst").alias("node"))
    inner = written(inner)
    labels = frontier = sinks.distinct().select("node", F.lit(0).alias("distance"))
    for done in count(0, STRIDE):
        steps = STRIDE if max_steps is None else min(STRIDE, max_steps - done)
        if steps <= 0:
            return labels
        met, level = None, frontier.select("node")
        for step in range(done + 1, done + steps + 1):
            level = inner.join(level, "node").select(F.col("src").alias("node")).distinct()
            found = level.select("node", F.lit(step).alias("distance"))
            met = found if met is None else met.union(found)
        new = met.groupBy("node").agg(F.min("distance").alias("distance")).join(labels.select("node"), "node", "left_anti")
        new = written(new)
        frontier = new.filter(F.col("distance") == done + steps)
        labels = labels.union(new)
        if frontier.isEmpty():
            return labels


def _hops(nodes: DataFrame, edges: DataFrame, max_steps: int | None) -> DataFrame:
    """The edges that lead on to a sink, with the kind of the node they lead to and its distance from one; built once."""
    kinds = nodes.selectExpr("id AS dst", "node_type AS dst_type")
    near = sink_distances(nodes, edges, max_steps).select(F.col("node").alias("dst"), "distance")
    return written(edges.join(kinds, "dst").join(near, "dst").select("src", "dst", "dst_type", "distance"))


def _grown(starts: DataFrame, hops: DataFrame, max_nodes: int, budget: int):
    """Simple paths from ``starts`` (column start): those that end at a sink with at most ``max_nodes`` nodes, and the open ones of
    that size. A path only goes on to nodes from which ``budget`` nodes in all still reach a sink. That is asked by the path's size,
    not by a number of its own in each step, so the steps planned together read one shuffle of the hops."""
    frontier = starts.selectExpr("start", "start AS last", "array(start) AS path", "false AS is_sanitized", "false AS done")
    finished = []
    for size in range(2, max_nodes + 1):
        near = F.col("distance") < budget - F.size("path")
        joined = frontier.join(hops, (F.col("last") == F.col("src")) & ~F.col("done") & near, "left")
        frontier = (joined.filter("done OR (src IS NOT NULL AND NOT array_contains(path, dst))").selectExpr(
            "start", "IF(done, last, dst) AS last", "IF(done, path, concat(path, array(dst))) AS path",
            "is_sanitized OR (NOT done AND dst_type = 'Sanitizer') AS is_sanitized",
            "done OR dst_type = 'Sink' AS done"))
        if (size - 1) % STRIDE == 0 or size == max_nodes:
            frontier = written(frontier)
            finished.append(frontier.filter("done"))
            frontier = frontier.filter("NOT done")
            if size < max_nodes and frontier.isEmpty():
                break
    done = finished[0] if finished else frontier.filter("done")
    for part in finished[1:]:
        done = done.union(part)
    return done, frontier


def simple_paths(nodes: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """All simple paths from Source to Sink nodes with at most ``max_nodes`` nodes.

    Nodes are labelled with their distance from a sink first, and no path goes where the nodes left
    cannot reach one. The rest meet in the middle: first halves grow from the sources, second halves
    once from each node where first halves end, not once for each of them, and the two are joined at
    that node if they share no other. A path ends at its first sink. Every few steps the open paths
    are written to the shared folder; nothing is collected and no path dropped, and AQE splits the
    share of a hub node. Their number can grow with every step; ``witness_paths`` stays small.
    """
    hops = _hops(nodes, edges, max_nodes - 1)
    sources = nodes.filter("node_type = 'Source'").select(F.col("id").alias("start"))
    half = max(1, max_nodes // 2)
    whole, first = _grown(sources, hops, half, max_nodes)
    rest = max_nodes - half + 1  # the middle node counts in both halves
    second, _ = _grown(first.select(F.col("last").alias("start")).distinct(), hops, rest, rest)
    ends = second.selectExpr("start AS last", "last AS sink", "path AS tail", "is_sanitized AS tail_sanitized")
    met = first.join(ends, "last").filter("size(array_intersect(path, tail)) = 1").selectExpr(
        "start", "sink AS last", "concat(path, slice(tail, 2, size(tail))) AS path", "is_sanitized OR tail_sanitized AS is_sanitized")
    return whole.select(*met.columns).union(met).selectExpr(
        "start AS source_id", "last AS sink_id", "path", "size(path) AS length", "is_sanitized")


def witness_paths(nodes: DataFrame, edges: DataFrame, max_nodes: int | None = MAX_NODES) -> DataFrame:
    """The sinks that a source reaches without passing another sink, each with one path of at most ``max_nodes`` nodes.

    Without a limit (None) the walk goes on until it meets nothing new, so every reachable sink is
    found. The path is the shortest, and of these the first in order of its nodes. A source keeps
    one path per node, so the work follows the pairs of source and node, however many paths join
    them; nodes that reach no sink are never entered. Some steps are planned together: they read one
    shuffle of the hops, and pairs that were met before leave once, at their end. Until then such a
    pair may be met again, but only with a longer path.
    """
    hops = _hops(nodes, edges, None if max_nodes is None else max_nodes - 1)
    frontier = nodes.filter("node_type = 'Source'").selectExpr("id AS source_id", "id AS node", "array(id) AS path")
    seen, found = frontier.select("source_id", "node"), []
    for done in count(1, STRIDE):
        steps = STRIDE if max_nodes is None else min(STRIDE, max_nodes - done)
        if steps <= 0:
            break
        near = F.lit(True) if max_nodes is None else F.col("distance") < max_nodes - F.size("path")
        met, level = None, frontier
        for _ in range(steps):
            grown = level.join(hops, (F.col("node") == F.col("src")) & near).filter("NOT array_contains(path, dst)").selectExpr(
                "source_id", "dst AS node", "concat(path, array(dst)) AS path", "dst_type")
            grown = grown.groupBy("source_id", "node").agg(F.min("path").alias("path"), F.first("dst_type").alias("kind"))
            met = grown if met is None else met.union(grown)
            level = grown.filter("kind <> 'Sink'").select("source_id", "node", "path")
        new = met.groupBy("source_id", "node").agg(F.min(F.struct(F.size("path").alias("length"), "path", "kind")).alias("first"))
        new = written(new.select("source_id", "node", "first.path", "first.kind").join(seen, ["source_id", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen = seen.union(new.select("source_id", "node"))
        found.append(new.filter("kind = 'Sink'"))
        frontier = new.filter(f"kind <> 'Sink' AND size(path) = {done + steps}").select("source_id", "node", "path")
    empty = frontier.selectExpr("source_id", "node", "path", "'' AS kind").limit(0)
    for part in found:
        empty = empty.union(part.select("source_id", "node", "path", "kind"))
    return empty.selectExpr("source_id", "node AS sink_id", "path", "size(path) AS length")
