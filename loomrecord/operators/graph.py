"""Graph building with diagnostics, and cycle finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrecord.session import materialize


def build_graph(nodes: DataFrame, edges: DataFrame, max_degree: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes(id, seq, ...), edges(id, src, dst, seq) without duplicates, dangling ends or overloaded nodes.

    The first of an id wins (lowest seq). An edge is dropped when either end
    already holds `max_degree` accepted earlier edges; a self-loop counts twice. Returns
    nodes, edges and one diagnostic row per dropped item.
    """
    first_node = nodes.groupBy("id").agg(F.min("seq").alias("seq"))
    kept_nodes = nodes.join(first_node, ["id", "seq"], "left_semi")
    dup_nodes = nodes.join(first_node, ["id", "seq"], "left_anti").select(F.lit("duplicate-node").alias("code"), "id")
    first_edge = edges.groupBy("id").agg(F.min("seq").alias("_first"))
    ids = kept_nodes.select("id").distinct()
    # One pass over the edges settles what is first and which ends there are; it is written once for all that follows.
    marked = edges.join(first_edge, "id", "left").withColumn("_unique", F.coalesce(F.col("seq") == F.col("_first"), F.lit(False))).drop("_first")
    for end in ("src", "dst"):
        marked = marked.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    marked = materialize(marked, "edges")
    dup_edges = marked.filter(~F.col("_unique")).select(F.lit("duplicate-edge").alias("code"), "id")
    there = F.col("_src").isNotNull() & F.col("_dst").isNotNull()
    others = [c for c in edges.columns if c not in ("id", "dst", "src")]
    whole = marked.filter(F.col("_unique") & there).select("id", "dst", "src", *others)
    dangling = marked.filter(F.col("_unique") & ~there).join(whole.select("id"), "id", "left_anti").select(F.lit("missing-endpoint").alias("code"), "id")
    # Edges are taken in order of seq; one is refused once an end holds `max_degree` accepted
    # earlier ones, so refused edges use up nothing. Only ends with more than `max_degree` edges
    # can refuse. Each round settles every edge whose place is sure whatever becomes of the open
    # ones before it, the first open edge among them.
    n = F.explode(F.array(F.struct(F.col("src").alias("n"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("n"), F.lit(1).alias("side"))))
    ends = whole.select("id", "seq", n.alias("e")).select("id", "seq", "e.*")
    hubs = ends.groupBy("n").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_degree).select("n")
    state = materialize(ends.join(hubs, "n", "left_semi").withColumn("accepted", F.lit(None).cast("boolean")), "degree")
    refused = None
    while not state.filter(F.col("accepted").isNull()).isEmpty():
        before = Window.partitionBy("n").orderBy("seq", "id", "side").rowsBetween(Window.unboundedPreceding, -1)
        placed = state.withColumn("sure", F.coalesce(F.sum(F.col("accepted").cast("int")).over(before), F.lit(0))).withColumn("most", F.coalesce(F.count(F.lit(1)).over(before), F.lit(0)))
        judged = placed.filter(F.col("accepted").isNull()).groupBy("id").agg(F.max("most").alias("most"), F.max("sure").alias("sure"))
        verdict = F.when(F.col("most") < max_degree, True).when(F.col("sure") >= max_degree, False)
        settled = materialize(judged.select("id", verdict.alias("_verdict")).filter(F.col("_verdict").isNotNull()), "verdicts")
        out = settled.filter(~F.col("_verdict")).select("id")
        refused = out if refused is None else refused.unionByName(out)
        # A refused edge takes no place; the accepted ones stay to be counted.
        state = state.join(settled, "id", "left").withColumn("accepted", F.coalesce("accepted", "_verdict")).drop("_verdict")
        state = materialize(state.filter(F.col("accepted").isNull() | F.col("accepted")), "degree")
    kept, crowded = whole, whole.limit(0).select(F.lit("degree-limit").alias("code"), "id")
    if refused is not None:
        kept = whole.join(refused, "id", "left_anti")
        crowded = whole.join(refused, "id", "left_semi").select(F.lit("degree-limit").alias("code"), "id")
    return kept_nodes, kept, reduce(DataFrame.unionByName, [dup_nodes, dup_edges, dangling, crowded])


def cycles(edges: DataFrame) -> DataFrame:
    """edges(src, dst) on or between cycles: what remains after peeling.

    Nodes without incoming edges, then nodes without outgoing edges, lose their edges
    round by round until nothing changes, however long the chains. The edges left are
    written to the shared scratch folder each round, which keeps the plan short and
    survives lost executors.
    """
    current = materialize(edges.select("src", "dst").distinct(), "peel")
    size = current.count()
    while size:
        inner = current.join(current.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        current = materialize(inner.join(inner.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "peel")
        before, size = size, current.count()
        if size == before:
            break
    return current


def closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Least depth of every node reachable from `roots(node)`; `max_depth` stops earlier.

    Each round's new nodes are written, so a round costs one join with the edges and
    one with the nodes seen so far.
    """
    edges = materialize(edges.select("src", "dst").distinct(), "edges")
    frontier = materialize(roots.select("node", F.lit(0).alias("depth")).distinct(), "frontier")
    seen, depth = frontier, 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        step = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
    return seen
