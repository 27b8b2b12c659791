"""Graph operators: reach, depths, components, cycles and reading orders.

Edges are rows.  Fixpoints run as joins by key with a checkpoint per round, also the
strongly connected components and the reach of graphs that span papers; what needs a
fixed order inside one paper (depth-first orders, cycle witnesses) runs in one
grouped-map pass per paper.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def reach_in_tree(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """src, dst, depth of all ancestors.  parents(src, dst) has one row a node.

    The reach of every node doubles each round, so a chain of n nodes takes log n joins.  Parents that lead
    back to a node are an error: reach() takes such graphs.
    """
    most = parents.count()
    hop = parents.select("src", "dst", F.lit(1).cast("long").alias("depth"))
    found = starts.join(hop, "src")
    jump, known = hop, -1
    while True:
        far = jump.select(F.col("src").alias("dst"), F.col("dst").alias("_far"), F.col("depth").alias("_d"))
        more = found.join(far, "dst").select("src", F.col("_far").alias("dst"), (F.col("depth") + F.col("_d")).alias("depth"))
        grown = checkpointed(found.unionByName(more).distinct())
        size = grown.count()
        if size == known:
            return found
        found, known = grown, size
        if (found.agg(F.max("depth")).first()[0] or 0) > most:
            raise ValueError("the parents form a cycle")
        jump = checkpointed(jump.join(far, "dst").select("src", F.col("_far").alias("dst"), (F.col("depth") + F.col("_d")).alias("depth")))


def depths(roots: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """node, depth: least number of edges from a root, up to a limit.  Only the frontier is joined."""
    seen = checkpointed(roots.select("node", F.lit(0).cast("long").alias("depth")).distinct())
    frontier = seen
    for depth in range(1, limit + 1):
        frontier = checkpointed(frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def components(links: DataFrame) -> DataFrame:
    """id, root: the smallest id reachable over links(u, v).  Labels spread and jump to their label's label."""
    both = checkpointed(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root"))
    while True:
        near = both.join(label.select(F.col("u").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("r"))
        new = label.join(near, "u").select("u", F.least("root", "r").alias("root"))
        jump = new.select(F.col("u").alias("root"), F.col("root").alias("r2"))
        new = checkpointed(new.join(jump, "root").select("u", F.col("r2").alias("root")))
        if new.join(label.withColumnRenamed("root", "old"), "u").where("root <> old").isEmpty():
            return new.select(F.col("u").alias("id"), "root")
        label = new


def _unsized(table: DataFrame) -> DataFrame:
    """A checkpointed table without its estimated size: a join's is the product of both sides, and round by round
    that product came to have millions of digits, which the planner multiplied for minutes."""
    spark = table.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(table._jdf.javaRDD(), table._jdf.schema()), spark)


def _least_reached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, low: the least rank of the nodes(id, rank) that edges(u, v) lead to from each, its own included.  rank: a struct with id.

    A node takes the least label behind its edges and then the label of its label, so a path of n edges
    needs about log n rounds where labels fall along it.
    """
    label = nodes.select("id", F.col("rank").alias("low"))
    while True:
        near = edges.join(label.select(F.col("id").alias("v"), "low"), "v").groupBy(F.col("u").alias("id")).agg(F.min("low").alias("_near"))
        new = label.join(near, "id", "left").select("id", F.col("low").alias("_old"), F.least("low", "_near").alias("low"))
        jump = new.select(F.col("id").alias("_at"), F.col("low").alias("_next"))
        new = _unsized(checkpointed(new.withColumn("_at", F.col("low.id")).join(jump, "_at").select("id", "_old", F.col("_next").alias("low"))))
        if new.where("low <> _old").isEmpty():
            return new.select("id", "low")
        label = new.drop("_old")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("id")).unionByName(edges.select(F.col("v").alias("id"))).distinct()


def _trimmed(edges: DataFrame, rounds: int) -> DataFrame:
    """Without edges to nodes that nothing leaves, or from nodes that nothing enters: they lie on no cycle."""
    edges = checkpointed(edges)
    for _ in range(rounds):
        leaving, entered = edges.select(F.col("u").alias("v")).distinct(), edges.select(F.col("v").alias("u")).distinct()
        edges = checkpointed(edges.join(leaving, "v", "left_semi").join(entered, "u", "left_semi").select("u", "v"))
    return edges


def strong_components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node of its strongly connected component) of all nodes of edges(src, dst).

    Forward and backward colouring: nodes that lead to the same least node r have its colour; those of a colour
    that r leads to as well are its component.  Least by a hash that is new in every round, so that r lies in a
    large component as likely as its size.  What is left is trimmed and goes on with the edges inside one pair of
    colours.  All steps are joins and aggregations by node over all graphs at once, so a component may span any
    number of papers and tasks.
    """
    live = checkpointed(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("src is not null and dst is not null").distinct())
    nodes, turn, parts = checkpointed(_ends(live)), 0, []
    live = _trimmed(live.where("u <> v"), 2)
    while not live.isEmpty():
        turn += 1
        ids = checkpointed(_ends(live).withColumn("rank", F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), "id")))
        at = lambda labels, end, name: labels.select(F.col("id").alias(end), F.col("low").alias(name))
        ahead = _least_reached(live, ids)
        same = checkpointed(live.join(at(ahead, "u", "_a"), "u").join(at(ahead, "v", "_b"), "v").where("_a = _b").select("u", "v", F.col("_a").alias("colour")))
        behind = _least_reached(same.select(F.col("v").alias("u"), F.col("u").alias("v")), ids)
        found = ahead.join(behind.select("id", F.col("low").alias("_g")), "id").where("low = _g")
        parts.append(checkpointed(found.select("id", F.col("low.id").alias("root"))))
        rest = same.join(at(behind, "u", "_a"), "u").join(at(behind, "v", "_b"), "v").where("_a = _b and _a <> colour").select("u", "v")
        live = _trimmed(rest, 2)
    comps = nodes.select("id", F.col("id").alias("root")).limit(0)
    for part in parts:
        comps = comps.unionByName(part)
    names = comps.groupBy("root").agg(F.min("id").alias("comp"))
    return nodes.join(comps.join(names, "root").select("id", "comp"), "id", "left").select(F.col("id").alias("node"), F.coalesce("comp", "id").alias("comp"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """node, comp of the nodes that lie on a cycle of edges(src, dst), a loop included."""
    return cyclic_nodes_of(edges, checkpointed(strong_components(edges)))


def cyclic_nodes_of(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """node, comp of cyclic nodes, with the components known."""
    large = comps.groupBy("comp").agg(F.count("*").alias("_n")).where("_n > 1").select("comp")
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    alone = comps.join(loops, "node", "left_semi").join(large, "comp", "left_anti").select("node", "comp")
    return comps.join(large, "comp", "left_semi").select("node", "comp").unionByName(alone)


def condensed(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """src, dst between different components: a graph without cycles."""
    end = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}"))
    both = edges.join(end("src"), "src").join(end("dst"), "dst").where("_src <> _dst")
    return both.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()


def closure(dag: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """src, dst: all nodes that each start(src), or every node, leads to over edges without cycles.

    The reach of every edge doubles each round, so paths of n edges take log n rounds.
    """
    jump = checkpointed(dag.select("src", "dst").distinct())
    found, known = (jump if starts is None else jump.join(starts.select("src").distinct(), "src", "left_semi")), -1
    while True:
        far = jump.select(F.col("src").alias("dst"), F.col("dst").alias("_far"))
        grown = lambda pairs: checkpointed(pairs.unionByName(pairs.join(far, "dst").select("src", F.col("_far").alias("dst"))).distinct())
        found, size = grown(found), known
        known = found.count()
        if known == size:
            return found
        jump = found if starts is None else grown(jump)


def _reach_of_components(edges: DataFrame, starts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(node, comp of all nodes; src, dst of the components that lead to each other, a cyclic one to itself too)."""
    edges = checkpointed(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    comps = checkpointed(strong_components(edges))
    own = cyclic_nodes_of(edges, comps).select(F.col("comp").alias("src"), F.col("comp").alias("dst")).distinct()
    if starts is None:
        return comps, closure(condensed(edges, comps)).unionByName(own)
    asked = comps.join(starts.select("node").distinct(), "node", "left_semi").select(F.col("comp").alias("src")).distinct()
    return comps, closure(condensed(edges, comps), asked).unionByName(own.join(asked, "src", "left_semi"))


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """src, dst: every node that a start(node) leads to over edges(src, dst), itself only over a cycle.

    Paths are followed between components, and their members joined last: a cycle costs no rounds.
    """
    comps, pairs = _reach_of_components(edges, starts)
    first = starts.select("node").distinct().join(comps, "node").select(F.col("node").alias("start"), F.col("comp").alias("src"))
    return first.join(pairs, "src").join(comps.select(F.col("comp").alias("dst"), "node"), "dst").select(F.col("start").alias("src"), F.col("node").alias("dst"))


def reach_counts(edges: DataFrame) -> DataFrame:
    """node, n_reached of all nodes: sums over components, the pairs of nodes are never made."""
    comps, pairs = _reach_of_components(edges, None)
    size = comps.groupBy("comp").agg(F.count("*").alias("_n"))
    total = pairs.join(size.withColumnRenamed("comp", "dst"), "dst").groupBy("src").agg(F.sum("_n").alias("n_reached"))
    return comps.join(total.withColumnRenamed("src", "comp"), "comp", "left").select("node", F.coalesce("n_reached", F.lit(0)).alias("n_reached"))


def _adjacency(rows: pd.DataFrame) -> dict[str, list[str]]:
    if "ord" in rows:
        rows = rows.sort_values("ord", kind="stable")
    out: dict[str, list[str]] = {}
    for a, b in zip(rows["src"], rows["dst"], strict=True):
        out.setdefault(str(a), []).append(str(b))
    return out


def walk(root: str, adjacency: dict[str, list[str]]) -> list[str]:
    """Depth-first pre-order below a root; the root itself appears where a cycle returns to it."""
    out, seen, stack = [], set(), list(reversed(adjacency.get(root, [])))
    while stack:
        node = stack.pop()
        if node not in seen:
            seen.add(node)
            out.append(node)
            stack += reversed(adjacency.get(node, []))
    return out


def dependencies(edges: DataFrame, recursive: bool = True) -> DataFrame:
    """paper_id, root, position, node for every source of edges(paper_id, src, dst, ord)."""
    if not recursive:
        return edges.select("paper_id", F.col("src").alias("root"), F.col("ord").cast("long").alias("position"), F.col("dst").alias("node"))

    def per_paper(rows: pd.DataFrame) -> pd.DataFrame:
        adjacency = _adjacency(rows)
        out = [(rows["paper_id"].iloc[0], r, i, n) for r in adjacency for i, n in enumerate(walk(r, adjacency))]
        return pd.DataFrame(out, columns=["paper_id", "root", "position", "node"])

    return edges.groupBy("paper_id").applyInPandas(per_paper, "paper_id string, root string, position long, node string")


def strong_groups(adjacency: dict[str, list[str]]) -> list[list[str]]:
    """Strongly connected groups, without recursion."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on, trail, out = set(), [], []
    for start in sorted(set(adjacency) | {b for v in adjacency.values() for b in v}):
        if start in index:
            continue
        work = [(start, iter(adjacency.get(start, [])))]
        index[start] = low[start] = len(index)
        trail.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    trail.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(adjacency.get(nxt, []))))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while True:
                        x = trail.pop()
                        on.discard(x)
                        group.append(x)
                        if x == node:
                            break
                    out.append(group)
    return out


def on_cycles(edges: DataFrame) -> DataFrame:
    """paper_id, node of all nodes that lie on a cycle."""

    def per_paper(rows: pd.DataFrame) -> pd.DataFrame:
        adjacency = _adjacency(rows)
        hit = [n for g in strong_groups(adjacency) for n in g if len(g) > 1 or n in adjacency.get(n, [])]
        return pd.DataFrame([(rows["paper_id"].iloc[0], n) for n in hit], columns=["paper_id", "node"], dtype="object")

    return edges.groupBy("paper_id").applyInPandas(per_paper, "paper_id string, node string")


def reading_order(root: str, adjacency: dict[str, list[str]]) -> dict:
    """top_down (pre-order), bottom_up (dependencies first, empty if any cycle is met), cycles and order_status."""
    top, bottom, cycles = [], [], set()
    state: dict[str, int] = {root: 1}
    path, stack = [root], [iter(adjacency.get(root, []))]
    top.append(root)
    while stack:
        for nxt in stack[-1]:
            if state.get(nxt) == 1:
                ring = path[path.index(nxt):]
                at = ring.index(min(ring))
                ring = ring[at:] + ring[:at]
                cycles.add((*ring, ring[0]))
            elif nxt not in state:
                state[nxt] = 1
                top.append(nxt)
                path.append(nxt)
                stack.append(iter(adjacency.get(nxt, [])))
                break
        else:
            stack.pop()
            done = path.pop()
            state[done] = 2
            bottom.append(done)
    blocked = bool(cycles)
    return {"top_down": top, "bottom_up": [] if blocked else bottom, "cycles": sorted(cycles), "order_status": "cycle_blocked" if blocked else "dependency_first"}


def reading_paths(edges: DataFrame) -> DataFrame:
    """paper_id, root, top_down, bottom_up, cycles, order_status for every source of edges."""
    schema = "paper_id string, root string, top_down array<string>, bottom_up array<string>, cycles array<array<string>>, order_status string"

    def per_paper(rows: pd.DataFrame) -> pd.DataFrame:
        adjacency = _adjacency(rows)
        out = []
        for root in adjacency:
            r = reading_order(root, adjacency)
            out.append((rows["paper_id"].iloc[0], root, r["top_down"], r["bottom_up"], [list(c) for c in r["cycles"]], r["order_status"]))
        return pd.DataFrame(out, columns=["paper_id", "root", "top_down", "bottom_up", "cycles", "order_status"])

    return edges.groupBy("paper_id").applyInPandas(per_paper, schema)
