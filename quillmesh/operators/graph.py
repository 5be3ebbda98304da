"""Graph operators over any edge table ``edges(src, dst)``; column names are parameters where inputs vary.

Loops advance a frontier of new rows only, each round written to the shared folder, so dense graphs don't enumerate walks.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.shared import written

#: After so many rounds a table grown by unions is written anew, so that its plan stays short.
REWRITE = 16


def top_edges(pairs: DataFrame, src: str, dst: str, k: int = 1, weight: str | None = None) -> DataFrame:
    """The ``k`` most frequent ``dst`` of each ``src`` as (src, dst, n), rows counted or ``weight`` added up; of equal counts
    the smallest ``dst``."""
    counted = pairs.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    w = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    return counted.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def closure(edges: DataFrame, depth: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """(src, dst, depth): every node reachable from each source (or from ``start(src)``), by at most ``depth`` edges if given,
    with the smallest depth. A node reaches itself only around a cycle."""
    step = written(edges.select("src", "dst").distinct())
    first = step if start is None else step.join(start.select("src").distinct(), "src", "left_semi")
    seen = frontier = written(first.withColumn("depth", F.lit(1)))
    for d in count(2) if depth is None else range(2, depth + 1):
        ahead = frontier.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid")
        frontier = written(ahead.select("src", "dst").distinct().join(seen, ["src", "dst"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if d % REWRITE == 0:
            seen = written(seen)
    return seen


def dependents(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, dependent, depth): who must be looked at again when a node changes, the closure of the reversed edges."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(turned, depth).select(F.col("src").alias("node"), F.col("dst").alias("dependent"), "depth")


def _moved(side: DataFrame) -> DataFrame:
    """A join's side that is shuffled however small: loops would send the driver a broadcast of it in each round."""
    return side.hint("merge")


def on_cycles(edges: DataFrame) -> DataFrame:
    """The edges left when nodes without an edge in or out are taken away again and again: all cycles lie among them."""
    e = written(edges.select("src", "dst").distinct())
    before = None
    for _ in count():
        left = e.join(_moved(e.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").join(_moved(e.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi")
        e = written(left.select("src", "dst"))
        now = e.count()
        if now == before:
            return e
        before = now


def _settled(edges: DataFrame) -> DataFrame:
    """(node, color): the smallest node that each end of ``edges`` can be reached from, itself included. A round moves the
    edges of nodes whose color changed, and one row a node."""
    colors = written(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("color", F.col("node")))
    frontier = colors
    while True:
        ahead = frontier.join(_moved(edges.withColumnRenamed("src", "node")), "node").groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("new"))
        after = written(colors.join(_moved(ahead), "node", "left").select("node", F.coalesce(F.least("color", "new"), "color").alias("color"), (F.col("new") < F.col("color")).alias("fell")))
        colors, frontier = after.select("node", "color"), after.where("fell").select("node", "color")
        if frontier.isEmpty():
            return colors


def strong_parts(edges: DataFrame) -> DataFrame:
    """(node, part): the strongly connected part of each node by its smallest node; a node on no cycle is a part of its own.

    Edges that lie on no cycle are trimmed away. Of the rest, every node takes the smallest node that reaches it; those that
    reach this node in turn are its part. Parts found are taken out until nothing is left, so that no round moves more rows
    than there are edges and nodes, and no pairs of nodes arise. Null ends are dropped.
    """
    e = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    left, found = on_cycles(e.where("src != dst")), None
    while not left.isEmpty():
        colors = _settled(left)
        ends = left.join(_moved(colors.select(F.col("node").alias("src"), "color")), "src").join(_moved(colors.select(F.col("node").alias("dst"), F.col("color").alias("_color"))), "dst")
        same = written(ends.where("color = _color").select("src", "dst", "color"))
        seen = frontier = written(colors.where("node = color"))
        for d in count(1):
            back = frontier.select(F.col("node").alias("dst"), "color").join(_moved(same), ["dst", "color"]).select(F.col("src").alias("node"), "color").distinct()
            frontier = written(back.join(_moved(seen), ["node", "color"], "left_anti"))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
            if d % REWRITE == 0:
                seen = written(seen)
        found = written(seen if found is None else found.unionByName(seen))
        gone = seen.select("node")
        left = on_cycles(left.join(_moved(gone.withColumnRenamed("node", "src")), "src", "left_anti").join(_moved(gone.withColumnRenamed("node", "dst")), "dst", "left_anti"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return nodes.withColumn("part", F.col("node")) if found is None else nodes.join(_moved(found), "node", "left").select("node", F.coalesce("color", "node").alias("part"))


def inner_edges(edges: DataFrame) -> DataFrame:
    """The distinct edges that lie on a cycle: those whose ends share a strongly connected part, and loops."""
    e, parts = edges.select("src", "dst").distinct(), written(strong_parts(edges))
    both = e.join(parts.select(F.col("node").alias("src"), "part"), "src").join(parts.select(F.col("node").alias("dst"), F.col("part").alias("_part")), "dst")
    return written(both.where("part = _part").select("src", "dst"))


def cycle_members(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, length): nodes on a cycle and the length of the shortest through them. Only edges on cycles are walked."""
    return closure(inner_edges(edges), depth).where("src = dst").select(F.col("src").alias("node"), F.col("depth").alias("length"))


def propagated(edges: DataFrame, seeds: DataFrame, value: str = "value") -> DataFrame:
    """(node, value): ``seeds(node, value)`` and every value of a node that it reaches over ``edges(src, dst)``, as a function
    has the effects of those it calls. Each round carries only new pairs one edge back, until there are none."""
    step = written(edges.select(F.col("src").alias("node"), F.col("dst").alias("_to")).distinct())
    seen = frontier = written(seeds.select("node", value).distinct())
    for d in count(1):
        ahead = frontier.withColumnRenamed("node", "_to").join(step, "_to").select("node", value).distinct()
        frontier = written(ahead.join(seen, ["node", value], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if d % REWRITE == 0:
            seen = written(seen)


def first_derivations(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(src, dst, path): for every node that a source of ``start(src)`` reaches, itself included, the way a depth-first walk takes
    to it first: the smallest array of ``ord`` over ``edges(src, dst, ord)``. Only ways that got smaller are walked on."""
    step = written(edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to"), F.col("ord").cast("int").alias("_ord")))
    best = frontier = written(start.select("src").distinct().select("src", F.col("src").alias("dst"), F.array().cast("array<int>").alias("path")))
    while True:
        ahead = frontier.join(step, frontier.dst == step["_at"]).groupBy("src", F.col("_to").alias("dst")).agg(F.min(F.concat("path", F.array("_ord"))).alias("new"))
        both = best.join(ahead, ["src", "dst"], "full")
        fell = F.col("path").isNull() | (F.col("new") < F.col("path"))
        after = written(both.select("src", "dst", F.when(fell, F.col("new")).otherwise(F.col("path")).alias("path"), F.coalesce(fell & F.col("new").isNotNull(), F.lit(False)).alias("fell")))
        best, frontier = after.select("src", "dst", "path"), after.where("fell").select("src", "dst", "path")
        if frontier.isEmpty():
            return best


def mutual_edges(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b and edges both ways."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_semi").where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def simple_paths(edges: DataFrame, start: DataFrame, nodes: int) -> DataFrame:
    """(path): simple paths of 2 to ``nodes`` nodes from each node of ``start(src)``. Each length is written once."""
    e = written(edges.select("src", "dst").distinct())
    paths = e.join(start.select("src").distinct(), "src", "left_semi").where("src != dst").select(F.array("src", "dst").alias("path"))
    found = paths
    for _ in range(nodes - 2):
        paths = written(paths.join(e, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
        found = found.unionByName(paths)
    return found


def simple_cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """(cycle): simple cycles, of up to ``longest`` nodes if given, each once, from its smallest node on.

    Without ``longest`` only edges inside strongly connected parts are walked, until no path is left.
    """
    e = edges.select("src", "dst").distinct()
    if longest is None:
        e = inner_edges(edges)
    loops = e.where("src = dst").select(F.array("src").alias("cycle"))
    paths = e.where("src < dst").select(F.array("src", "dst").alias("path"))
    found = loops
    for k in count(2) if longest is None else range(2, longest + 1):
        back = paths.join(e, (F.element_at("path", -1) == F.col("src")) & (F.element_at("path", 1) == F.col("dst")))
        found = found.unionByName(back.select(F.col("path").alias("cycle")))
        if k == longest:
            break
        ahead = paths.join(e, F.element_at("path", -1) == F.col("src")).where((F.col("dst") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("dst")))
        paths = ahead.select(F.concat("path", F.array("dst")).alias("path"))
        if longest is None:
            paths = written(paths)
            if paths.isEmpty():
                break
            if k % REWRITE == 0:
                found = written(found)
    return found


def dominators(edges: DataFrame, root: int | None = None, roots: DataFrame | None = None, key: str = "graph") -> DataFrame:
    """(node, dominator): d dominates n if n can't be reached from the root without d; every reachable node dominates itself.

    With ``roots(key, node)`` many graphs at once, ``edges`` has the key too and so have the rows returned. Dominator sets
    shrink from a node's first one along edges until nothing changes: a node keeps what all its predecessors have, and itself,
    so that no pairs of unrelated nodes arise.
    """
    if roots is None:
        one = edges.withColumn(key, F.lit(0))
        return dominators(one, roots=one.select(key, F.lit(root).cast(one.schema["src"].dataType).alias("node")).distinct(), key=key).drop(key)
    e = written(edges.select(key, "src", "dst").where("src != dst").distinct())
    # a path to each node gives its first set, from the root down; dominators lie on every path
    seen = frontier = written(roots.select(key, "node", F.array("node").alias("path")))
    for d in count(1):
        ahead = frontier.join(e.withColumnRenamed("src", "node"), [key, "node"]).select(key, F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = ahead.join(seen.select(key, "node"), [key, "node"], "left_anti")
        frontier = written(new.groupBy(key, "node").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if d % REWRITE == 0:
            seen = written(seen)
    sets = written(seen.withColumnRenamed("path", "doms"))
    inner = written(e.join(roots.select(key, F.col("node").alias("dst")), [key, "dst"], "left_anti").join(sets.select(key, F.col("node").alias("src")), [key, "src"], "left_semi"))
    common = F.expr("aggregate(slice(held, 2, size(held)), held[0], (a, x) -> array_intersect(a, x))")
    while True:
        above = inner.join(sets.withColumnRenamed("node", "src"), [key, "src"]).groupBy(key, F.col("dst").alias("node")).agg(F.collect_set("doms").alias("held"))
        above = above.select(key, "node", common.alias("above"))
        after = sets.join(above, [key, "node"], "left")
        after = after.select(key, "node", F.when(F.col("above").isNull(), F.col("doms")).otherwise(F.array_intersect("doms", F.array_append("above", F.col("node")))).alias("after"), F.size("doms").alias("was"))
        after = written(after)
        if after.where("size(after) < was").isEmpty():
            return sets.select(key, "node", F.explode("doms").alias("dominator"))
        sets = after.select(key, "node", F.col("after").alias("doms"))


def _tree(src: np.ndarray, dst: np.ndarray, roots: np.ndarray, n: int) -> tuple[list[int], list[int], list[int]]:
    """(immediate dominator, enter, leave) of the nodes 0 to n - 1, -1 where no root reaches; n stands above all roots.

    Dominators settle along a postorder from the roots; the tree of them is then numbered, so that a node's numbers enclose
    those of all it dominates. Space grows with nodes and edges."""
    order = np.argsort(src, kind="stable")
    ahead, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    post, seen, todo = [], [False] * n, [(r, False) for r in roots.tolist()[::-1]]
    while todo:
        at, done = todo.pop()
        if done:
            post.append(at)
        elif not seen[at]:
            seen[at] = True
            todo.append((at, True))
            todo += [(x, False) for x in ahead[first[at] : first[at + 1]] if not seen[x]]
    rank = [-1] * n + [len(post)]
    for k, x in enumerate(post):
        rank[x] = k
    before: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        if rank[a] >= 0:
            before[b].append(a)
    idom = [-1] * n + [n]
    for r in roots.tolist():
        idom[r], before[r] = n, [n]
    changed = True
    while changed:
        changed = False
        for x in reversed(post):
            new = -1
            for a in before[x]:
                if idom[a] < 0:
                    continue
                b = new
                while b >= 0 and a != b:
                    if rank[a] < rank[b]:
                        a = idom[a]
                    else:
                        b = idom[b]
                new = a
            if new != idom[x]:
                idom[x], changed = new, True
    below: list[list[int]] = [[] for _ in range(n + 1)]
    for x in post:
        below[idom[x]].append(x)
    enter, leave, tick, walk = [-1] * (n + 1), [-1] * (n + 1), 0, [n]
    while walk:
        x = walk.pop()
        if enter[x] >= 0:
            leave[x] = tick
            continue
        enter[x], tick = tick, tick + 1
        walk.append(x)
        walk += below[x]
    return idom[:n], enter[:n], leave[:n]


def dominator_tree(edges: DataFrame, roots: DataFrame, key: str = "graph") -> DataFrame:
    """(key, node, idom, enter, leave) of the nodes that the roots of each graph reach; a root's idom is null.

    a dominates b if ``a.enter <= b.enter and b.leave <= a.leave``. ``edges(key, src, dst)`` and ``roots(key, node)`` hold many
    graphs, as a function's flow is one; each is worked out in one task, in space linear in it.
    """
    kind = edges.schema["src"].dataType.simpleString()

    def run(e: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        names, number = np.unique(np.concatenate([e["src"], e["dst"], r["node"]]), return_inverse=True)
        m = len(e)
        idom, enter, leave = _tree(number[:m], number[m : 2 * m], np.unique(number[2 * m :]), len(names))
        at = [k for k, x in enumerate(enter) if x >= 0]
        graph = r["_graph"].iloc[0] if len(r) else e[key].iloc[0]
        return pd.DataFrame({key: [graph] * len(at), "node": [names[k] for k in at], "idom": pd.Series([names[idom[k]] if idom[k] < len(names) else None for k in at], dtype=object), "enter": [enter[k] for k in at], "leave": [leave[k] for k in at]})

    known = edges.select(key, "src", "dst").where("src is not null and dst is not null")
    starts = roots.select(F.col(key).alias("_graph"), "node").where("node is not null")
    return known.groupBy(key).cogroup(starts.groupBy("_graph")).applyInPandas(run, f"{key} {edges.schema[key].dataType.simpleString()}, node {kind}, idom {kind}, enter int, leave int")


def guaranteed(tree: DataFrame, exits: DataFrame, key: str = "graph") -> DataFrame:
    """(key, node): nodes that every way from a graph's root to its exit passes: two comparisons with the exit's numbers.

    ``exits(key, node)`` have one row a graph. Where the exit can't be reached only root and exit count.
    """
    at = tree.join(exits.select(key, "node"), [key, "node"]).select(key, F.col("enter").alias("_enter"), F.col("leave").alias("_leave"))
    on_way = tree.join(at, key, "left").where("(enter <= _enter and _leave <= leave) or (_enter is null and idom is null)").select(key, "node")
    return on_way.union(exits.select(key, "node")).distinct()
