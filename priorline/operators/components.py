"""Reachability, cycles and components on edge tables.

Directed questions are answered from hop tables: the pairs exactly 1, 2, 4, ... hops apart, each joined from the one before.
Any distance is a sum of such hops, so one pass over the tables, longest first, follows every path: the number of joins
grows with the logarithm of the depth.  Where the next table would grow past a budget the tables end there, and passes are
repeated until nothing changes, so the answers stay exact.

A graph is first cut into ranges of its ids.  Each range is walked inside one task; between ranges only the nodes with an edge
to another range count, so the tables above are built on a much smaller graph wherever most edges join ids near each other.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reached; labels start at the smallest neighbour and jump to their label's label each round,
    so stars take one round and the number of rounds grows with the logarithm of the longest path."""
    both = stage_table(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    least = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("_n"))
    label = stage_table(nodes.join(least, "node", "left").select("node", F.least("node", F.coalesce("_n", "node")).alias("component")))
    while True:
        near = both.join(label, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("_n"))
        step = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("_n", "component")).alias("_c"), F.col("component").alias("_was"))
        jump = step.select(F.col("node").alias("_c"), F.col("_c").alias("_cc"))
        nxt = stage_table(step.join(jump, "_c", "left").select("node", F.least("_c", F.coalesce("_cc", "_c")).alias("component"), "_was"))
        moved = nxt.where("component <> _was").limit(1).count()
        label = nxt.select("node", "component")
        if not moved:
            return label


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def hop_tables(edges: DataFrame, max_pairs: int | None = None) -> tuple[list[DataFrame], bool]:
    """Pairs exactly 1, 2, 4, ... hops apart, and whether every distance of the graph is covered.

    The next table is made only if its join has at most ``max_pairs`` rows (eight times the edges, 5 million at least).
    """
    tables = [stage_table(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())]
    many, hops = nodes_of(tables[0]).count(), 1
    budget = max_pairs or max(8 * tables[0].count(), 5_000_000)
    while hops < many:
        last = tables[-1]
        came, went = last.groupBy("dst").count(), last.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("_out"))
        rows = came.join(went, "dst").agg(F.sum(F.col("count") * F.col("_out"))).first()[0] or 0
        if not rows or rows > budget:
            return tables, not rows
        onward = last.select(F.col("src").alias("_mid"), F.col("dst").alias("_end"))
        tables.append(stage_table(last.join(onward, F.col("dst") == F.col("_mid")).select("src", F.col("_end").alias("dst")).distinct()))
        hops *= 2
    return tables, True


def spread_max(labels: DataFrame, tables: list[DataFrame], complete: bool) -> DataFrame:
    """(node, value): the largest value among the node and all nodes that lead to it; nodes without a value get one if reached."""
    cur = stage_table(labels.groupBy("node").agg(F.max("value").alias("value")))
    while True:
        was = cur
        for hops in reversed(tables):
            passed = hops.join(cur, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "value")
            cur = stage_table(cur.unionByName(passed).groupBy("node").agg(F.max("value").alias("value")))
        if complete or not cur.join(was.withColumnRenamed("value", "_was"), "node", "left").where("_was IS NULL OR _was < value").limit(1).count():
            return cur


BLOCK_NODES, BLOCK_EDGES = 4096, 1_000_000


def cut_ranges(edges: DataFrame, nodes: int = BLOCK_NODES, most: int = BLOCK_EDGES, turn: int = 0) -> tuple[DataFrame, DataFrame]:
    """Distinct edges (src, dst, block), and (node, block) of all their nodes; ``block`` of an edge is null between ranges.

    Ranges of about ``nodes`` ids end at approximate percentiles, moved by half a range in odd turns.  A range with more than ``most`` edges is not walked in one task:
    its edges count as edges between ranges.
    """
    edges = stage_table(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    every = stage_table(nodes_of(edges))
    parts = -(-every.count() // nodes)
    shift = 0.5 if turn % 2 else 0.0
    cuts = [(i - shift) / parts for i in range(1, parts + 1) if 0 < (i - shift) / parts < 1]
    ends = every.agg(F.percentile_approx("node", F.array(*map(F.lit, cuts)), 20 * parts)).first()[0] if cuts else []
    if not ends:
        at = lambda c: F.lit(0)
    else:
        bounds = edges.sparkSession.createDataFrame([(sorted(set(ends)),)], "_ends ARRAY<BIGINT>")
        placed = every.crossJoin(F.broadcast(bounds)).select("node", F.size(F.filter("_ends", lambda b: b < F.col("node"))).alias("block"))
        placed = stage_table(placed)
        both = edges.join(placed.select(F.col("node").alias("src"), F.col("block").alias("_a")), "src").join(placed.select(F.col("node").alias("dst"), F.col("block").alias("_b")), "dst")
        inner = stage_table(both.select("src", "dst", F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias("block")))
        return _whole_only(inner, most), placed
    return _whole_only(edges.withColumn("block", at("src")), most), every.withColumn("block", at("node"))


def _whole_only(edges: DataFrame, most: int) -> DataFrame:
    full = edges.where("block IS NOT NULL").groupBy("block").count().where(F.col("count") > most).select("block", F.lit(True).alias("_full"))
    out = edges.join(full, "block", "left").select("src", "dst", F.when(F.col("_full").isNull(), F.col("block")).alias("block"))
    return stage_table(out)


def _after(edges: pd.DataFrame) -> dict[int, list[int]]:
    out = defaultdict(list)
    for a, b in zip(edges["src"].tolist(), edges["dst"].tolist()):
        out[a].append(b)
    return out


def _spread_inside(edges: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
    """The largest value that leads to each node: walked from the largest down, so each node is entered once."""
    after, out = _after(edges), {}
    labels = labels.sort_values("value", ascending=False, kind="stable")
    for start, value in zip(labels["node"].tolist(), labels["value"].tolist()):
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in out:
                out[node] = value
                todo += after.get(node, ())
    return pd.DataFrame({"node": list(out), "value": list(out.values())}).astype("int64")


def _shorten(edges: pd.DataFrame, doors: pd.DataFrame) -> pd.DataFrame:
    """Edges from each entry of a range to the exits it leads to; the range's own edges where those are fewer or quicker found."""
    after = _after(edges)
    entries, exits = doors.loc[doors["entry"], "node"].tolist(), set(doors.loc[doors["exit"], "node"].tolist())
    if len(entries) * len(edges) > 20 * BLOCK_EDGES:
        return edges[["src", "dst"]]
    pairs = []
    for start in entries:
        seen, todo = {start}, [start]
        while todo:
            for node in after.get(todo.pop(), ()):
                if node not in seen:
                    seen.add(node)
                    todo.append(node)
        pairs += [(start, node) for node in seen & exits if node != start]
        if len(pairs) > len(edges):
            return edges[["src", "dst"]]
    return pd.DataFrame(pairs, columns=["src", "dst"], dtype="int64")


def _walk(edges: DataFrame, others: DataFrame, schema: str, walk) -> DataFrame:
    return edges.where("block IS NOT NULL").groupBy("block").cogroup(others.groupBy("block")).applyInPandas(walk, schema)


def spread(labels: DataFrame, edges: DataFrame, max_pairs: int | None = None, nodes: int = BLOCK_NODES) -> DataFrame:
    """As ``spread_max``, for whole numbers along an edge table: inside ranges, between them on the shortened graph, and inside them again."""
    edges, placed = cut_ranges(edges, nodes)
    labels = stage_table(labels.groupBy("node").agg(F.max("value").cast("long").alias("value")))
    inside = lambda found: stage_table(found.select("node", "value").unionByName(_walk(
        edges, found.join(placed, "node").select("node", "value", "block"), "node BIGINT, value BIGINT",
        _spread_inside)).groupBy("node").agg(F.max("value").alias("value")))
    found = inside(labels)
    between = edges.where("block IS NULL").select("src", "dst")
    if not between.limit(1).count():
        return found
    doors = between.select(F.col("dst").alias("node"), F.lit(True).alias("entry"), F.lit(False).alias("exit")).unionByName(
        between.select(F.col("src").alias("node"), F.lit(False).alias("entry"), F.lit(True).alias("exit")))
    doors = doors.groupBy("node").agg(F.bool_or("entry").alias("entry"), F.bool_or("exit").alias("exit")).join(placed, "node")
    short = stage_table(between.unionByName(_walk(edges, doors, "src BIGINT, dst BIGINT", _shorten)))
    tables, complete = hop_tables(short, max_pairs)
    reached = spread_max(found.join(nodes_of(short), "node", "left_semi"), tables, complete)
    return inside(found.unionByName(reached).groupBy("node").agg(F.max("value").alias("value")))


def _knots(edges: pd.DataFrame) -> pd.DataFrame:
    """(node, cycle) of the strongly connected components with two nodes or more, by Tarjan's walk without recursion."""
    after, index, low, held, stack, out = _after(edges), {}, {}, set(), [], []
    for root in list(after):
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        held.add(root)
        walk = [(root, iter(after[root]))]
        while walk:
            node, onward = walk[-1]
            for nxt in onward:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    held.add(nxt)
                    walk.append((nxt, iter(after.get(nxt, ()))))
                    break
                if nxt in held:
                    low[node] = min(low[node], index[nxt])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == index[node]:
                    at = len(stack) - 1
                    while stack[at] != node:
                        at -= 1
                    members = stack[at:]
                    del stack[at:]
                    held.difference_update(members)
                    if len(members) > 1:
                        out += [(m, min(members)) for m in members]
    return pd.DataFrame(out, columns=["node", "cycle"], dtype="int64")


def descendants(edges: DataFrame, roots: DataFrame, max_pairs: int | None = None, nodes: int = BLOCK_NODES) -> DataFrame:
    """IT-29: nodes that one or more edges lead to from the roots; a root only if a cycle leads back to it."""
    edges = stage_table(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    first = edges.join(roots.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("node"), F.lit(1).alias("value"))
    return spread(first, edges, max_pairs, nodes).select("node")


def _coloured_cycles(edges: DataFrame, max_pairs: int | None = None) -> DataFrame:
    """(node, cycle) of the nodes on cycles, by colours.

    Nodes without long walks on both sides go first.  What is left is coloured with the largest priority that leads to a node
    (priorities are hashes, new in each round); a component lies in one colour, and the one of the colour's own node is what
    leads back to it.  Found components and edges between colours go, until no edge is left.
    """
    left = stage_table(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    loops = left.where("src = dst").select(F.col("src").alias("node"))
    found = loops.select("node", F.col("node").alias("cycle"))
    left, turn = stage_table(left.where("src <> dst")), 0
    while True:
        tables, complete = hop_tables(left, max_pairs)
        if complete and not tables[-1].join(tables[-1].select(F.col("src").alias("dst")), "dst", "left_semi").limit(1).count():
            return found.groupBy("node").agg(F.min("cycle").alias("cycle"))  # the longest walks end: no cycle is left
        walks = tables[-1]
        core = walks.select(F.col("src").alias("node")).distinct().join(walks.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
        core = stage_table(core)
        inner = left.join(core.withColumnRenamed("node", "src"), "src", "left_semi").join(core.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
        inner = stage_table(inner)
        if not inner.limit(1).count():
            return found.groupBy("node").agg(F.min("cycle").alias("cycle"))
        priority = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("top"))
        tables, complete = hop_tables(inner, max_pairs)
        colour = stage_table(spread_max(nodes_of(inner).select("node", priority.alias("value")), tables, complete).select("node", F.col("value.top").alias("top")))
        ends = inner.join(colour.select(F.col("node").alias("src"), F.col("top").alias("_a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("top").alias("_b")), "dst")
        same = stage_table(ends.where("_a = _b").select("src", "dst", F.col("_a").alias("top")))
        back, whole = hop_tables(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_pairs)
        tops = same.select("top").distinct().select(F.col("top").alias("node"), F.lit(1).alias("value"))
        member = stage_table(spread_max(tops, back, whole).select("node").join(colour, "node"))
        size = member.groupBy("top").agg(F.count("*").alias("_n"), F.min("node").alias("cycle")).where("_n > 1")
        member = stage_table(member.join(size, "top").select("node", "cycle"))
        found = stage_table(found.unionByName(member))
        gone = member.select("node")
        left = stage_table(same.select("src", "dst").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
                           .join(tops.select(F.col("node").alias("src")), "src", "left_anti").join(tops.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        turn += 1


def cycle_nodes(edges: DataFrame, max_pairs: int | None = None, nodes: int = BLOCK_NODES) -> DataFrame:
    """IT-29: (node, cycle) of the nodes on cycles; ``cycle`` is the smallest node of the strongly connected component.

    Components inside a range of ids are found in one task and become one node, named by its smallest; a second turn moves the
    ranges by half.  What is left of the graph goes to the colours, whose components are put back into nodes at the end.
    """
    edges = stage_table(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    names = None  # (node, cycle): every node that has become part of another
    for turn in range(2):
        cut, _ = cut_ranges(edges.where("src <> dst"), nodes, turn=turn)
        knots = stage_table(cut.where("block IS NOT NULL").groupBy("block").applyInPandas(lambda pdf: _knots(pdf), "node BIGINT, cycle BIGINT"))
        names = knots if names is None else stage_table(_renamed(names, knots))
        to = lambda end: knots.select(F.col("node").alias(end), F.col("cycle").alias(f"_{end}"))  # noqa: E731, B023
        joined = edges.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
        edges = stage_table(joined.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst")).where("src <> dst").distinct())
    names = stage_table(_renamed(names, _coloured_cycles(edges, max_pairs)))
    return names.unionByName(loops.withColumn("cycle", F.col("node"))).groupBy("node").agg(F.min("cycle").alias("cycle"))


def _renamed(names: DataFrame, later: DataFrame) -> DataFrame:
    """``names`` after their cycles have become part of the ``later`` ones, with the later nodes that had no name yet."""
    later = stage_table(later)
    moved = names.join(later.select(F.col("node").alias("cycle"), F.col("cycle").alias("_to")), "cycle", "left").select("node", F.coalesce("_to", "cycle").alias("cycle"))
    return moved.unionByName(later.join(names.select("node"), "node", "left_anti").select("node", "cycle"))


def worst_class(classes: DataFrame, edges: DataFrame, unresolved: int, max_pairs: int | None = None, nodes: int = BLOCK_NODES) -> DataFrame:
    """IT-29: each node takes the worst (largest) class among itself and its ancestors.

    A node without a class, parent or child, is ``unresolved``, the worst.  Rows: nodes with a class, and all children.
    """
    if classes.where(f"level IS NULL OR level < 0 OR level > {unresolved}").limit(1).count():
        raise ValueError("unsupported class")
    edges = stage_table(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    bare = nodes_of(edges).join(classes, "node", "left_anti").select("node", F.lit(unresolved).alias("value"))
    own = classes.select("node", F.col("level").alias("value"))
    listed = own.select("node").unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return spread(own.unionByName(bare), edges, max_pairs, nodes).join(listed, "node", "left_semi").select("node", F.col("value").alias("worst"))
