"""Parent-child rows to full hierarchies: ancestors, paths, roots, depths and cycles.

Method: find connected components, co-locate each component, walk it
depth-first with node colouring, and output ancestors and back-edge cycles.

Every node has at most one parent, so components follow from the nodes that have
others below them. Up to INNER of them are followed upwards in one task; more
come from pointer doubling: each round doubles the distance that a node has
looked up the tree, and the rounds follow the logarithm of the depth. What never
reaches a root leads into a cycle; its component is named by the least node of
the cycle. All nodes then take over what their parent found.

A component of up to `co_locate` nodes, and of up to PAIRS ancestors of all its
nodes together, goes whole to one task and is walked there. A larger one may hold
a third of all rows, or be a chain whose result is far larger than itself, and must not: its ancestors
come from joining ancestor lists of doubling length (pairs at distance d + 2^k
from pairs at distance d), which spreads over all tasks and does work in
proportion to the result. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.functions.texts import name_key
from runweave.operators.joins import lookup
from runweave.session import cut, together

#: Nodes of a component that one task may hold.
CO_LOCATE = 50_000
#: Rows that the walk of one component may give: the depths of its nodes added up.
PAIRS = 5_000_000
#: Nodes with others below them that one task may hold, by their keys only.
INNER = 200_000


def edges(df: DataFrame, child: Column, parent: Column) -> DataFrame:
    """(node, name, parent): one row for each node, keys trimmed and in lower case.

    Nodes repeated in df count once (the least name, the least parent); a blank or
    NULL parent is NULL, one that is no node counts as none from components() on. Rows
    without a name are left out. Other columns of df are dropped.
    """
    rows = df.select(name_key(child).alias("node"), child.alias("name"), name_key(parent).alias("parent")).where("node is not null")
    return rows.groupBy("node").agg(F.min("name").alias("name"), F.min("parent").alias("parent"))


def components(tree: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(node, name, parent, component, depth): depth is the distance from the root, NULL below or on a cycle.

    component is the root's node, or the least node of the cycle. Each node takes over
    what its parent found; parent is NULL where it is no node. tree is read several times and should be cut.
    """
    facts = inner_facts(tree) if facts is None else facts
    # one parent may have a third of all nodes below it
    placed = lookup(tree.select("node", "name", "parent"), facts, {"parent": "node"}, "n", ["component", "depth"], nulls=False)
    known = F.col("component").isNotNull()
    depth = F.when(known, F.col("depth") + 1).otherwise(F.lit(0).cast("long"))
    return placed.select("node", "name", F.when(known, F.col("parent")).alias("parent"), F.coalesce("component", "node").alias("component"), depth.alias("depth"))


def inner_facts(tree: DataFrame, inner: int = INNER) -> DataFrame:
    """(node, n, component, depth) of each node that has n > 0 nodes right below it, cut.

    Up to `inner` of them are followed up to their roots in one task, more by doubling pointers in rounds.
    """
    below = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    held = cut(tree.select("node", "parent").join(below, "node"))
    if held.count() <= inner:
        return cut(held.repartition(1).mapInArrow(_settled, "node string, n long, component string, depth long"))
    known = held.select(F.col("node").alias("parent"), "n", F.lit(True).alias("_real"))
    real = cut(lookup(held.select("node", "parent"), known, {"parent": "parent"}, "n", ["_real"], nulls=False).select("node", F.when(F.col("_real"), F.col("parent")).alias("parent")))
    return cut(_found(real).join(held.select("node", "n"), "node").select("node", "n", "component", "depth"))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """inner_facts() of rows (node, parent, n), all in one task: each node goes up until it meets one that is settled, a root, or its own path, which is a cycle."""
    up: dict[str, str | None] = {}
    sizes: dict[str, int] = {}
    for b in batches:
        for node, parent, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
            up[node], sizes[node] = parent, n
    settled: dict[str, tuple[str, int | None]] = {}
    for start in up:
        path: dict[str, int] = {}
        at: str | None = start
        while at in up and at not in settled and at not in path:
            path[at] = len(path)
            at = up[at]
        trail = list(path)
        if at in path:
            component, depth = min(trail[path[at] :]), None
        else:
            component, depth = settled[at] if at in settled else (trail[-1], -1)
        for node in reversed(trail):
            depth = None if depth is None else depth + 1
            settled[node] = component, depth
    kinds = {"node": pa.string(), "n": pa.int64(), "component": pa.string(), "depth": pa.int64()}
    rows = [(node, sizes[node], *found) for node, found in settled.items()]
    for i in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 20_000], strict=True), kinds.values(), strict=True)], list(kinds))


def _found(tree: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component, depth) of each node of a forest that is closed upwards (node, parent)."""
    state = cut(
        tree.select(
            "node", F.coalesce("parent", "node").alias("at"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("hops"),
            F.col("parent").isNull().alias("done"), F.coalesce("parent", "node").alias("least"),
        )
    )
    left, seen, rounds = None, None, 0
    while left != 0 and (left is None or left != seen) and rounds < max_rounds:
        # two steps a round: pointers reach four times as far
        state = cut(_doubled(_doubled(state)))
        seen, left, rounds = left, state.where("not done").count(), rounds + 2
    finished = state.where("done").select("node", F.col("at").alias("component"), F.col("hops").alias("depth"))
    if not left:
        return finished
    # the rest leads into cycles: look on until every node has gone into its cycle and once round it
    loop = state.where("not done")
    while 2**rounds < 2 * left:
        loop, rounds = cut(_doubled(_doubled(loop))), rounds + 2
    # every pointer now stands on a cycle, and a node of a cycle has seen all of it
    named = loop.select("at").distinct().join(loop.select(F.col("node").alias("at"), F.col("least").alias("component")), "at")
    cyclic = loop.join(named, "at").select("node", "component", F.lit(None).cast("long").alias("depth"))
    return finished.unionByName(cyclic)


def _doubled(state: DataFrame) -> DataFrame:
    """Each open pointer moves on by the pointer of the node it points at."""
    far = state.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"), F.col("done").alias("end"), F.col("least").alias("low"))
    opened = state.where("not done").join(far, "at", "left")
    keep = [c for c in state.columns if c not in ("at", "hops", "done", "least")]
    moved = opened.select(
        *keep, F.coalesce("to", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
        F.coalesce("end", F.lit(False)).alias("done"), F.least("least", "low").alias("least"),
    )
    return state.where("done").select(*moved.columns).unionByName(moved)


def _walk(nodes: list[str], parents: list[str | None]) -> Iterator[tuple[str, str, int]]:
    """(ancestor, node, distance) of one component, by a depth-first walk with colours.

    White nodes aren't visited yet, grey ones lie on the present path, black
    ones are finished; meeting a grey node is a back edge: the path from it on
    is a cycle.
    """
    up = dict(zip(nodes, parents, strict=True))
    below: dict[str, list[str]] = {}
    for n, p in up.items():
        if p is not None:
            below.setdefault(p, []).append(n)
    # a component has one root or one cycle; walk up from any node until one of them is met
    grey: dict[str, int] = {}
    at: str | None = nodes[0]
    while at is not None and at not in grey:
        grey[at] = len(grey)
        at = up[at]
    if at is None:
        ring, starts = [], [next(reversed(grey))]
    else:
        path = list(grey)
        ring = path[grey[at] :]
        starts = ring
    on_ring = set(ring)
    for i, start in enumerate(starts):
        # the ancestors of a ring node are the ring from its parent round to itself
        above = ring[i + 1 :] + ring[: i + 1]
        for d, a in enumerate(above, 1):
            yield a, start, d
        stack = [(c, 1) for c in below.get(start, ()) if c not in on_ring]
        path = [start]
        while stack:
            node, depth = stack.pop()
            del path[depth:]
            for d in range(1, depth + 1):
                yield path[depth - d], node, d
            for d, a in enumerate(above[:-1], depth + 1):
                yield a, node, d
            path.append(node)
            stack.extend((c, depth + 1) for c in below.get(node, ()))


def _walker(rows_a_batch: int = 20_000):
    schema = pa.schema([("ancestor", pa.string()), ("node", pa.string()), ("distance", pa.int32()), ("ancestor_name", pa.string()), ("name", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            component, rows = None, []
            for b in batches:
                for c, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    if c != component and rows:
                        yield from named(rows)
                        rows = []
                    component = c
                    rows.append(row)
            if rows:
                yield from named(rows)

        def named(rows: list) -> Iterator[tuple]:
            nodes, parents, names = zip(*rows, strict=True)
            name = dict(zip(nodes, names, strict=True))
            for a, n, d in _walk(list(nodes), list(parents)):
                yield a, n, d, name[a], name[n]

        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        for row in found():
            out.append(row)
            if len(out) >= rows_a_batch:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return walk


def _by_doubling(large: DataFrame) -> DataFrame:
    """(ancestor, node, distance) of components too large for one task; large: node, parent, component, depth."""
    # a cycle is opened above its least node, which then is the root of a tree
    tree = cut(large.select("node", F.when(F.col("depth").isNotNull() | (F.col("node") != F.col("component")), F.col("parent")).alias("parent"), "component", "depth", F.col("parent").alias("real")))
    pairs = cut(tree.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    span = 1
    while True:
        jump = pairs.where(F.col("distance") == span).select("node", F.col("ancestor").alias("mid"))
        beyond = pairs.select(F.col("node").alias("mid"), "ancestor", "distance")
        more = cut(jump.join(beyond, "mid").select("node", "ancestor", (F.col("distance") + span).alias("distance")))
        if more.isEmpty():
            break
        pairs, span = cut(pairs.unionByName(more)), span * 2
    # round the cycle: its nodes in order from the least node, whose distance to itself is the cycle's length
    root = tree.where("depth is null and node = component")
    round_ = root.select("component", F.col("real").alias("node")).join(pairs, "node")
    ring = root.select("component", F.col("real").alias("ancestor"), F.lit(1).alias("step")).unionByName(
        round_.select("component", "ancestor", (F.col("distance") + 1).alias("step"))
    )
    cyclic = tree.where("depth is null").select("node", "component")
    to_root = pairs.join(cyclic, "node").where("ancestor = component").select("node", "component", "distance")
    to_root = to_root.unionByName(cyclic.where("node = component").withColumn("distance", F.lit(0)))
    wrapped = to_root.join(ring, "component").select("node", "ancestor", (F.col("distance") + F.col("step")).alias("distance"))
    on_ring = ring.select(F.col("ancestor").alias("node"), F.lit(True).alias("on_ring"))
    wrapped = wrapped.join(on_ring, "node", "left").where("ancestor != node or on_ring").drop("on_ring")
    return pairs.select("ancestor", "node", "distance").unionByName(wrapped.select("ancestor", "node", "distance")).groupBy("ancestor", "node").agg(F.min("distance").alias("distance"))


def ancestors(tree: DataFrame, parts: DataFrame | None = None, co_locate: int = CO_LOCATE, pairs: int = PAIRS, facts: DataFrame | None = None) -> DataFrame:
    """(ancestor, node, distance, ancestor_name, name): each node with each node above it, at the smallest distance.

    A node on a cycle has itself as an ancestor at the cycle's length. Roots
    have no rows as node. An empty table gives no rows. parts and facts are
    those of components() and inner_facts(), where they are at hand.
    """
    facts = inner_facts(tree) if facts is None else facts
    parts = components(tree, facts) if parts is None else parts
    # every node but a root lies right below an inner one; below and on cycles every node may have all others above it
    nodes = F.sum("n") + F.when(F.count("depth") > 0, 1).otherwise(0)
    sizes = facts.groupBy("component").agg(nodes.alias("n"), F.coalesce(F.sum(F.col("n") * (F.col("depth") + 1)), nodes.cast("double") * nodes).alias("work"))
    heavy = (F.col("n") > co_locate) | (F.col("work") > pairs)
    kind = "ancestor string, node string, distance int, ancestor_name string, name string"
    walked = lambda df: together(df.select("component", "node", "parent", "name"), "component").mapInArrow(_walker(), kind)
    if not sizes.agg(F.bool_or(heavy)).head()[0]:
        return walked(parts)
    # few: each has more than co_locate nodes or more than the root of pairs
    apart = F.broadcast(cut(sizes.where(heavy).select("component")))
    names = tree.select("node", "name")
    large = _by_doubling(parts.join(apart, "component", "left_semi").drop("name")).withColumn("distance", F.col("distance").cast("int"))
    large = large.join(names, "node").join(names.select(F.col("node").alias("ancestor"), F.col("name").alias("ancestor_name")), "ancestor")
    return walked(parts.join(apart, "component", "left_anti")).unionByName(large)


def named_ancestors(df: DataFrame, child: Column, parent: Column, co_locate: int = CO_LOCATE, inner: int = INNER) -> DataFrame:
    """ancestors() by the names as they stand in the nodes' own rows: ancestor_name, name, distance."""
    tree = cut(edges(df, child, parent))
    return ancestors(tree, co_locate=co_locate, facts=inner_facts(tree, inner)).select("ancestor_name", "name", "distance")


def paths(df: DataFrame, child: Column, parent: Column, separator: str = "/") -> DataFrame:
    """(name, path, depth, root, in_cycle) of each node: path from the root down to the node.

    Below or on a cycle, the path starts at the farthest distinct ancestor,
    depth is the number of distinct ancestors other than the node, and root is
    NULL.
    """
    tree = cut(edges(df, child, parent))
    facts = inner_facts(tree)
    parts = components(tree, facts)
    pairs = ancestors(tree, parts, facts=facts)
    chain = pairs.groupBy("node").agg(
        F.sort_array(F.collect_list(F.when(F.col("ancestor") != F.col("node"), F.struct((-F.col("distance")).alias("d"), "ancestor_name"))), True).alias("chain"),
        F.max(F.col("ancestor") == F.col("node")).alias("on_cycle"),
    )
    out = parts.select("node", "name", "depth").join(chain, "node", "left")
    steps = F.coalesce(F.transform("chain", lambda x: x["ancestor_name"]), F.array().cast("array<string>"))
    return out.select(
        "name",
        F.array_join(F.concat(steps, F.array("name")), separator).alias("path"),
        F.coalesce(F.col("depth"), F.size(steps).cast("long")).alias("depth"),
        F.when(F.col("depth").isNotNull(), F.coalesce(F.get(steps, F.lit(0)), F.col("name"))).alias("root"),
        F.coalesce("on_cycle", F.lit(False)).alias("in_cycle"),
    )


def cycles(df: DataFrame, child: Column, parent: Column) -> DataFrame:
    """(name, cycle_length) of each node that contains itself."""
    return named_ancestors(df, child, parent).where(F.col("ancestor_name") == F.col("name")).select("name", F.col("distance").alias("cycle_length"))
