"""Ancestors, depths, roots, paths and cycles of parent-child rows.

Nodes whose hashed name falls into one of ``one_in`` classes are splitters.
Every node is walked upwards to its next splitters, which needs few rounds as
splitters are spread evenly; the splitters and the walks between them form a
reduced graph that is closed on its own; walk, closure and walk joined once give
all ancestors with the exact smallest number of links.  A cycle that holds no
splitter is closed by the walk alone and reported as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.plans import Workspace, skew_join

#: One node in so many is a splitter.
ONE_IN = 4
#: Parent values that refer to nobody (fixed values of the data model).
NOBODY = ("0", ".", "NA")


def is_splitter(node: Column, one_in: int = ONE_IN) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(one_in)) == 0


def parent_links(samples: DataFrame) -> DataFrame:
    """Distinct ``(node, parent)`` links of sample rows.

    A link exists if the parent value equals exactly an ``iid`` of the table and
    refers to somebody.  Null ``iid`` or parents give no link; repeated rows give
    one; an empty table gives none; other columns don't matter.
    """
    people = samples.select(F.col("iid").alias("parent")).where(F.col("parent").isNotNull()).distinct()
    links = (
        samples.select(F.col("iid").alias("node"), F.explode(F.array("father", "mother")).alias("parent"))
        .where(F.col("node").isNotNull() & F.col("parent").isNotNull() & ~F.col("parent").isin(*NOBODY))
        .distinct()
    )
    return skew_join(links, people, "parent", "left_semi", spread_by="node").select("node", "parent")


def _best(df: DataFrame, paths: bool, *counted: str) -> DataFrame:
    """The smallest number of links of each pair, with the first path in order among the shortest, and the smallest of ``counted``."""
    told = ["links", *(["path"] if paths else []), *counted]
    if len(told) == 1:
        return df.groupBy("node", "ancestor").agg(F.min("links").alias("links"))
    return df.groupBy("node", "ancestor").agg(F.min(F.struct(*told)).alias("b")).select("node", "ancestor", "b.*")


def _chain(left: DataFrame, right: DataFrame, paths: bool, *summed: str) -> DataFrame:
    """Pairs node -> mid of ``left`` continued by pairs mid -> ancestor of ``right``; links and the columns ``summed`` are added."""
    cols = ["node", "links", *(["path"] if paths else []), *summed]
    a = left.select(F.col("ancestor").alias("mid"), *[F.col(c).alias(f"l_{c}") for c in cols])
    b = right.select(F.col("node").alias("mid"), "ancestor", *[F.col(c).alias(f"r_{c}") for c in cols if c != "node"])
    out = skew_join(a, b, "mid", spread_by="l_node", both="ancestor")
    added = [(F.col(f"l_{c}") + F.col(f"r_{c}")).alias(c) for c in ("links", *summed)]
    return out.select(F.col("l_node").alias("node"), "ancestor", *added, *([F.concat("l_path", "r_path").alias("path")] if paths else []))


def _union(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def _walk(ws: Workspace, links: DataFrame, paths: bool, one_in: int) -> DataFrame:
    """All pairs joined by a way without a splitter inside, with its smallest length.

    Lengths are doubled each round: a shortest way longer than 2**r passes a node
    at exactly 2**r, so only those pairs are continued.
    """
    first = links.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("links"))
    walks = ws.store(first.withColumn("path", F.array("ancestor")) if paths else first, "walks")
    step = 1
    while True:
        edge = walks.where((F.col("links") == step) & ~is_splitter(F.col("ancestor"), one_in))
        if edge.isEmpty():
            return walks
        longer = ws.store(_best(_union(walks, _chain(edge, walks, paths)), paths), "walks")
        ws.drop(walks)
        walks, step = longer, step * 2


def _close(ws: Workspace, reduced: DataFrame, paths: bool) -> DataFrame:
    """The closure of the reduced graph by doubling its steps.

    The best way of a pair (shortest, then of fewest steps, or with the first path) has the best ways of
    its parts.  One of more than 2**r steps, and no more than twice as many, passes a splitter after
    exactly 2**r, so only pairs of that many steps, all new in the last round, are continued.
    """
    closed = ws.store(reduced.withColumn("steps", F.lit(1)), "reduced")
    step = 1
    while True:
        new = closed.where(F.col("steps") == step)
        if new.isEmpty():
            return closed.drop("steps")
        further = ws.store(_best(_union(closed, _chain(new, closed, paths, "steps")), paths, "steps"), "reduced")
        ws.drop(closed)
        closed, step = further, step * 2


def _solved(ws: Workspace, links: DataFrame, paths: bool, one_in: int) -> tuple[DataFrame, DataFrame]:
    """All ways without a splitter inside, and the best ways from every node to every splitter above it."""
    usable = links.select("node", "parent").where(F.col("node").isNotNull() & F.col("parent").isNotNull()).distinct()
    walks = _walk(ws, usable, paths, one_in)
    upto = walks.where(is_splitter(F.col("ancestor"), one_in))
    closed = _close(ws, upto.where(is_splitter(F.col("node"), one_in)), paths)
    return walks, ws.store(_best(_union(upto, _chain(upto, closed, paths)), paths), "splitters")


def ancestor_pairs(links: DataFrame, paths: bool = False, one_in: int = ONE_IN) -> DataFrame:
    """All ``(node, ancestor, links)`` pairs of ``(node, parent)`` links.

    ``links`` is the smallest number of links from the node up to the ancestor; a
    node on a cycle is its own ancestor.  With ``paths`` the column ``path`` lists
    the nodes after ``node`` up to ``ancestor`` on a shortest way (of several, the
    first in the order of names).  Links with a null end are ignored, repeated
    links count once, no links give no pairs.
    """
    ws = Workspace(links.sparkSession, "hierarchy")
    walks, splitters = _solved(ws, links, paths, one_in)
    return _best(_union(walks, splitters, _chain(splitters, walks, paths)), paths)


def hierarchy_nodes(people: DataFrame, pairs: DataFrame, links: DataFrame) -> DataFrame:
    """One row a node: ``n_ancestors``, ``n_descendants``, ``n_roots``, ``depth``, ``on_cycle``.

    ``people`` has the column ``node``; nulls and repeats there are ignored.  A
    root is an ancestor without parents (a node without parents is its own only
    root); ``depth`` is the largest number of links to a root on shortest ways, 0
    for a root and null if no root is above, as within a cycle.
    """
    pairs = Workspace(pairs.sparkSession, "nodes").store(pairs.select("node", "ancestor", "links"), "pairs")
    nodes = people.select("node").where(F.col("node").isNotNull()).distinct()
    with_parents = links.select(F.col("node").alias("ancestor")).distinct().withColumn("has_parent", F.lit(True))
    marked = skew_join(pairs, with_parents, "ancestor", "left", spread_by="node")
    up = marked.groupBy("node").agg(
        F.count("*").alias("n_ancestors"),
        F.count_if(F.col("has_parent").isNull()).alias("n_roots"),
        F.max(F.when(F.col("has_parent").isNull(), F.col("links"))).alias("depth"),
        F.max(F.col("node") == F.col("ancestor")).alias("on_cycle"),
    )
    down = pairs.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_descendants"))
    out = nodes.join(up, "node", "left").join(down, "node", "left")
    alone = F.col("n_ancestors").isNull()
    return out.select(
        "node",
        F.coalesce("n_ancestors", F.lit(0)).cast("long").alias("n_ancestors"),
        F.coalesce("n_descendants", F.lit(0)).cast("long").alias("n_descendants"),
        F.when(alone, 1).otherwise(F.col("n_roots")).cast("long").alias("n_roots"),
        F.when(alone, 0).otherwise(F.col("depth")).cast("long").alias("depth"),
        F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"),
    )


def root_paths(pairs: DataFrame, links: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """``(node, root, links, path)``: a shortest way from each node up to each of its roots.

    ``pairs`` comes from :func:`ancestor_pairs` with paths; ``path`` is the text of
    the way from the root down to the node, parted by ``/``.  With ``people``, which
    has the column ``node``, every node there has a row: one without parents is its
    own root (0 links, the path is its name), and one that reaches no root, as all
    its ways up end in cycles, has one row of nulls.  Nulls and repeats in
    ``people`` are ignored.
    """
    ws = Workspace(pairs.sparkSession, "paths")
    pairs = ws.store(pairs, "pairs")
    with_parents = links.select(F.col("node").alias("ancestor")).distinct()
    tops = skew_join(pairs, with_parents, "ancestor", "left_anti", spread_by="node")
    way = F.array_join(F.reverse(F.concat(F.array("node"), "path")), "/")
    below = tops.select("node", F.col("ancestor").alias("root"), F.col("links").cast("long").alias("links"), way.alias("path"))
    if people is None:
        return below
    below = ws.store(below, "below")
    ws.drop(pairs)
    rest = people.select("node").where(F.col("node").isNotNull()).distinct().join(below.select("node").distinct(), "node", "left_anti")
    marked = rest.join(with_parents.select(F.col("ancestor").alias("node"), F.lit(True).alias("has_parent")), "node", "left")
    alone = F.col("has_parent").isNull()
    return below.unionByName(
        marked.select("node", F.when(alone, F.col("node")).alias("root"), F.when(alone, 0).cast("long").alias("links"), F.when(alone, F.col("node")).alias("path"))
    )


def splitterless_cycles(walks: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """``(node, cycle_links)`` of nodes on a cycle that holds no splitter, which no step of the reduced graph sees."""
    return walks.where((F.col("node") == F.col("ancestor")) & ~is_splitter(F.col("node"), one_in)).select("node", F.col("links").alias("cycle_links"))


def cycle_nodes(links: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """``(node, cycle_links)``: every node that is its own ancestor, with the length of its shortest cycle.

    A cycle through a splitter is a way from the node to the splitter and a walk back, which are joined
    on both ends; cycles without splitters come from the walks alone.  Null ends and repeated links are
    ignored; without links there are no cycles.
    """
    ws = Workspace(links.sparkSession, "cycles")
    walks, splitters = _solved(ws, links, False, one_in)
    at_once = splitters.where(F.col("node") == F.col("ancestor")).select("node", F.col("links").alias("cycle_links"))
    back = walks.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("node"), F.col("links").alias("back"))
    through = splitters.join(back, ["node", "ancestor"]).select("node", (F.col("links") + F.col("back")).alias("cycle_links"))
    return _union(splitterless_cycles(walks, one_in), at_once, through).groupBy("node").agg(F.min("cycle_links").alias("cycle_links"))
