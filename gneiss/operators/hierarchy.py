"""Parent-child links to full hierarchies by pointer doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.runtime import cut, salted_join

CYCLE = "CYCLE"


def canonical_code(code: Column) -> Column:
    """Letters and digits of a code in upper case; NULL when none is left."""
    kept = F.upper(F.regexp_replace(code, r"[^\p{L}\p{N}]", ""))
    return F.when(kept != "", kept)


def parent_links(rows: DataFrame, tree: Column, node: Column, parent: Column, order: Column | None = None) -> DataFrame:
    """One row ``(tree, node, parent, declared, inner)`` for every node named in ``rows``: ``declared``
    if it is named as a node, ``inner`` if it is named as a parent.

    Rows with a NULL tree or node say nothing. A node named only as a parent is a root. Of
    several rows for one node, those that name a parent win, then the latest ``order``, then
    the least parent, so repeated and late rows have a defined result.
    """
    named = rows.select(tree.alias("tree"), node.alias("node"), parent.alias("parent"), (order if order is not None else F.lit(None).cast("int")).alias("ord"))
    named = named.where("tree is not null and node is not null")
    own = F.struct(F.col("parent").isNotNull().alias("has"), "ord", F.col("parent").alias("p"))
    best = F.max(F.when(F.col("declared"), own))
    # one aggregation yields both the declared nodes and those named only as a parent
    both = named.select(
        "tree", F.explode(F.array(F.struct("node", "parent", "ord", F.lit(True).alias("declared")), F.struct(F.col("parent").alias("node"), F.lit(None).cast(T.StringType()).alias("parent"), "ord", F.lit(False).alias("declared")))).alias("r")
    ).select("tree", "r.*").where("node is not null")
    found = both.groupBy("tree", "node").agg(best.alias("b"), F.max("declared").alias("declared"), F.max(~F.col("declared")).alias("inner"))
    return found.select("tree", "node", F.col("b.p").alias("parent"), "declared", "inner")


_WAITS, _RESOLVED, _ORPHAN, _CYCLIC = 0, 1, 2, 3


def hierarchy(links: DataFrame, paths: bool = True, measures: Sequence[str] = (), hot_rows: int = 100_000) -> DataFrame:
    """Resolve ``(tree, node, parent)``, one row a node, to ``(tree, node, root, depth, path, cyclic)``.

    Each round joins every unresolved node with the row of the node it points at, which
    doubles the distance covered and prepends that node's path segment. After round k all
    nodes of depth up to 2^k are resolved; because a node at depth d has ancestors at every
    smaller depth, a round that settles nothing proves that the rest lies on or under a cycle.
    With paths a cycle shows sooner: the segment of the target meets the node's own, so no
    segment grows beyond twice the way round its cycle.

    ``path`` lists the ancestors from the root down to the node itself. Cyclic nodes have NULL
    root and path and depth -1. A parent that has no row of its own is treated as missing:
    its children get ``orphan`` true and NULL root (``parent_links`` never leaves any). Each
    name in ``measures`` is a numeric column whose sum over all proper ancestors is added as
    ``sum_<name>``. An empty input gives an empty result.

    A node is written once more in each round in which it still waits, never after it is settled.
    Only nodes that are parents are joined to (a column ``inner`` of ``links`` may tell them);
    nodes that wait for one hot target are salted.
    """
    none = F.array().cast("array<string>")
    if "inner" not in links.columns:
        named = links.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
        links = links.join(named, ["tree", "node"], "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    own, sums = [f"own_{m}" for m in measures], [f"sum_{m}" for m in measures]
    up = F.col("parent").isNotNull()
    # seg and sum_<m> cover the ancestors strictly between the node and what lies above its pointer
    state = cut(
        links.select(
            "tree", "node", F.col("parent").alias("ptr"), F.when(~up, F.col("node")).alias("root"), up.cast("long").alias("depth"),
            (F.when(up, F.array(F.col("parent").cast("string"))).otherwise(none) if paths else none).alias("seg"),
            F.when(up, _WAITS).otherwise(_RESOLVED).alias("kind"), "inner",
            *[F.col(m).cast("double").alias(o) for m, o in zip(measures, own)], *[F.lit(0.0).alias(s) for s in sums],
        )
    )
    settled, waiting = [state.where(F.col("kind") != _WAITS)], state.where(F.col("kind") == _WAITS)
    left = waiting.count()
    while left:
        all_of = waiting
        for part in settled:
            all_of = all_of.unionByName(part)
        target = all_of.where("inner").select("tree", F.col("node").alias("ptr"), F.struct("ptr", "root", "depth", "seg", "kind", *own, *sums).alias("t"))
        active = waiting.drop("root", "kind")
        # the hot-key count is only worth its shuffle where hot keys can exist
        hop = salted_join(active, target, ["tree", "ptr"], "left", least=hot_rows) if left >= hot_rows else active.join(target, ["tree", "ptr"], "left")
        loops = F.arrays_overlap(F.coalesce("t.seg", none), F.concat("seg", F.array(F.col("node").cast("string")))) if paths else F.lit(False)
        kind = F.when(F.col("t").isNull(), _ORPHAN).when(F.col("t.kind") > _RESOLVED, F.col("t.kind")).when(loops, _CYCLIC).when(F.col("t.kind") == _RESOLVED, _RESOLVED).otherwise(_WAITS)
        hop = hop.withColumn("kind", kind)
        live = F.col("kind") <= _RESOLVED
        step = hop.select(
            "tree", "node", F.col("t.ptr").alias("ptr"), F.when(live, F.col("t.root")).alias("root"), (F.col("depth") + F.coalesce(F.col("t.depth"), F.lit(0))).alias("depth"),
            (F.when(live, F.concat(F.col("t.seg"), F.col("seg"))).otherwise(none) if paths else none).alias("seg"), "kind", "inner", *own,
            *[(F.col(f"sum_{m}") + F.coalesce(F.col(f"t.own_{m}") + F.col(f"t.sum_{m}"), F.lit(0.0))).alias(f"sum_{m}") for m in measures],
        )
        state = cut(step)
        settled.append(state.where(F.col("kind") != _WAITS))
        waiting = state.where(F.col("kind") == _WAITS)
        now = waiting.count()
        if now == left:
            break
        left = now
    out = waiting.withColumn("kind", F.lit(_CYCLIC))
    for part in settled:
        out = out.unionByName(part)
    resolved = F.col("kind") == _RESOLVED
    return out.select(
        "tree",
        "node",
        F.when(resolved, F.col("root")).alias("root"),
        F.when(resolved, F.col("depth")).otherwise(F.lit(-1)).cast("int").alias("depth"),
        *([F.when(resolved, F.concat("seg", F.array(F.col("node").cast("string")))).alias("path")] if paths else []),
        (F.col("kind") == _CYCLIC).alias("cyclic"),
        (F.col("kind") == _ORPHAN).alias("orphan"),
        *[F.when(resolved, F.col(s)).alias(s) for s in sums],
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """``(tree, node, descendant, distance)`` for every proper ancestor-descendant pair, read
    off the paths without a further join. Cyclic nodes have none."""
    return (
        resolved.where("not cyclic and not orphan")
        .select("tree", F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("at", "node"))
        .select("tree", "node", "descendant", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
    )


def course_links(edges: DataFrame) -> DataFrame:
    """Prerequisite links of courses: one tree per document, codes in canonical spelling."""
    return parent_links(edges, F.col("doc"), canonical_code(F.col("dependent")), canonical_code(F.col("prerequisite")), F.col("loaded_at"))
