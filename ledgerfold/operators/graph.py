"""Graph jobs on edge lists: connected components and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ledgerfold.operators.skew import hot_keys, salted_join
from ledgerfold.session import discard, materialize


def _star(edges: DataFrame, large: bool, hubs: list) -> DataFrame:
    """One star step. ``edges`` holds (u, v); large stars look at all neighbours, small ones at the smaller ones.

    The minimum of each neighbourhood is aggregated before it is joined back, and the join spreads the edges of ``hubs``.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return salted_join(both.where("v > u"), low, "u", hubs).select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return salted_join(down, low, "u", hubs).select("v", "m").union(low.select("u", "m")).toDF("u", "v")


def _settled(edges: DataFrame) -> DataFrame:
    """(vertex, component) of a bounded edge list (u, v) of integers, by union-find in one task."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        of = None
        for b in batches:
            of = b.schema.field("u").type
            for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
                u, v = root(u), root(v)
                up[max(u, v)] = min(u, v)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), of), pa.array([root(x) for x in list(up)], of)], ["vertex", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"vertex {kind}, component {kind}")


def connected_components(edges: DataFrame, max_rounds: int = 50, few: int = 0) -> DataFrame:
    """Label every vertex of an undirected edge list with the smallest vertex it can reach.

    ``edges`` has two columns of one comparable type; nulls and self-loops are ignored and repeated edges
    count once. Returns (vertex, component) for vertices that have an edge. Alternating large-star and
    small-star steps halve path lengths each round; every round is written to the shared folder, so lineage
    stays short and no edge list visits the driver. Vertices with very many edges (fewer than 1,000 can have that many) are salted.
    An edge list of at most ``few`` edges between integers is settled by one task instead: rounds over a small list are thousands of
    tasks without rows, of each of which the driver keeps a record.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        n = e.count()
        if n <= few and isinstance(e.schema["u"].dataType, IntegralType):
            return _settled(e)
        ends = e.select("u").union(e.select("v")).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        hubs = hot_keys(ends, "u", n)
        last, e = e, materialize(_star(_star(e, True, hubs), False, hubs).where("u != v").distinct())
        discard(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def merge_links(labels: DataFrame | None, links: DataFrame, few: int = 0) -> tuple[DataFrame, DataFrame]:
    """(changes, fresh): how new links change stored labels (vertex, component); together with the labels that stay they equal a full run.

    Links are contracted to links between labels, so components are found over groups that a link touches, and no stored link is read. ``changes``
    has (component, new) of stored groups that get a smaller label, ``fresh`` the labels of vertices that weren't stored. Labels are smallest
    vertices, as of ``connected_components``, to which ``few`` goes; so few links are contracted in one task, too.
    """
    a, b = links.columns[:2]
    new = materialize(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v").distinct())
    small = few > 0 and new.count() <= few
    new = new.coalesce(1) if small else new
    ends = new.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    if labels is None:
        labels = ends.select("vertex", F.col("vertex").alias("component")).limit(0)
    # each end stands for its group: a stored vertex for its label, another one for itself
    known = materialize(ends.join(labels, "vertex", "left").select("vertex", "component", F.coalesce("component", "vertex").alias("group")))
    known = known.coalesce(1) if small else known
    side = known.select("vertex", "group")
    between = new.join(side.toDF("u", "gu"), "u").join(side.toDF("v", "gv"), "v").where("gu != gv").select("gu", "gv").distinct()
    joined = materialize(connected_components(between, few=few).toDF("group", "label"))
    joined = joined.coalesce(1) if small else joined
    changes = joined.join(known.where("component is not null").select("group").distinct(), "group", "left_semi").where("label != group").toDF("component", "new")
    fresh = known.where("component is null").join(joined, "group", "left").select("vertex", F.coalesce("label", "group").alias("component"))
    return changes, fresh


def apply_links(labels: DataFrame | None, links: DataFrame, few: int = 0) -> DataFrame:
    """All labels after new links: stored ones with their changes, and fresh ones.

    To keep a stored table current, write only the rows whose component is in ``merge_links``' changes, and the fresh ones.
    """
    changes, fresh = merge_links(labels, links, few)
    if labels is None:
        return fresh
    moved = labels.join(changes, "component", "left").select("vertex", F.coalesce("new", "component").alias("component"))
    return moved.unionByName(fresh)


def pointer_jump(parents: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """Root and depth of every node of a forest given as (node, parent), null parent for roots.

    A parent that is not itself a node ends the chain and counts as the root. Each doubling self-join halves the
    chains that are left, until none is; pointers that still move after as many hops as there are nodes are on a
    cycle or lead into one, and such nodes become their own root with depth 0. Returns (node, root, depth).
    """
    p = parents.select(F.col(node).alias("node"), F.col(parent).alias("parent")).dropDuplicates(["node"])
    first = F.when(F.col("parent").isNull() | (F.col("parent") == F.col("node")), F.lit(0)).otherwise(1).cast("long")
    # ``open`` says that the pointer may move on; hops count towards the depth
    cur = materialize(p.select("node", F.coalesce("parent", "node").alias("up"), first.alias("hops"), (first > 0).alias("open")))
    total, reach = cur.count(), 1
    while reach <= 2 * total and not cur.where("open").isEmpty():
        ahead = cur.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("open").alias("open2"))
        moved = cur.where("open").join(ahead, "up", "left")
        moved = moved.select("node", F.coalesce("up2", "up").alias("up"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.coalesce("open2", F.lit(False)).alias("open"))
        last, cur = cur, materialize(cur.where("not open").unionByName(moved))
        discard(last)
        reach *= 2
    return cur.select("node", F.when(~F.col("open"), F.col("up")).otherwise(F.col("node")).alias("root"), F.when(~F.col("open"), F.col("hops")).otherwise(0).alias("depth"))
