"""Components, spanning trees and neighbours over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybox.operators.work import written


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, by least labels and pointer jumping.

    Each round is written to the shared folder; only a count comes to the driver.
    """
    both = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    label = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("l")).withColumnRenamed("u", "node"), "labels")
    for _ in range(rounds):
        near = both.join(label.select(F.col("node").alias("v"), "l"), "v").groupBy(F.col("u").alias("node")).agg(F.min("l").alias("m"))
        step = label.join(near, "node").select("node", "l", F.least("l", "m").alias("n"))
        jump = step.select(F.col("node").alias("n"), F.col("n").alias("j"))
        after = written(step.join(jump, "n").select("node", "l", F.least("n", "j").alias("m")), "labels")
        changed = after.where("m < l").limit(1).count()
        label = after.select("node", F.col("m").alias("l"))
        if not changed:
            return label.select("node", F.col("l").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


#: Edges of a group whose components, or nodes of a group whose tree, one task finds.
MOST = 500_000


class Sets:
    """Disjoint sets of keys, each named by its least."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        p, q = self.find(a), self.find(b)
        self.up.setdefault(p, p)
        if p == q:
            return False
        self.up[max(p, q)] = min(p, q)
        self.up.setdefault(min(p, q), min(p, q))
        return True


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) from (group, a, b) by group; only the group at hand is held."""
    group, sets = object(), Sets()

    def out(sets: Sets) -> pa.RecordBatch:
        nodes = list(sets.up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(sets.find, nodes)), pa.int64())], ["node", "component"])

    for batch in batches:
        for of, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if of != group:
                if sets.up:
                    yield out(sets)
                group, sets = of, Sets()
            for x in (a, b):
                sets.up.setdefault(x, x)
            sets.join(a, b)
    yield out(sets)


def components_within(edges: DataFrame, group: str = "group", most: int = MOST) -> DataFrame:
    """(node, component) of edges (group, a, b) with long keys whose two ends are in one group.

    The edges of a group of ``most`` or fewer meet in one pass, after one shuffle; only larger groups
    go through rounds over all tasks.
    """
    edges = written(edges.select(group, F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")), "edges")
    n = edges.groupBy(F.col(group).alias("of")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    same = F.col(group).eqNullSafe(F.col("of"))
    found = edges.join(n, same, "left_anti").repartition(group).sortWithinPartitions(group).mapInArrow(_joined, "node bigint, component bigint")
    return found if n.isEmpty() else found.unionByName(components(edges.join(n, same, "left_semi")))


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each group's least tree, from (g, part, w, a, b) by group and part and rising within it: Kruskal's way. Only sets of nodes are held."""
    group, sets = object(), Sets()
    for batch in batches:
        keep = []
        for k, (g, part, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "part", "a", "b")), strict=True)):
            if (g, part) != group:
                group, sets = (g, part), Sets()
            if sets.join(a, b):
                keep.append(k)
        kept = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("g", "a", "b", "w")], ["g", "a", "b", "w"])


def spanning_trees(edges: DataFrame, nodes: DataFrame, each: int = 200_000, most: int = MOST) -> DataFrame:
    """(a, b, w): minimum spanning forest of (g, a, b, w) with long keys, ties by ends; no edge leaves its group g.

    nodes: (g, n), how many nodes a group has. Parts of about ``each`` edges hand on the edges of their
    own least trees, since others are in no least tree; then a group is one part. Groups of more
    than ``most`` nodes are finished by rounds over all tasks instead.
    """
    sized = nodes.select(F.col("g").alias("of"), F.col("n").alias("nodes"))
    same = F.col("g").eqNullSafe(F.col("of"))
    edges = edges.select("g", F.least("a", "b").cast("bigint").alias("a"), F.greatest("a", "b").cast("bigint").alias("b"), "w")
    rest = written(edges, "edges")

    def least(rows: DataFrame, part: Column) -> DataFrame:
        dealt = rows.withColumn("part", part).repartition("g", "part").sortWithinPartitions("g", "part", "w", "a", "b")
        return dealt.select("g", "part", "w", "a", "b").mapInArrow(_light, "g bigint, a bigint, b bigint, w double")

    counts = rest.groupBy(F.col("g").alias("in_")).agg(F.ceil(F.count("*") / each).cast("bigint").alias("parts"))
    parted = rest.join(counts, F.col("g").eqNullSafe(F.col("in_")))
    few = written(least(parted, F.pmod(F.xxhash64("a", "b"), F.col("parts"))).select("g", "a", "b", "w"), "few-edges")
    done = least(few.join(sized.where(F.col("nodes") <= most), same, "left_semi"), F.lit(0)).select("a", "b", "w")
    large = few.join(sized.where(F.col("nodes") > most), same, "left_semi").select("a", "b", "w")
    return done if large.isEmpty() else done.unionByName(spanning_tree(large))


def spanning_tree(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Minimum spanning forest of (a, b, w), by Boruvka: every component takes its lightest edge, ties by ends."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w"), "edges")
    home = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("c", F.col("node")), "home")
    tree = None
    for _ in range(rounds):
        at = edges.join(home.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(home.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").where("ca <> cb")
        ends = at.select("ca", "a", "b", "w").unionByName(at.select(F.col("cb").alias("ca"), "a", "b", "w"))
        pick = written(ends.groupBy("ca").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.a", "e.b", "e.w").distinct(), "picked")
        if pick.isEmpty():
            break
        tree = pick if tree is None else written(tree.unionByName(pick).distinct(), "tree")
        home = written(components(tree).select("node", F.col("component").alias("c")), "home")
    else:
        raise RuntimeError(f"the tree is not complete after {rounds} rounds")
    return edges.limit(0) if tree is None else tree


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(left: DataFrame, right: DataFrame, on: str, x: str, y: str, key: str, reach: float) -> DataFrame:
    """For each row of ``left`` the nearest row of ``right`` in its group, at most ``reach`` away, and on which side it lies.

    The plane is cut into cells of that width, so a row meets those of its cell and the
    eight around it only. Of equals the smaller key. side_x and side_y are 1 where the
    row lies beyond its neighbour. Rows without a neighbour are left out.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = left.select(on, F.col(key).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay")).withColumns({"cx": cell("ax"), "cy": cell("ay")})
    b = right.select(on, F.col(key).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by")).withColumn("o", around)
    b = b.withColumns({"cx": cell("bx") + F.col("o.i"), "cy": cell("by") + F.col("o.j")}).drop("o")
    far = F.pow(F.col("ax") - F.col("bx"), F.lit(2)) + F.pow(F.col("ay") - F.col("by"), F.lit(2))
    near = a.join(b, [on, "cx", "cy"]).where("a <> b").withColumn("far", far).where(F.col("far") <= reach * reach)
    best = near.groupBy(on, "a").agg(F.min(F.struct("far", "b", "ax", "ay", "bx", "by")).alias("n"))
    side = lambda c: F.signum(F.col(f"n.a{c}") - F.col(f"n.b{c}")).cast("int").alias(f"side_{c}")
    return best.select(on, "a", F.col("n.b").alias("b"), F.sqrt("n.far").alias("distance"), side("x"), side("y"))
