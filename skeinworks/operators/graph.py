"""Graph operators over node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Stage


def edge_dedup(edges: DataFrame, a: str, b: str, weight: str, relation: str, description: str | None = None, sep: str = "<SEP>") -> DataFrame:
    """One edge an unordered pair: summed weight, relations in order, distinct descriptions in relation order."""
    d = F.col(description) if description else F.lit(None).cast("string")
    e = edges.select(F.least(a, b).alias("source"), F.greatest(a, b).alias("target"), F.coalesce(F.nullif(F.col(weight), F.lit(0)), F.lit(1)).alias("w"), F.col(relation).alias("r"), d.alias("d"))
    g = e.groupBy("source", "target").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("n_relations"), F.array_sort(F.collect_list(F.struct("r", "d"))).alias("x"))
    texts = F.array_distinct(F.filter(F.transform("x", lambda s: s["d"]), lambda s: s.isNotNull()))
    return g.select("source", "target", "weight", "n_relations", F.array_join(texts, sep).alias("descriptions"))


def rewrite_edges(edges: DataFrame, a: str, b: str, mapping: DataFrame, item: str, entity: str) -> DataFrame:
    """Edges with ends replaced by entities; loops made by merging two different items are dropped, loops that were there stay."""
    m = mapping.select(F.col(item).alias("_i"), F.col(entity).alias("_e"))
    out = edges.join(m.withColumnsRenamed({"_i": a, "_e": "source_entity"}), a).join(m.withColumnsRenamed({"_i": b, "_e": "target_entity"}), b)
    return out.where((F.col("source_entity") != F.col("target_entity")) | (F.col(a) == F.col(b)))


def components(edges: DataFrame, a: str = "source", b: str = "target", max_rounds: int = 200) -> DataFrame:
    """``(node, component)``: the smallest node connected to each, for nodes with an edge; loops do not count.

    Alternates star operations: every node's larger neighbours, then its smaller ones,
    are hung on its smallest neighbour, which halves paths and ends in stars. Rounds
    are staged in the shared folder and stop when nothing moves.
    """
    stage = Stage(edges.sparkSession, "components")
    e = edges.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    cur = stage.write(e, "edges")

    def star(df: DataFrame, large: bool) -> DataFrame:
        near = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = near.join(low, "u")
        hung = hung.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            hung = hung.unionByName(low.select("u", F.col("m").alias("v")))
        return hung.where("u <> v").distinct()

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    before = mark(cur)
    for _ in range(max_rounds):
        nxt = stage.write(star(stage.write(star(cur, True), "large"), False), "small")
        now = mark(nxt)
        stage.drop(cur)
        cur = nxt
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def degrees(nodes: DataFrame, node: str, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Degree of every node of a simple graph; a loop counts twice."""
    e = edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
    ends = e.select(F.col("x").alias(node)).unionByName(e.select(F.col("y").alias(node)))
    d = ends.groupBy(node).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select(node).distinct().join(d, node, "left").select(node, F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def topology(nodes: DataFrame, node: str, edges: DataFrame, a: str, b: str, labels: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, components, isolates, largest component, average degree, density, loops."""
    n = nodes.select(F.col(node).alias("node")).distinct()
    e = edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    real = e.where("x <> y").distinct()
    comp = labels if labels is not None else components(real, "x", "y")
    sizes = n.join(comp, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.count(F.lit(1)).alias("s"), F.max(F.col("component").isNull().cast("int")).alias("lone"))
    s = sizes.agg(F.count(F.lit(1)).alias("components"), F.max("s").alias("largest_component"), F.coalesce(F.sum("lone"), F.lit(0)).alias("isolates"), F.sum("s").alias("nodes"))
    counts = e.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum((F.col("x") == F.col("y")).cast("int")), F.lit(0)).alias("loops")).crossJoin(real.agg(F.count(F.lit(1)).alias("simple_edges")))
    out = s.crossJoin(counts)
    return out.select(
        "nodes", "edges", "components", "isolates", "largest_component", "loops",
        F.round(F.try_divide(F.lit(2) * F.col("edges"), F.col("nodes")), 6).alias("average_degree"),
        F.round(F.try_divide(F.lit(2.0) * F.col("simple_edges"), F.col("nodes") * (F.col("nodes") - 1)), 6).alias("density"),
    )


def transitivity(edges: DataFrame, a: str, b: str) -> DataFrame:
    """One row: triangles, triads and 3 triangles / triads.

    Edges point from the end of lower degree, so no node points to more than the square
    root of twice the edges; a triangle is a neighbour that both ends of an edge point to.
    """
    stage = Stage(edges.sparkSession, "triangles")
    e = stage.write(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct(), "edges")
    d = e.select(F.col("x").alias("n")).unionByName(e.select(F.col("y").alias("n"))).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    ranked = e.join(d.withColumnsRenamed({"n": "x", "d": "dx"}), "x").join(d.withColumnsRenamed({"n": "y", "d": "dy"}), "y")
    first = (F.col("dx") < F.col("dy")) | ((F.col("dx") == F.col("dy")) & (F.col("x") < F.col("y")))
    o = stage.write(ranked.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("p"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("q")), "oriented")
    near = o.groupBy("p").agg(F.collect_list("q").alias("near"))
    ends = o.join(near, "p").join(near.withColumnsRenamed({"p": "q", "near": "far"}), "q")
    tri = ends.agg(F.coalesce(F.sum(F.size(F.array_intersect("near", "far"))), F.lit(0)).alias("triangles"))
    triads = d.agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0.0)).cast("long").alias("triads"))
    return tri.crossJoin(triads).select("triangles", "triads", F.round(F.coalesce(F.try_divide(3.0 * F.col("triangles"), F.col("triads")), F.lit(0.0)), 6).alias("transitivity"))


def jaccard_matrix(members: DataFrame, group: str, item: str) -> DataFrame:
    """Shared items and Jaccard similarity of every two groups (left <= right)."""
    m = members.select(F.col(group).alias("g"), F.col(item).alias("i")).dropna().distinct()
    size = m.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    both = m.withColumnRenamed("g", "l").join(m.withColumnRenamed("g", "r"), "i").where("l <= r").groupBy("l", "r").agg(F.count(F.lit(1)).alias("shared"))
    grid = size.withColumnsRenamed({"g": "l", "n": "ln"}).crossJoin(size.withColumnsRenamed({"g": "r", "n": "rn"})).where("l <= r")
    out = grid.join(both, ["l", "r"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return out.select(F.col("l").alias("left_group"), F.col("r").alias("right_group"), "shared", F.round(F.col("shared") / (F.col("ln") + F.col("rn") - F.col("shared")), 6).alias("jaccard"))


def integrity(nodes: DataFrame, node: str, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Violations by check: duplicate and blank nodes, duplicate edges, dangling ends, loops."""
    n = nodes.select(F.col(node).alias("n"))
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    ends = e.select(F.col("x").alias("n")).unionByName(e.select(F.col("y").alias("n")))
    checks = {
        "blank_nodes": n.where("n is null or trim(cast(n as string)) = ''"),
        "dangling_ends": ends.join(n.distinct(), "n", "left_anti"),
        "duplicate_edges": e.groupBy(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).count().where("count > 1"),
        "duplicate_nodes": n.groupBy("n").count().where("count > 1"),
        "loops": e.where("x = y"),
    }
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def paired_change(values: DataFrame, key: Sequence[str], regime: str, left: str, right: str, value: str) -> DataFrame:
    """Absolute and relative change of a value from one regime to another."""
    p = values.groupBy(*key).pivot(regime, [left, right]).agg(F.first(value))
    a, b = F.col(f"`{left}`"), F.col(f"`{right}`")
    return p.select(*key, a.alias("left_value"), b.alias("right_value"), (b - a).alias("change"), F.try_divide(F.lit(100.0) * (b - a), a).alias("percent"))


def ccdf(values: DataFrame, value: str) -> DataFrame:
    """Share of positive values at or above each distinct one, without ordering all rows in one task."""
    v = values.where(F.col(value) > 0).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    total = v.agg(F.sum("n").alias("total"))
    return v.withColumn("at_least", F.sum("n").over(w)).crossJoin(total).select("value", "n", F.round(F.col("at_least") / F.col("total"), 6).alias("share"))
