"""Overlap graphs as edge tables ``(src, dst, n)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.session import cut


def edges_from_overlaps(pairs: DataFrame, src: str, dst: str, both_strands: bool = False) -> DataFrame:
    """Edges with the number of overlaps behind them. With both strands each vertex v is 2v forward and 2v+1 reverse, and an edge a -> b
    brings its twin b' -> a'. Rows with a null end are dropped."""
    e = pairs.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).dropna()
    if both_strands:
        e = e.select((F.col("src") * 2).alias("src"), (F.col("dst") * 2).alias("dst")).unionByName(e.select((F.col("dst") * 2 + 1).alias("src"), (F.col("src") * 2 + 1).alias("dst")))
    return e.groupBy("src", "dst").agg(F.count("*").alias("n"))


def consecutive_pairs(df: DataFrame, by: str, order: list[str], vertex: str) -> DataFrame:
    """Vertices that follow each other within a group, as ``(src, dst)``."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(*order)
    return df.select(F.lag(vertex).over(w).alias("src"), F.col(vertex).alias("dst")).where("src is not null")


def drop_low_coverage(edges: DataFrame, least: int) -> DataFrame:
    return edges.where(F.col("n") >= least)


def transitive_reduction(edges: DataFrame, radius: int = 2) -> DataFrame:
    """Without the edges a -> c that a path of 2 to ``radius`` other edges also gives. Self loops stay and make no path; all
    edges are judged against the whole graph, so the result doesn't depend on an order."""
    plain = edges.where("src <> dst").select("src", "dst").distinct()
    paths, reach = plain, None
    for _ in range(radius - 1):
        step = plain.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
        paths = paths.join(step, "dst").select("src", F.col("_next").alias("dst")).where("src <> dst").distinct()
        reach = paths if reach is None else reach.unionByName(paths)
    return edges if reach is None else edges.join(reach.distinct(), ["src", "dst"], "left_anti")


def trim_tips(edges: DataFrame, rounds: int = 1) -> DataFrame:
    """Without tips: edges from a source (nothing comes in) to a vertex that others reach too, and edges into a sink from a vertex
    that also leads elsewhere; ``rounds`` times. A path that stands alone is no tip."""
    for i in range(rounds):
        ins = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("n_in"))
        outs = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n_out"))
        degree = ins.join(outs, "v", "full_outer").fillna(0)
        d = lambda c, p: degree.select(F.col("v").alias(c), F.col("n_in").alias(f"{p}_in"), F.col("n_out").alias(f"{p}_out"))
        full = edges.join(d("src", "s"), "src").join(d("dst", "d"), "dst")
        tip = (F.col("s_in") == 0) & (F.col("d_in") > 1) | (F.col("d_out") == 0) & (F.col("s_out") > 1)
        edges = full.where(~tip).select("src", "dst", "n")
        if rounds > 1:
            edges = cut(edges)
    return edges


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(v, component)``: the smallest vertex each can reach, edges taken both ways.

    Alternating star contraction: every round links each vertex's larger neighbours, then its smaller ones, to the least vertex around it;
    hubs are never collected, and rounds grow with the logarithm of the longest path. Each round is checkpointed.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    vertices = edges.select(F.col("src").alias("v")).unionByName(edges.select(F.col("dst").alias("v"))).distinct()
    e = cut(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("src", "m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").unionByName(low.select("src", F.col("m").alias("dst"))).distinct()
        new = cut(small)
        moved = new.exceptAll(e).limit(1).count() or e.exceptAll(new).limit(1).count()
        e = new
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    return vertices.join(e.groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("component")), "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def simple_paths(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(v, path, place)``: vertices of unbranched stretches (each has one way in and one way out between them), by pointer doubling.

    ``path`` is the first vertex; cycles without a branch are left out. Every vertex is in one path.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    one_out = e.groupBy("src").agg(F.count("*").alias("k"), F.min("dst").alias("dst")).where("k = 1").drop("k")
    one_in = e.groupBy("dst").agg(F.count("*").alias("k")).where("k = 1").select("dst")
    back = one_out.join(one_in, "dst", "left_semi").select(F.col("dst").alias("v"), F.col("src").alias("up"))
    vertices = e.select(F.col("src").alias("v")).unionByName(e.select(F.col("dst").alias("v"))).distinct()
    at = cut(vertices.join(back, "v", "left").select("v", F.coalesce("up", "v").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("place")))
    for _ in range(max_rounds):
        up = at.select(F.col("v").alias("up"), F.col("up").alias("_far"), F.col("place").alias("_more"))
        new = cut(at.join(up, "up").select("v", F.col("_far").alias("up"), (F.col("place") + F.col("_more")).alias("place"), (F.col("_far") != F.col("up")).alias("_moved")))
        moved = new.where("_moved").limit(1).count()
        at = new.drop("_moved")
        if not moved:
            break
    heads = vertices.join(back, "v", "left_anti").select(F.col("v").alias("up"))
    return at.join(heads, "up", "left_semi").select("v", F.col("up").alias("path"), "place")


def flow_balance(edges: DataFrame) -> DataFrame:
    """``(v, n_in, n_out, surplus)``: counts in and out of every vertex."""
    ins = edges.groupBy(F.col("dst").alias("v")).agg(F.sum("n").alias("n_in"))
    outs = edges.groupBy(F.col("src").alias("v")).agg(F.sum("n").alias("n_out"))
    return ins.join(outs, "v", "full_outer").fillna(0).withColumn("surplus", F.col("n_out") - F.col("n_in"))


def dot_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(" -> "), F.col("dst").cast("string"), F.lit(' [label="'), F.col("n").cast("string"), F.lit('"];')).alias("line"))
