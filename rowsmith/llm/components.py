"""Connected components of an edge table by alternating stars (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import stored


def _star(edges: DataFrame, smaller: bool) -> DataFrame:
    """Links the neighbours of every node to its least one: the larger neighbours (large star)
    or the smaller ones and itself (small star). Minima are aggregated before the join back."""
    if smaller:
        e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        e = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, so that both sides of the join are plain shuffles and AQE can split a star's centre
    least = stored(e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    j = e.join(least, "a")
    if smaller:
        out = j.select(F.col("b").alias("x"), "m").unionAll(j.select(F.col("a").alias("x"), "m"))
    else:
        out = j.filter(F.col("b") > F.col("a")).select(F.col("b").alias("x"), "m")
    out = out.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
    return out.distinct() if smaller else out


def _is_stars(e: DataFrame) -> bool:
    """Whether every node has one link and none leads to a node that leads on."""
    twice = e.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    onward = e.select(F.col("b").alias("a")).join(e.select("a"), "a", "left_semi")
    return twice.unionAll(onward).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b: long); a component is named by its
    least node. Rounds go on until every node is linked to its component's least node only; each
    is written to the shared scratch folder, so a lost executor repeats one round at most."""
    e = stored(edges.filter("a <> b").distinct(), "links")
    while True:
        e = stored(_star(_star(e, False), True), "links")
        if _is_stars(e):
            break
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return stored(e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components", narrow=True)
