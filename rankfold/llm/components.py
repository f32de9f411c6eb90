"""Connected components of an edge list by alternating large and small stars.

Each round is two aggregations and two joins over the edge list; the number of
rounds grows with the logarithm of the component sizes. Rounds end when every
edge leads to a root, so edges that are stars already take none. No component is ever
held by one task: the stars are edges, the minimum per node is a partial
(map-side combined) aggregate, and the join on a hub node is an ordinary
equi-join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import materialise

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    sym = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = sym.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return sym.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")) \
        .where("src <> dst").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("m"))
    return down.join(low, "src").select(F.explode(F.array(
        F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")),
        F.struct(F.col("src").alias("src"), F.col("m").alias("dst")))).alias("x")) \
        .select("x.src", "x.dst").where("src <> dst").distinct()


def _all_stars(e: DataFrame) -> bool:
    """Whether every src of distinct edges (src > dst) has one edge, and none is a dst."""
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                      F.struct(F.col("dst").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
                                      )).alias("x")).select("x.*")
    inner = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
    return not inner.limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (src long, dst long) -> (node, component): the smallest id
    reachable. Self-loops, repeats and either direction are fine; null ends are
    ignored; ids without an edge to another id do not appear."""
    e = materialise(edges.where("src is not null and dst is not null and src <> dst")
                    .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc")
    for _ in range(MAX_ROUNDS):
        if _all_stars(e):
            break
        e = materialise(_small_star(_large_star(e)), "cc")
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
