"""Connected components by alternating large and small stars: distributed union-find in a logarithmic number of rounds.

Each round moves every edge towards the smallest id its end knows; nothing but edges is kept, and each round is written to shared
storage, so the plan stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from heronry.scratch import discard, persisted


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")  # the small star removes repeats


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: (a, b) of one orderable type. Rows (id, root) for every id of an edge; root is the component's smallest id.

    Edges with a null end or equal ends only name their id; repeated edges change nothing.
    """
    known = edges.select("a", "b").dropna()

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        """df in shared storage, and a mark of its rows that the same job has taken."""
        seen = Observation()
        sums = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")]
        out = persisted(df.observe(seen, *sums), "edges")
        return out, (seen.get["n"], seen.get["s"])

    current, mark = written(known.filter("a <> b").distinct())
    for _ in range(most_rounds):
        before, last = current, mark
        current, mark = written(_small_star(_large_star(current)))
        discard(before)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("root")).union(current.select(F.col("a").alias("id"), F.col("b").alias("root"))).distinct()
    alone = known.filter("a = b").select(F.col("a").alias("id")).distinct().join(roots, "id", "left_anti").select("id", F.col("id").alias("root"))
    return roots.union(alone)
