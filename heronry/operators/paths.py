"""Shortest paths along links, with the steps that lead there.

A search runs breadth first from several starting points at once: each round joins the newest ids with the links, keeps what no round
before has reached, and of several ways to one id the first by starting point and then by the order of links. A round's rows are
written to shared storage, so the plan stays one round long. The number of rounds is the longest shortest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.scratch import discard, persisted


def _both_ways(links: DataFrame) -> DataFrame:
    """from, step: every link from either end; a step is the link's fields (a, b, ...) and the id it leads to."""
    fields = [F.col(c) for c in links.columns]
    way = lambda start, to: links.select(F.col(start).alias("from"), F.struct(*fields, F.col(to).alias("to")).alias("step"))
    return way("a", "b").union(way("b", "a")).filter("from <> step.to").distinct()


def shortest_paths(starts: DataFrame, links: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """page, id, depth and path (array of steps) of every id that a page's starting points reach.

    starts: page, id, rank (which of a page's starting points comes first); a starting point has depth 0 and no step. links: a, b and
    further fields, without direction; their order is that of their fields. Rows with a null id or a null end are left out; repeated
    starts and links change nothing; ids that no link names are reached by themselves alone.
    """
    ways = persisted(_both_ways(links.dropna(subset=["a", "b"])), "path-ways")
    step = ways.schema["step"].dataType.simpleString()
    first = starts.dropna(subset=["page", "id"]).groupBy("page", "id").agg(F.min("rank").alias("rank"))
    newest = persisted(first.select("page", "id", F.struct("rank", F.expr(f"cast(array() AS array<{step}>)").alias("path")).alias("way")), "paths")
    rounds = [newest]
    for _ in range(most_rounds):
        reached = newest.join(ways, F.col("id") == F.col("from")).select("page", F.col("step.to").alias("id"), F.struct("way.rank", F.array_append("way.path", F.col("step")).alias("path")).alias("way"))
        fresh = reached
        for known in rounds[-2:]:  # links have no direction, so what a newest id leads to is new or at most one step back
            fresh = fresh.join(known.select("page", "id"), ["page", "id"], "left_anti")
        newest = persisted(fresh.groupBy("page", "id").agg(F.min("way").alias("way")), "paths")
        if newest.isEmpty():
            discard(newest)
            break
        rounds.append(newest)
    else:
        raise RuntimeError(f"paths did not end in {most_rounds} rounds")
    out = rounds[0]
    for df in rounds[1:]:
        out = out.union(df)
    return out.select("page", "id", F.size("way.path").alias("depth"), F.col("way.path").alias("path"))
