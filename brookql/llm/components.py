"""Connected components of a link table, by randomised contraction.

Each round every node adopts, among itself and its neighbours, the node of least
hashed rank; edges are renamed to the adopted nodes and those that became loops
disappear.  Ranks are hashed anew each round, so a constant share of the nodes is
expected to vanish a round whatever the shape of the graph, and rounds are about
log(nodes).  Every round's tables are written to the shared folder: a lost executor
never replays earlier rounds, and no link is ever brought to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookql.llm.exchange import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links(a, b); a component is named by its least node."""
    edges = stored(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(steps)
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("rank"), F.col(c).alias("node"))
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
        adopted = both.groupBy("node").agg(F.min(rank("other")).alias("best"))
        adopted = adopted.select("node", F.least(rank("node"), F.col("best"))["node"].alias("to"))
        steps.append(adopted := stored(adopted, "adopted"))
        renamed = edges.join(adopted.toDF("a", "to_a"), "a").join(adopted.toDF("b", "to_b"), "b").where("to_a != to_b")
        edges = stored(renamed.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # a node that left in round k was adopted by one that is followed from round k+1 on
    named = reduce(
        lambda done, step: done.join(step.toDF("at", "next"), "at", "left").select("node", F.coalesce("next", "at").alias("at")),
        steps[1:],
        steps[0].toDF("node", "at"),
    )
    named = stored(named, "named")
    return named.join(named.groupBy("at").agg(F.min("node").alias("component")), "at").select("node", "component")
