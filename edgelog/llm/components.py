"""Connected components of an undirected link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b longs): label is the smallest node of its component.

    Every round takes the smallest label among the neighbours and then the label of that label, so the reach doubles;
    links between a group and its representative settle in two or three rounds.  Hot nodes are no problem: the minimum
    is pre-aggregated and skewed joins are split.  Each round starts from a written table.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    state = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (both.join(state, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low")))
        moved = state.join(near, "node").select("node", F.least("label", "low").alias("low"), F.col("label").alias("was"))
        of = state.select(F.col("node").alias("at"), F.col("label").alias("next"))
        # a node may be no neighbour of its label, but its label is a node of the table
        new = stored(moved.join(of, F.col("low") == F.col("at")).select("node", F.least("low", "next").alias("label"), "was"), "labels")
        changed = new.where("label != was").limit(1).count()
        state = new.select("node", "label")
        if not changed:
            return state
