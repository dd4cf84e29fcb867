"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_scratch, materialize


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of ``links`` (a, b).

    Each round a node takes the smallest label around it, hands it on to the
    node that its old label names (hooking), and then takes its label's own
    label (pointer jumping).  So whole trees of labels move at once and the
    number of rounds grows with the logarithm of a component's width, in
    whatever order a chain's ids come.  Hooks are pre-aggregated by label
    before their shuffle.  Labels are written to scratch tables, one a round.
    An empty link table gives no rows.
    """
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = edges.join(labels.withColumnsRenamed({"node": "b", "label": "near"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        best = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("was"))
        hooks = best.filter("new < was").groupBy(F.col("was").alias("node")).agg(F.min("new").alias("hook"))
        best = best.join(hooks, "node", "left").select("node", F.least("new", "hook").alias("new"), "was")
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("up"))
        jumped = best.join(up, "new", "left").select("node", F.least("new", F.coalesce("up", "new")).alias("label"), "was")
        after = materialize(jumped, "labels")
        moved = after.filter("label <> was").limit(1).count()
        drop_scratch(labels)
        labels = after
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    drop_scratch(edges)
    out = labels.select("node", "label")
    out._scratch = labels._scratch
    return out
