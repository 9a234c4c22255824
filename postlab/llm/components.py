"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postlab.llm.store import stored


def components(nodes: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node``, ``label``: the smallest node that links reach. ``nodes`` has ``node``; ``links`` has ``a`` and ``b``.

    Each round takes the smallest label among neighbours, then that node's own label, so chains shrink fast. Labels are
    stored each round; only whether any fell comes to the driver. With ``rounds`` it may end early: nodes with
    equal labels are then connected, but not the other way round.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = nodes.select("node", F.col("node").alias("label"))
    done = 0
    while rounds is None or done < rounds:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a, "left").select(
            "node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("lower"))
        via = labels.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        after = stored(lower.join(via, lower.lower == via.via, "left").select(
            "node", "was", F.least("lower", F.coalesce("jump", "lower")).alias("label")), "labels")
        labels = after.select("node", "label")
        done += 1
        if rounds is None and after.filter("label <> was").isEmpty():
            break
    return labels
