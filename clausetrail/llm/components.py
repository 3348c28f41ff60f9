"""Connected components of a link table, by alternating large-star and small-star steps.

Each step points every node at the smallest node it knows of, by grouping and joining; no node's
neighbours are ever collected.  Steps are written to the shared folder, so the plan stays short and a
lost executor costs no step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausetrail.llm.common import stage


def _to_smallest(links: DataFrame, keep: str) -> DataFrame:
    """links (u, v) in both directions: each v that ``keep`` selects is linked to u's smallest."""
    smallest = links.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    moved = links.join(smallest, "u").filter(keep).select(F.col("v").alias("u"), F.col("low").alias("v"))
    own = smallest.filter("low < u").select("u", F.col("low").alias("v"))
    return moved.unionByName(own).filter("u > v").distinct() if keep == "v < u" else moved.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: node numbers u and v, in any order.  Returns node, root (smallest node of its component).

    Only nodes with a link to another node are returned.
    """
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    links = stage(links, "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(_to_smallest(both, "v > u"), "large-star")
        links = stage(_to_smallest(large, "v < u"), "small-star")
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
