"""Connected components of a link table by repeated contraction.

Each round hooks every node to its smallest neighbour, follows the pointers to their roots by doubling, and rewrites the
links between roots. The nodes that still have links at least halve from round to round. Every table of a round is written to the shared folder,
so each join meets plain exchanges that Spark may split where a node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.plans.shared import write_shared


def _roots(parents: DataFrame) -> DataFrame:
    """(node, parent) with parent <= node to (node, parent = root), by pointer doubling."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = write_shared(parents.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), "cc-jump")
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a, b) of comparable ids to (node, root): the smallest node of its component, for every node with a link."""
    links = write_shared(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    done = None
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        hooked = write_shared(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent")), "cc-hook")
        roots = _roots(hooked)
        if done is None:
            done = roots.select("node", F.col("parent").alias("root"))
        else:
            over = roots.select(F.col("node").alias("root"), F.col("parent").alias("new_root"))
            done = write_shared(done.join(over, "root", "left").select("node", F.coalesce("new_root", "root").alias("root")), "cc-done")
        left, right = (roots.select(F.col("node").alias(c), F.col("parent").alias(f"root_{c}")) for c in ("a", "b"))
        half = write_shared(links.join(left, "a").select("root_a", "b"), "cc-half")
        links = write_shared(half.join(right, "b").filter("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "cc-links")
    return done if done is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
