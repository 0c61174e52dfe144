"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partledger.llm.common import small, written
from partledger.operators.graph import roots_of


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs to (node, component): the smallest node that each linked node reaches.

    Each round hooks every label to the smallest label that it is linked to, follows the hooks to their roots (pointer
    jumping) and puts the roots in place of the labels in the links, until no link is left. A label that nothing is
    hooked to hooks itself one round later, so two rounds at least halve the open labels: rounds grow with the
    logarithm of the nodes, whatever the order of ids along a chain. Everything stays distributed: the minimum is taken by
    partial aggregation, so a node with very many links costs no single task. Nodes without links and null ends are
    not in the result.
    """
    links = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        low = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("parent")).distinct())
        roots = roots_of(written(low.groupBy("node").agg(F.min("parent").alias("parent")), "parents"), written)
        if labels is None:
            labels = roots
        else:
            of = small(roots.select(F.col("node").alias("label"), F.col("component").alias("root")))
            labels = written(labels.join(of, F.col("component") == F.col("label"), "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        root = lambda end: small(roots.select(F.col("node").alias(end), F.col("component").alias(f"root_{end}")))
        ends = links.join(root("a"), "a").join(root("b"), "b").filter("root_a <> root_b")
        links = written(ends.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "links")
        if links.limit(1).count() == 0:
            return labels
