"""Connected components of names or ids that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partledger.sources.shared import shared_path


def _kept(df: DataFrame, kind: str) -> DataFrame:
    """df computed once, in the shared folder, so that rounds do not repeat the earlier ones."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def roots_of(parents: DataFrame, keep) -> DataFrame:
    """(node, component) from (node, parent) without circles but for roots, which are their own parents: the root of each node.

    Each round replaces a parent by its own parent, so rounds grow with the logarithm of the longest way to a root.
    keep computes a table once, given it and a name.
    """
    while True:
        of = parents.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
        step = keep(parents.join(of, "parent").select("node", "parent", "further"), "roots")
        if step.filter("parent <> further").limit(1).count() == 0:
            return step.select("node", F.col("further").alias("component"))
        parents = step.select("node", F.col("further").alias("parent"))


def shared_key_components(members: DataFrame, node: str, key: str) -> DataFrame:
    """(node, component): nodes that share a key, or are joined by such sharing, have their smallest node as component.

    In each round a key takes the smallest label of its nodes, every label is hooked to the smallest of its keys' and
    followed to its root, and the links are those of the roots that are left; no pairs of nodes are made, however
    many share a key. A label that nothing is hooked to hooks itself one round later, so two rounds at least halve the open
    labels and the loop ends by itself.
    """
    links = _kept(members.select(F.col(node).alias("node"), F.col(key).alias("key")).filter("key is not null").distinct(), "links")
    labels = links.select("node", F.col("node").alias("component")).distinct()
    while True:
        sizes = links.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
        open_ = _kept(links.join(sizes.filter("low <> high").select("key", "low"), "key"), "open")
        if open_.limit(1).count() == 0:
            return labels
        roots = roots_of(_kept(open_.groupBy("node").agg(F.min("low").alias("parent")), "parents"), _kept)
        of = roots.select(F.col("node").alias("label"), F.col("component").alias("root"))
        labels = _kept(labels.join(of, F.col("component") == F.col("label"), "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        links = _kept(open_.join(roots, "node").select(F.col("component").alias("node"), "key").distinct(), "links")
