"""Connected components and merged duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.ordinals import with_ordinal
from loomspark.storage import released, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of edges (a, b), component being the smallest node reachable.

    Nodes take the smallest label near them, then their label's label, until
    nothing changes: few rounds even for long chains. Labels are written each
    round, so lineage stays short and lost executors cost nothing.
    """
    both = edges.where("a is not null and b is not null").select("a", "b")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("n"))
        low = labels.join(near, "a").select("a", F.least("l", "n").alias("l"), F.col("l").alias("was"))
        jump = labels.select(F.col("a").alias("l"), F.col("l").alias("j"))
        new = written(low.join(jump, "l", "left").select("a", F.least("l", F.coalesce("j", "l")).alias("l"), "was"), "labels")
        released(edges.sparkSession, labels)
        labels = new
        if new.where("l <> was").isEmpty():
            released(edges.sparkSession, both)
            return labels.select(F.col("a").alias("node"), F.col("l").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def group_totals(groups: DataFrame) -> DataFrame:
    """One row: the number of groups, of documents in them, and of members of the largest."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def merged_groups(groups: DataFrame) -> DataFrame:
    """(group_id, doc_id) of groups (group_id, doc_id) merged wherever they share a document.

    Merged groups have two members at least and are named merged_0001 on, the
    largest first, then by their smallest member.
    """
    anchors = groups.groupBy("group_id").agg(F.min("doc_id").alias("anchor"))
    found = components(groups.join(anchors, "group_id").select(F.col("anchor").alias("a"), F.col("doc_id").alias("b")))
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").withColumn("minus", -F.col("n"))
    named = with_ordinal(sizes, ["minus", "component"], "k").select("component", F.format_string("merged_%04d", F.col("k") + 1).alias("group_id"))
    return found.join(named, "component").select("group_id", F.col("node").alias("doc_id"))
