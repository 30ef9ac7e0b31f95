"""Connected components by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.storage import drop_path, fresh_path, note


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """Smallest node reachable from each node of an undirected edge list.

    Input: ``edges(src, dst)`` of one orderable type; self loops, repeated and
    reversed edges are harmless, edges with a null end are ignored.  Output:
    ``(node, component)`` for every node that an edge names; ``component`` is
    the smallest node of its component.  An empty edge list gives no rows.

    Each round lowers a node's label to the smallest label around it and then
    jumps to the label of that label, so the rounds grow with the logarithm of
    the longest chain for the star-shaped inputs of the callers.  Labels are
    combined with a map-side ``min``; a hub node is only ever one row of the
    label table.  Every round is cut off with a table in the shared folder and
    the previous round's table is deleted.  Nothing is collected but one flag.
    """
    spark = edges.sparkSession
    paths: list[str] = []

    def cut(df: DataFrame, label: str) -> DataFrame:
        paths.append(fresh_path(spark, label))
        df.write.parquet(paths[-1])
        note(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = cut(pairs.union(pairs.select("b", "a")).toDF("a", "b").distinct(), "cc-edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "cc-labels")
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        low = labels.join(seen, labels.node == seen.a).select("node", "label", F.least("label", "l").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        done = cut(low.join(jump, "low").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") < F.col("label")).alias("moved")), "cc-labels")
        if done.where("moved").isEmpty():
            labels = done
            break
        labels = done.select("node", "label")
        drop_path(spark, paths[-2]) if len(paths) > 2 else None
    else:
        raise RuntimeError(f"labels still move after {max_rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))
