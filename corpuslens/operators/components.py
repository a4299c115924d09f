"""Connected components of rows that share signal values, for duplicate families and leakage-safe groups."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointing(spark: SparkSession) -> None:
    """Makes sure that checkpoint() has a folder: spark.checkpoint.dir, or one of its own on a local master."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="corpuslens-")
    spark.sparkContext.setCheckpointDir(there)


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of so many bytes for the session, unless it sets its own limit; Spark's default counts rows, and long texts make them of any size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) == 2**31 - 1:
        spark.conf.set(key, str(size))


def freeing(df: DataFrame) -> DataFrame:
    """df, a checkpoint: Spark deletes the shuffle files it was computed from when the driver collects its garbage, which is asked for here."""
    df.sparkSession._jvm.System.gc()
    return df


def connected_components(memberships: DataFrame) -> DataFrame:
    """memberships (node, signal) to (node, root): root is the smallest node reachable over shared signals.

    A signal becomes a star of edges to its smallest node; one that a single node has, as most are, becomes none, so that the rounds run over
    what is shared only. Each round takes the smallest label of a node and its neighbours, then the label's own label. Groups are
    aggregated, never gathered; rounds are checkpointed.
    """
    checkpointing(memberships.sparkSession)
    pairs = memberships.select("node", "signal").where("node IS NOT NULL AND signal IS NOT NULL")
    least = pairs.groupBy("signal").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("signal", "lo")
    edges = pairs.join(least, "signal").where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct().checkpoint()
    both = edges.union(edges.select("b", "a"))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")).checkpoint()
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("step"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("next"))
        new = step.join(jump, F.col("step") == F.col("at"), "left").select("node", "old", F.least("step", F.coalesce("next", "step")).alias("root")).checkpoint()
        labels = new.select("node", "root")
        if not new.where("root <> old").limit(1).count():
            return pairs.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
