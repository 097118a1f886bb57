"""Connected components of an edge table, and the written tables that iterations go on from."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is broadcast, at most.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a local one in local mode and one below the warehouse on a cluster."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = sc.getConf().get("spark.checkpoint.dir")
        local = sc.master.split("[")[0] == "local"
        sc.setCheckpointDir(path or (tempfile.mkdtemp(prefix="textloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


#: Spark's switch: the shuffle files of a query are deleted when it ends, not when the driver's garbage is collected.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """``df`` as Parquet files; nothing else of the query stays on the executors' disks."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN_UP, "false")
    conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEAN_UP, before)


def written(df: DataFrame, name: str = "written") -> DataFrame:
    """``df`` as a table in the shared folder: later jobs neither repeat its work nor depend on the executors that did it.

    Unlike ``checkpoint()`` this carries no size estimates along, which would multiply
    from round to round. The table goes when the application ends, or by ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    write(df, path)
    system, at = _file_system(spark, path)
    system.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``written`` whose readers are done; other DataFrames are left alone."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            system, at = _file_system(df.sparkSession, path)
            system.delete(at, True)
            system.cancelDeleteOnExit(at)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``edges`` (a, b) of one orderable type -> (node, comp): the smallest node that links reach, for every node in an edge.

    Each round takes the smallest label among the neighbours, then that label's label, so
    chains halve. Labels go through the shared folder between rounds; what a round no
    longer needs is deleted. Counted labels of ``BROADCAST_ROWS`` at most are broadcast;
    beyond that a node with very many edges is a skewed join key, which adaptive execution
    splits, and its incoming labels are reduced before the shuffle.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")))
    few = F.broadcast if labels.count() <= BROADCAST_ROWS else lambda df: df
    for _ in range(rounds):
        near = both.join(few(labels), both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        low = near.join(few(labels), near["a"] == labels["node"]).select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        up = labels.select(F.col("node").alias("at"), F.col("comp").alias("top"))
        new = written(low.join(few(up), low["comp"] == up["at"]).select("node", F.least("comp", "top").alias("comp"), "old"))
        drop(labels)
        if new.where("comp <> old").isEmpty():
            drop(both)
            done = new.select("node", "comp")
            done._written_at = new._written_at
            return done
        labels = new.drop("old")
        labels._written_at = new._written_at
    raise RuntimeError("components: too many rounds")
