"""Continuous ingestion: documents to points in a versioned table, one micro-batch at a time."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import corpus

INPUT = "url string, text string, source_id string, fetched_at timestamp, retention_days int"


#: Shares of the table by hash of the document; a batch rewrites those that it touches.
SHARES = 64


def _share(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SHARES)).cast("int")


def apply_batch(root: str):
    """Writes a batch's outcome as version ``v=<batch>`` of the shares that it touches, then the pointer file that says which version each share has.

    Other shares stay where they are. Readers follow the pointer, which is put in place
    by a rename, so they never see a half-written version; a batch that runs again starts
    from the version before it and writes the same, so a restart neither loses nor
    doubles points.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = corpus.points(batch.dropDuplicates(["url"])).withColumn("share", _share(F.col("document_id")))
        held = {k: v for k, v in pointer(spark, root, before=number).items()}
        touched = [r["share"] for r in new.select("share").distinct().collect()]  # SHARES rows at most
        old = _read(spark, root, {k: held[k] for k in touched if k in held})
        out = new if old is None else corpus.upsert(old, new)
        out.repartition("share").write.mode("overwrite").partitionBy("share").parquet(f"{root}/v={number}")
        left = [r["share"] for r in spark.read.parquet(f"{root}/v={number}").select("share").distinct().collect()] if touched else []  # SHARES rows at most
        _point(spark, root, number, {k: v for k, v in held.items() if k not in touched} | dict.fromkeys(left, number))

    return run


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _point(spark: SparkSession, root: str, number: int, versions: dict[int, int]) -> None:
    """Puts the pointer of a batch in place, whole."""
    system, draft = _system(spark, f"{root}/_pointers/.{number}.json")
    _, place = _system(spark, f"{root}/_pointers/{number}.json")
    out = system.create(draft, True)
    out.write(json.dumps({str(k): v for k, v in sorted(versions.items())}).encode())
    out.close()
    system.delete(place, False)
    if not system.rename(draft, place):
        raise OSError(f"can't put the pointer of batch {number} in place")


def pointer(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """The version of each share by the newest pointer (of a batch before a given one)."""
    system, at = _system(spark, f"{root}/_pointers")
    if not system.exists(at):
        return {}
    names = [s.getPath().getName() for s in system.listStatus(at)]
    found = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    found = [v for v in found if before is None or v < before]
    if not found:
        return {}
    text = "".join(r[0] for r in spark.read.text(f"{root}/_pointers/{max(found)}.json").collect())  # one line
    return {int(k): v for k, v in json.loads(text).items()}


def _read(spark: SparkSession, root: str, versions: dict[int, int]) -> DataFrame | None:
    paths = [f"{root}/v={v}/share={k}" for k, v in sorted(versions.items())]
    return spark.read.option("basePath", root).parquet(*paths).drop("v") if paths else None


def latest(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The table as the newest pointer (before a given batch) has it, or None."""
    found = _read(spark, root, pointer(spark, root, before))
    return None if found is None else found.drop("share")


def ingest(spark: SparkSession, source: str, root: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Reads JSON documents as they arrive in ``source``; unchanged content is left alone, changed documents replace their points."""
    stream = spark.readStream.schema(INPUT).json(source)
    writer = stream.writeStream.foreachBatch(apply_batch(root)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def event_counts(events: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """An extension, not part of the operator inventory: counts and means by event-time window, late rows dropped after the watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select("w.start", "w.end", "event_type", "n", "mean_value")
