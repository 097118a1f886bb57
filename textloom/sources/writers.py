"""Writers: JSON lines, small JSON files, snapshots."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, single_file: bool = False) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def canonical_json(value) -> str:
    """Sorted keys, no blanks, non-ASCII kept."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def write_json_atomically(value, path: str) -> None:
    """Whole or not at all: a temporary file beside the target, then a rename. For small driver-side files."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True, indent=2, ensure_ascii=False)
        f.write("\n")
    os.replace(name, path)


def snapshot(df: DataFrame, root: str, generation: str, columns: list[str]) -> dict:
    """A new directory of the table, with its count and an order-free hash; verified by reading it back."""
    from ..operators.dataprep import fingerprint

    path = f"{root.rstrip('/')}/generation={generation}"
    df.write.mode("errorifexists").parquet(path)
    record = fingerprint(df.sparkSession.read.parquet(path), columns).first().asDict()
    return {"path": path, "generation": generation, **record}


def verify_snapshot(spark: SparkSession, record: dict, columns: list[str]) -> bool:
    from ..operators.dataprep import fingerprint

    return fingerprint(spark.read.parquet(record["path"]), columns).first().asDict() == {"n": record["n"], "fingerprint": record["fingerprint"]}


def deletion_allowed(backups: DataFrame, now, days: int = 8) -> bool:
    """Only with a verified backup that is young enough."""
    return not backups.where(F.col("verified") & (F.col("created_at") >= F.lit(now) - F.make_dt_interval(days=F.lit(days)))).isEmpty()
