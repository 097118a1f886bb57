"""Collections of points as folders: what there is, whether it fits, and what keeps it from production use.

A collection is a folder with a schema file; its points are partitioned by its index
fields, which is what filters on them prune by. All file work goes through Spark's
file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA_FILE = "schema.json"


class Unfit(ValueError):
    """A collection is there, but isn't what was asked for."""


class Unavailable(OSError):
    """The store can't be reached."""


@dataclass(frozen=True)
class Schema:
    """The vector, what the points say about themselves, and the fields that filters may use; ``strict``: no others."""

    size: int
    vector_name: str = "content"
    distance: str = "cosine"
    metadata: dict[str, str] = field(default_factory=dict)
    indexes: tuple[str, ...] = ()
    strict: bool = True

    def mismatch(self, found: dict) -> str | None:
        """Why a stored schema isn't this one; indexes are left to ``preflight``."""
        for name, want in (("vector_name", self.vector_name), ("size", self.size), ("distance", self.distance)):
            if found.get(name) != want:
                return f"{name} is {found.get(name)!r}, not {want!r}"
        other = sorted(k for k, v in self.metadata.items() if found.get("metadata", {}).get(k) != v)
        return f"metadata differs: {', '.join(other)}" if other else None

    def preflight(self, found: dict) -> str | None:
        """Why a stored collection isn't fit for production."""
        if (reason := self.mismatch(found)) is not None:
            return reason
        if missing := sorted(set(self.indexes) - set(found.get("indexes", ()))):
            return "missing indexes: " + ", ".join(missing)
        return None if found.get("strict") is True else "filters on other fields are permitted"


class Store:
    """The collections below a root; without a root it is disabled."""

    def __init__(self, spark: SparkSession, root: str | None):
        self.spark, self.root = spark, root.rstrip("/") if root else None

    def _at(self, *parts: str):
        if self.root is None:
            raise Unavailable("no store is configured")
        try:
            at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
            return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at
        except Exception as e:
            raise Unavailable("the store can't be reached") from e

    def health(self) -> tuple[str, str | None]:
        """``disabled``, ``unavailable`` or ``ready``, and why."""
        if self.root is None:
            return "disabled", "no store is configured"
        try:
            self.names()
        except Unavailable as e:
            return "unavailable", str(e)
        return "ready", None

    def names(self) -> list[str]:
        system, at = self._at()
        try:
            return sorted(s.getPath().getName() for s in system.listStatus(at) if self.stored(s.getPath().getName()) is not None) if system.exists(at) else []
        except Unavailable:
            raise
        except Exception as e:
            raise Unavailable("collections can't be listed") from e

    def stored(self, name: str) -> dict | None:
        """The schema that a collection was made with."""
        system, at = self._at(name, SCHEMA_FILE)
        if not system.exists(at):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(at.toString()).collect()))  # one line

    def ensure(self, name: str, schema: Schema, *, production: bool = False) -> bool:
        """Makes the collection, or checks the one that is there; True only if it was made."""
        made = (found := self.stored(name)) is None
        if made:
            system, at = self._at(name, SCHEMA_FILE)
            out = system.create(at, False)
            out.write(json.dumps(asdict(schema), sort_keys=True).encode())
            out.close()
            found = self.stored(name)
        reason = schema.preflight(found) if production else schema.mismatch(found)
        if reason:
            raise Unfit(f"collection {name!r}: {reason}")
        return made

    def write(self, name: str, points: DataFrame) -> None:
        """Replaces the points, partitioned by the collection's indexes."""
        if (found := self.stored(name)) is None:
            raise Unfit(f"no collection {name!r}")
        if missing := sorted(set(found["indexes"]) - set(points.columns)):
            raise Unfit(f"points lack {', '.join(missing)}")
        points.write.mode("overwrite").partitionBy(*found["indexes"]).parquet(f"{self.root}/{name}/points")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/points")

    def drop(self, name: str) -> bool:
        system, at = self._at(name)
        return bool(system.delete(at, True))

    def live_check(self, schema: Schema, points: DataFrame) -> dict:
        """Makes a collection of its own, writes, counts and drops it; ``clean`` proves that nothing stayed. Others are never touched."""
        name, before = f"check-{uuid.uuid4().hex}", self.names()
        try:
            made = self.ensure(name, schema, production=True)
            self.write(name, points)
            count = self.read(name).count()
        finally:
            self.drop(name)
        return {"made": made, "points": count, "clean": self.names() == before}
