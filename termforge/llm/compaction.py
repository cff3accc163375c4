"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small immutable Parquet shards. A shard's tier is the whole logarithm of its size over
``floor`` to the base ``fanout``; when a tier holds ``fanout`` shards or more, they are merged into files of about the
target size. Shards of half the target or more are never merged again, so each byte is rewritten at most once per tier,
and every merge leaves fewer shards.

State is a manifest, one JSON file per version. A commit writes it to a name of its own and renames it to
``manifest-<version>``; the rename fails if that version exists, so of two writers one commits and the other starts
over on the newer version. Readers take the highest version and see either all of a commit or none of it. Shards that no
manifest of the last versions names are deleted by ``vacuum`` alone; failed or repeated tasks leave nothing that a
manifest names. A writer leaves a record in ``inflight`` before it writes shards and takes it back after its commit, so that
``vacuum`` spares shards that are written but not yet named; records older than ``grace`` seconds are those of dead writers.

Defined cases: rows are kept as they are - nulls, repeats, any columns of a single schema; an empty arrival adds a version
without shards; a store without versions reads as nothing; nothing depends on the order of rows.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 128 << 20
FLOOR_BYTES = 4 << 20
FANOUT = 4


@dataclass(frozen=True)
class Shard:
    name: str
    size: int
    rows: int
    level: int  # how often its rows have been merged


class ConflictError(RuntimeError):
    """Another writer committed this version first."""


class Store:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET_BYTES, floor: int = FLOOR_BYTES, fanout: int = FANOUT):
        if fanout < 2 or floor < 1 or target < floor:
            raise ValueError("fanout must be 2 or more and 1 <= floor <= target")
        self.spark, self.path, self.target, self.floor, self.fanout = spark, path.rstrip("/"), target, floor, fanout
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._p("shards"))
        self._fs.mkdirs(self._p("manifests"))
        self._fs.mkdirs(self._p("inflight"))

    def _p(self, rest: str):
        return self._hadoop.Path(f"{self.path}/{rest}")

    # -------------------------------------------------------- manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p("manifests"))]
        return sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, shards}; version 0 is the empty store."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._p(f"manifests/manifest-{version:010d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        m = json.loads(text)
        return m | {"shards": [Shard(**s) for s in m["shards"]]}

    def commit(self, base: dict, schema: str | None, shards: list[Shard]) -> int:
        """Publish the version after ``base``; ConflictError if it exists."""
        version = base["version"] + 1
        own, final = self._p(f"manifests/.{uuid.uuid4().hex}"), self._p(f"manifests/manifest-{version:010d}")
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        if self._fs.exists(final) or not self._rename(own, final):
            self._fs.delete(own, False)
            raise ConflictError(f"version {version} exists")
        return version

    def _rename(self, own, final) -> bool:
        # FileContext.rename without OVERWRITE throws if the target exists, where FileSystem.rename may not
        context = self._hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(own, final, options)
        except Exception as e:  # noqa: BLE001  py4j wraps the Java exception
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    # -------------------------------------------------------- shards

    def _begin(self) -> str:
        """A new run of shards, on record until ``_end``."""
        run = uuid.uuid4().hex
        self._fs.create(self._p(f"inflight/{run}"), False).close()
        return run

    def _end(self, run: str) -> None:
        self._fs.delete(self._p(f"inflight/{run}"), False)

    def _write(self, df: DataFrame, level: int, run: str) -> list[Shard]:
        """``df`` as new shard files; what they hold is read back from their footers."""
        df.write.parquet(f"{self.path}/shards/{run}")
        files = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._p(f"shards/{run}")) if s.getPath().getName().startswith("part-")}
        if not files:
            return []
        counts = self.spark.read.schema(df.schema).parquet(f"{self.path}/shards/{run}").groupBy(F.col("_metadata.file_name").alias("name")).count().collect()  # a row per file
        return [Shard(f"{run}/{r['name']}", files[r["name"]], r["count"], level) for r in counts]

    def append(self, df: DataFrame) -> int:
        """Add an arrival as small shards; returns the committed version."""
        schema, run = df.schema.json(), self._begin()
        try:
            new = self._write(df, 0, run)
            while True:
                base = self.manifest()
                if base["schema"] and base["schema"] != schema:
                    raise ValueError("an arrival must have the columns of the store")
                try:
                    return self.commit(base, schema, base["shards"] + new)
                except ConflictError:
                    continue
        finally:
            self._end(run)

    def tier(self, s: Shard) -> int:
        return 0 if s.size <= self.floor else 1 + int(math.log(s.size / self.floor, self.fanout))

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """The groups due for a merge: all shards below half the target of every tier that holds ``fanout`` or more."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.size < self.target:
                tiers.setdefault(self.tier(s), []).append(s)
        return [sorted(v, key=lambda s: s.name) for _, v in sorted(tiers.items()) if len(v) >= self.fanout]

    def compact(self) -> int:
        """Merge similar shards until no tier is full; returns the version then current."""
        while due := self.runs((base := self.manifest())["shards"]):
            old, run = due[0], self._begin()
            try:
                size = sum(s.size for s in old)
                df = self._read(old, base["schema"])
                merged = self._write(df.coalesce(max(1, round(size / self.target))), 1 + max(s.level for s in old), run)
                gone = {s.name for s in old}
                while True:
                    now = self.manifest()
                    if not gone <= {s.name for s in now["shards"]}:
                        break  # another compaction was first: its result stands, and ours is never named
                    try:
                        self.commit(now, now["schema"], [s for s in now["shards"] if s.name not in gone] + merged)
                        break
                    except ConflictError:
                        continue
            finally:
                self._end(run)
        return base["version"]

    def _read(self, shards: list[Shard], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/shards/{s.name}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one, if none is given)."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("the store is empty")
        return self._read(m["shards"], m["schema"])

    def vacuum(self, keep: int = 2, grace: float = 3600.0) -> int:
        """Delete manifests but the last ``keep``, then shard files that none of these names; returns how many files.

        Readers of older versions than the last ``keep`` must have ended. Shards are listed first, then the records of
        writers, then manifests: what was listed is still on record, or its commit is seen.
        """
        runs = [d.getPath() for d in self._fs.listStatus(self._p("shards"))]
        born = time.time() - grace
        busy = {s.getPath().getName() for s in self._fs.listStatus(self._p("inflight")) if s.getModificationTime() / 1000 >= born}
        known = self.versions()
        live = {s.name for v in known[-keep:] for s in self.manifest(v)["shards"]}
        for v in known[:-keep]:
            self._fs.delete(self._p(f"manifests/manifest-{v:010d}"), False)
        n = 0
        for d in runs:
            if d.getName() in busy:
                continue
            files = [f for f in self._fs.listStatus(d) if f.getPath().getName().startswith("part-")]
            dead = [f for f in files if f"{d.getName()}/{f.getPath().getName()}" not in live]
            n += len(dead)
            if len(dead) == len(files):
                self._fs.delete(d, True)
            else:
                for f in dead:
                    self._fs.delete(f.getPath(), False)
        return n


def ingest(spark: SparkSession, files: list[str], path: str, **sizes) -> Store:
    """A new store in which each of ``files`` is an arrival, compacted and vacuumed after each; nobody reads it meanwhile."""
    store = Store(spark, path, **sizes)
    for f in files:
        store.append(spark.read.parquet(f))
        store.compact()
        store.vacuum(keep=1)
    return store
