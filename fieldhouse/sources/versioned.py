"""Keyed tables that change a part at a time.

Rows lie in hashed partitions. A version is one small manifest that names the folder of each partition; a change
writes the partitions that its rows touch into a folder of its own and commits by putting the next manifest in place, which
fails if another writer was first. What a lost task or a lost driver leaves behind is named by no manifest, and so is
never read. Each version but those that ``vacuum`` removes can still be read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class LostRace(RuntimeError):
    """Another writer committed the next version first."""


class Files:
    """A folder through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.path = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path.rstrip("/")

    def _at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at().getFileSystem(self.conf)

    def names(self, name: str = "") -> list[str]:
        if not self._fs().exists(self._at(name)):
            return []
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._at(name)))

    def read(self, name: str) -> str:
        stream = self._fs().open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write the whole file, or nothing if there is one of this name."""
        draft = f"_draft-{uuid.uuid4().hex}"
        out = self._fs().create(self._at(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs().mkdirs(self._at(name).getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._at(draft), self._at(name), none)
        except Exception as e:  # what Hadoop throws, through py4j
            self.drop(draft)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def drop(self, name: str) -> None:
        self._fs().delete(self._at(name), True)


class VersionedTable:
    """A table of ``schema`` under ``path`` whose rows are found by ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], parts: int = 32):
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), keys, parts
        self.schema = T._parse_datatype_string(schema)
        self.files = Files(spark, self.path)

    # ------------------------------------------------------------ versions

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("_versions") if re.fullmatch(r"\d+\.json", n)]

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``parts`` (partition: folder), ``seen`` (writer: last batch) and ``notes``."""
        known = self.versions()
        if version is None:
            version = max(known, default=-1)
        if version < 0:
            return {"version": -1, "parts": {}, "seen": {}, "notes": {}}
        return json.loads(self.files.read(f"_versions/{version:012d}.json"))

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest), of some partitions only where ``only`` names them."""
        found = self.manifest(version)["parts"]
        folders = [f"{self.path}/{folder}/_part={p}" for p, folder in sorted(found.items()) if only is None or int(p) in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    # ------------------------------------------------------------ changes

    def change(self, rows: DataFrame, merge: Merge, writer: str | None = None, batch: int | None = None, notes: dict | None = None) -> bool:
        """Put ``merge(old, new)`` in place of the partitions that ``rows`` fall into; False where ``writer`` has already
        committed this batch or a later one.

        ``rows`` are read twice (which partitions, then their values) and must be the same both times. ``merge`` must keep each
        row in its partition: keys are not changed, and a key that is gone is a row left out.
        """
        now = self.manifest()
        if writer is not None and batch is not None and now["seen"].get(writer, -1) >= batch:
            return False
        touched = sorted(r[0] for r in rows.select(self.part().alias("p")).distinct().collect())  # at most ``parts``
        found = dict(now["parts"])
        if touched:
            names = [f.name for f in self.schema]
            merged = merge(self.read(now["version"], touched), rows).select(*names)
            folder = f"data-{now['version'] + 1:012d}-{uuid.uuid4().hex[:12]}"
            merged = merged.withColumn("_part", self.part())
            merged.repartition("_part").write.option("compression", "zstd").partitionBy("_part").parquet(f"{self.path}/{folder}")
            written = {int(n.split("=")[1]) for n in self.files.names(folder) if n.startswith("_part=")}
            if not written <= set(touched):
                raise ValueError("merge moved rows to other partitions")
            found = {p: f for p, f in found.items() if int(p) not in touched} | {str(p): folder for p in written}
        self._commit(now, found, writer, batch, notes)
        return True

    def note(self, notes: dict) -> None:
        """A version with other notes and the same rows."""
        now = self.manifest()
        self._commit(now, now["parts"], None, None, notes)

    def restore(self, version: int) -> None:
        """Put an earlier version in place again, as the next one: its rows, notes and what its writers had committed."""
        old = self.manifest(version)
        new = old | {"version": self.manifest()["version"] + 1}
        if not self.files.put(f"_versions/{new['version']:012d}.json", json.dumps(new, sort_keys=True)):
            raise LostRace(f"{self.path}: version {new['version']} was committed by another writer")

    def _commit(self, now: dict, parts: dict, writer: str | None, batch: int | None, notes: dict | None) -> None:
        seen = now["seen"] | ({writer: batch} if writer is not None and batch is not None else {})
        new = {"version": now["version"] + 1, "parts": parts, "seen": seen, "notes": now["notes"] | (notes or {})}
        if not self.files.put(f"_versions/{new['version']:012d}.json", json.dumps(new, sort_keys=True)):
            raise LostRace(f"{self.path}: version {new['version']} was committed by another writer")

    def upsert(self, rows: DataFrame, newest: list[str], writer: str | None = None, batch: int | None = None) -> bool:
        """Keep of each key the row with the largest ``newest`` columns; rows that are as new as the old one change nothing but ties."""
        names = [f.name for f in self.schema]
        rest = [n for n in names if n not in self.keys]

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.select(*names).unionByName(new.select(*names))
            top = F.max_by(F.struct(*rest), F.struct(*newest, F.struct(*[n for n in rest if n not in newest])))
            return both.groupBy(*self.keys).agg(top.alias("_x")).select(*self.keys, "_x.*")

        return self.change(rows, merge, writer, batch)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove all versions but the newest ``keep``, and folders that none of those names.

        Not while another writer is at work: its folder is not named yet.
        """
        known = self.versions()
        kept = known[-keep:]
        used = {f for v in kept for f in self.manifest(v)["parts"].values()}
        gone = [n for n in self.files.names() if (n.startswith("data-") and n not in used) or n.startswith("_draft-")]
        for v in known[:-keep]:
            self.files.drop(f"_versions/{v:012d}.json")
        for n in gone:
            self.files.drop(n)
        return gone
