"""A table of Parquet versions: written beside what is there, taken into use by one small file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer was first."""


class VersionedTable:
    """`path` holds data-<id> folders and a log: log/<n> names the folder of version n.

    A version is written whole before its log entry is made, and the entry is created only if no other writer has made
    it: readers see the old version or the new one, never a part. A job that dies leaves a folder that no entry names;
    `vacuum` takes it away. Old versions stay readable until then.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self) -> dict[int, str]:
        """Numbers of versions and their folders; an entry that a dying writer left empty counts as none."""
        if not self._fs.exists(self._p("log")):
            return {}
        out = {}
        for f in self._fs.listStatus(self._p("log")):
            name = f.getPath().getName()
            if name.isdigit() and f.getLen():
                stream = self._fs.open(f.getPath())
                out[int(name)] = bytes(stream.readNBytes(int(f.getLen()))).decode()
                stream.close()
        return dict(sorted(out.items()))

    def _last(self) -> int:
        """The highest number in the log, empty entries included."""
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(self._p("log")) if f.getPath().getName().isdigit()), default=0) if self._fs.exists(self._p("log")) else 0

    def read(self, version: int | None = None) -> DataFrame:
        found = self.versions()
        if not found or (version is not None and version not in found):
            raise ValueError(f"no version {version or ''} at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{found[version if version is not None else max(found)]}")

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """`df` as the next version, if none was made since `after` (by default: since now). The new number."""
        after = self._last() if after is None else after
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        try:
            stream = self._fs.create(self._p("log", str(after + 1)), False)
        except Exception as e:
            self._fs.delete(self._p(folder), True)
            raise Conflict(f"version {after + 1} of {self.path} was made by another writer") from e
        stream.write(bytearray(folder.encode()))
        stream.close()
        return after + 1

    def upsert(self, new: DataFrame, keys: list[str], deleted: DataFrame | None = None, tries: int = 3) -> int:
        """The next version: rows of `new` in place of those with their keys (null keys are equal), rows whose keys
        `deleted` has left out, others as they were. Of rows of `new` that share a key the greatest stays. If another
        writer is first, the merge is done again on what it wrote."""
        columns = new.columns
        rest = [c for c in columns if c not in keys]
        one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest]).select(columns)
        gone = new.select(*keys) if deleted is None else new.select(*keys).unionByName(deleted.select(*keys))
        for _ in range(tries):
            after = self._last()
            if not self.versions():
                merged = one
            else:
                old, g = self.read().select(columns), gone.distinct().select(*[F.col(k).alias(f"_g_{k}") for k in keys])
                match = F.lit(True)
                for k in keys:
                    match = match & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
                merged = old.join(g, match, "left_anti").unionByName(one)
            try:
                return self.write(merged, after)
            except Conflict:
                continue
        raise Conflict(f"{tries} tries were overtaken at {self.path}")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders that none of the last `keep` versions names: old versions and what dead jobs left. No writer may
        be at work. Names of what went."""
        wanted = set(list(self.versions().values())[-keep:])
        gone = [f.getPath().getName() for f in self._fs.listStatus(self._p()) if f.getPath().getName().startswith("data-") and f.getPath().getName() not in wanted]
        for name in gone:
            self._fs.delete(self._p(name), True)
        for n in list(self.versions())[:-keep]:
            self._fs.delete(self._p("log", str(n)), False)
        return gone
