"""Sharding by size-tiered compaction.

A shard is an immutable Parquet file. Arrivals are appended as small shards, as they come. A compaction looks at the
shards' sizes: those of one size tier (powers of FAN) are merged, in order of arrival and at least FAN at a time, into
files of up to the target size; a shard of at least half the target is left alone. So a row is rewritten once a
tier, not once a compaction. Every append and compaction commits a manifest, the list of live shards: it is written
under another name and renamed to its version's, which fails if another writer had that version first. Readers take
the newest manifest and never see half a change. vacuum drops all versions but the KEPT newest with the shards that
only they list; files that no version lists may be those of a writer before its commit, so they stay for AGE seconds.

All bookkeeping is a line per shard. Rows move in one job a round, a group of shards being one task's output of at most
the target size, and each group has a task of its own. All paths go through Hadoop's file systems, so a store may be local or remote.

Cases: rows are kept as they are, with nulls, repeats, empty texts and further columns; arrivals whose column is null
are one arrival; a missing store and an empty table have version 0 and no shards, and read as None.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import free

FAN, TARGET = 4, 64 << 20
KEPT, AGE = 2, 24 * 3600
OPTIONS = {"compression": "zstd"}


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's root
    size: int
    born: int  # the version that it came with

    @property
    def name(self) -> str:
        return "/".join(self.path.split("/")[-2:])


class Store:
    """A folder of shards and manifests."""

    def __init__(self, spark: SparkSession, root: str, fan: int = FAN, target: int = TARGET):
        self.spark, self.root, self.fan, self.target = spark, root.rstrip("/"), fan, target
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.conf)

    def _files(self, name: str) -> list[tuple[str, int, float]]:
        """(path below the root, bytes, seconds since it was written) of all files in a folder, in order."""
        top = self._path(name)
        if not self._fs().exists(top):
            return []
        out, found = [], self._fs().listFiles(top, True)
        while found.hasNext():
            f = found.next()
            out.append((f"{name}/" + f.getPath().toString().split(f"/{name}/", 1)[1], f.getLen(), time.time() - f.getModificationTime() / 1000))
        return sorted(out)

    def versions(self) -> list[int]:
        """The versions that can be read."""
        return sorted(int(p.rsplit("/v", 1)[1][:-5]) for p, *_ in self._files("manifests") if p.endswith(".json") and "/v" in p)

    def version(self) -> int:
        return max(self.versions(), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        """The live shards of a version, of the newest if none is named."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs().open(self._path(f"manifests/v{version:012d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def commit(self, shards: list[Shard], after: int) -> int:
        """Makes shards the version after `after`; raises if another writer made it."""
        name, draft = f"manifests/v{after + 1:012d}.json", f"manifests/draft-{self.jvm.java.util.UUID.randomUUID()}"
        stream = self._fs().create(self._path(draft), False)
        try:
            stream.write(bytearray(json.dumps({"version": after + 1, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("x").toUri(), self.conf).rename(self._path(draft), self._path(name), options)
        return after + 1

    def _write(self, df: DataFrame, by: str, version: int) -> list[Shard]:
        """Writes df, a folder for each value of by; the new shards."""
        folder = f"data/v{version:012d}-{self.jvm.java.util.UUID.randomUUID()}"
        df.write.options(**OPTIONS).partitionBy(by).parquet(f"{self.root}/{folder}")
        return [Shard(p, n, version) for p, n, _ in self._files(folder) if p.endswith(".parquet")]

    def append(self, df: DataFrame, arrival: str = "__arrival") -> int:
        """Appends the arrivals of df, one after the other in order of the column arrival (which isn't stored), as they are partitioned.

        A df without that column is one arrival.
        """
        version, live = self.version(), self.shards()
        if arrival not in df.columns:
            df = df.withColumn(arrival, F.lit(0))
        fresh = self._write(df, arrival, version + 1)
        batches: dict[str, list[Shard]] = {}
        for s in fresh:
            batches.setdefault(s.path.split("/")[2], []).append(s)
        for _, batch in sorted(batches.items(), key=lambda x: (len(x[0]), x[0])):
            live = live + [Shard(s.path, s.size, version + 1) for s in batch]
            version = self.commit(live, version)
        return version

    def tier(self, size: int) -> int:
        return int(math.log(max(size, 1), self.fan))

    def groups(self, shards: list[Shard]) -> list[list[Shard]]:
        """The merges that a round makes: shards of one tier, in order of arrival, at least fan and up to the target together."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.size < self.target:
                tiers.setdefault(self.tier(s.size), []).append(s)
        out = []
        for _, own in sorted(tiers.items()):
            if len(own) < self.fan:
                continue
            group: list[Shard] = []
            for s in sorted(own, key=lambda s: (s.born, s.path)):
                if group and sum(x.size for x in group) + s.size > self.target:
                    out.append(group)
                    group = []
                group.append(s)
            out.append(group)
        return [g for g in out if len(g) > 1]

    def compact(self) -> int:
        """Merges until no tier has fan shards that could be; the version then."""
        while True:
            version, live = self.version(), self.shards()
            groups = self.groups(live)
            if not groups:
                return version
            rows = self._read([s for g in groups for s in g])
            name, group = free(rows, "__name"), free(rows, "__group")
            plan = self.spark.createDataFrame([(s.name, k) for k, g in enumerate(groups) for s in g], f"{name} string, {group} int")
            rows = rows.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1))
            rows = rows.join(F.broadcast(plan), name).drop(name).repartitionById(len(groups), group)
            made = self._write(rows, group, version + 1)
            gone = {s.path for g in groups for s in g}
            self.commit([s for s in live if s.path not in gone] + made, version)
            self.vacuum()

    def vacuum(self, keep: int = KEPT, age: float = AGE) -> None:
        """Drops versions before the newest `keep` and the shards that only they list, and files of at least `age` seconds that none lists."""
        versions = self.versions()
        dropped, kept = versions[:-keep], versions[-keep:]
        listed = {v: {s.path for s in self.shards(v)} for v in versions}
        live = {p for v in kept for p in listed[v]}
        once = {p for v in dropped for p in listed[v]}
        for v in dropped:
            self._fs().delete(self._path(f"manifests/v{v:012d}.json"), False)
        for p, _, old in self._files("data"):
            if p.endswith(".parquet") and p not in live and (p in once or old >= age):
                self._fs().delete(self._path(p), False)
        for p, _, old in self._files("manifests"):
            if "/draft-" in p and old >= age:
                self._fs().delete(self._path(p), False)

    def _read(self, shards: list[Shard]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/{s.path}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version's shards; None if it has none."""
        shards = self.shards(version)
        return self._read(shards) if shards else None

    def placed(self) -> DataFrame | None:
        """The newest version's rows with shard (its number in the manifest), shard_bytes and version; columns of their names give way."""
        shards, version = self.shards(), self.version()
        if not shards:
            return None
        rows = self._read(shards)
        rows = rows.drop(*(c for c in rows.columns if c.lower() in ("shard", "shard_bytes", "version")))
        name = free(rows, "__name")
        known = self.spark.createDataFrame([(s.name, k, s.size) for k, s in enumerate(shards)], f"{name} string, shard int, shard_bytes long")
        rows = rows.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1))
        return rows.join(F.broadcast(known), name).drop(name).withColumn("version", F.lit(version))
