"""A versioned store of Parquet shards with size-tiered compaction (operator 2).

Arrivals are appended as runs of small files that never change. When several runs of similar size have gathered, they are
rewritten as one run of target-sized files. Each append or merge ends with a new manifest and a commit file that names it.
A commit file is written under another name and renamed, so readers see all of it or nothing.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.runtime import scratch_path

#: Size of the files that merges write, and below which runs count as the smallest tier.
TARGET_BYTES, SMALLEST = 64 << 20, 1 << 20
#: Runs of a tier that start a merge, those that one merge takes at most, and the ratio between tiers.
FEWEST, MOST, FANOUT = 4, 32, 4


class CommitConflict(RuntimeError):
    """Another writer committed first; nothing of this commit counts."""


class ShardStore:
    """Shards under ``path``; manifests hold (run, file, bytes, rows), one row per file, and the driver one line per run.

    Two writers may work at once: the rename to a version's commit file succeeds for one of them, the other starts again
    from the new version. That rename is one step in HDFS; where a file system only checks and then renames (local
    disks) or copies (object stores), let one writer commit at a time. A writer that dies leaves files that no commit
    names: ``vacuum`` removes them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _list(self, name: str) -> list:
        return list(self._fs.listStatus(self._at(name))) if self._fs.exists(self._at(name)) else []

    def version(self) -> int:
        """The last committed version; 0 before the first commit. Files under other names than a version do not count."""
        return max((int(n) for n in (s.getPath().getName() for s in self._list("commits")) if n.isdigit()), default=0)

    def _told(self, version: int) -> dict:
        """What a commit file says: the manifest's folder and the columns of the rows."""
        if not version:
            return {"manifest": None, "schema": StructType([]).jsonValue()}
        return json.loads(self.spark.read.text(f"{self.path}/commits/{version:012d}", wholetext=True).first()[0])

    def schema(self, version: int | None = None) -> StructType:
        """The columns of all rows up to a version, the last if not given; none before the first commit."""
        return StructType.fromJson(self._told(self.version() if version is None else version)["schema"])

    def manifest(self, version: int | None = None) -> DataFrame:
        """(run, file, bytes, rows) of a version, the last if not given."""
        name = self._told(self.version() if version is None else version)["manifest"]
        columns = "run string, file string, bytes long, rows long"
        return self.spark.read.schema(columns).parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], columns)

    def runs(self, version: int | None = None) -> list[tuple[str, int, int]]:
        """(run, bytes, rows) of a version: one line for each run."""
        rows = self.manifest(version).groupBy("run").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("n")).collect()
        return sorted((r["run"], r["b"], r["n"]) for r in rows)

    def _commit(self, manifest: DataFrame, schema: StructType, base: int) -> int:
        """Write the manifest, then the commit file of the next version under a passing name, and rename it."""
        name = f"manifests/{uuid.uuid4().hex}"
        manifest.write.parquet(f"{self.path}/{name}")
        passing, final = self._at(f"commits/.{uuid.uuid4().hex}"), self._at(f"commits/{base + 1:012d}")
        out = self._fs.create(passing, False)
        out.write(bytearray(json.dumps({"manifest": name, "schema": schema.jsonValue()}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(passing, final):
            self._fs.delete(passing, False)
            raise CommitConflict(f"version {base + 1} is there already")
        return base + 1

    def _files(self, folder: str, run) -> DataFrame:
        """The manifest rows of the files in ``folder``."""
        found = self.spark.read.parquet(f"{self.path}/{folder}")
        return found.select(run.alias("run"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).groupBy("run", "file", "bytes").agg(F.count(F.lit(1)).alias("rows"))

    @staticmethod
    def _widened(old: StructType, new: StructType) -> StructType:
        """The old columns, then those that are new. The same name with another type is an error."""
        types = {f.name: f.dataType for f in old}
        for f in new:
            if types.get(f.name, f.dataType) != f.dataType:
                raise ValueError(f"column {f.name} is {types[f.name].simpleString()} in the store and {f.dataType.simpleString()} in these rows")
        out = StructType([*old.fields, *(f for f in new if f.name not in types)])
        for f in out:
            f.nullable = True
        return out

    def append(self, df: DataFrame, arrival: str | None = None, tries: int = 20) -> int:
        """Add rows as new runs: one, or one for each value of column ``arrival`` (NULL counts as empty text).

        Each task writes a small file of its rows for each arrival; nothing is shuffled. Repeated rows and NULLs stay as
        they are. New columns are NULL in rows from before; columns that are missing here are NULL here; a column
        whose type differs raises ValueError. Without rows only the columns are noted, if they are new. If another
        writer commits first, the same files are committed after it, up to ``tries`` times.
        """
        batch, column = uuid.uuid4().hex[:12], "__arrival"
        self._widened(self.schema(), df.schema)
        while column in df.columns:
            column += "_"
        folder = f"data/{batch}"
        marked = df.withColumn(column, F.coalesce(F.col(f"`{arrival}`").cast("string"), F.lit("")) if arrival else F.lit("0"))
        marked.write.partitionBy(column).parquet(f"{self.path}/{folder}")
        some = any(s.isDirectory() for s in self._list(folder))
        run = F.concat(F.lit(f"{folder}/"), F.regexp_extract(F.col("_metadata.file_path"), f"/{folder}/([^/]+)/[^/]+$", 1))
        while True:
            base = self.version()
            known = self.schema(base)
            schema = self._widened(known, df.schema)
            if not some and base and schema == known:
                return base
            try:
                return self._commit(self.manifest(base).union(self._files(folder, run)) if some else self.manifest(base), schema, base)
            except CommitConflict:
                tries -= 1
                if tries <= 0:
                    raise

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last if not given. An empty store has its columns and no rows, or no columns yet."""
        version = self.version() if version is None else version
        schema = self.schema(version)
        runs = [r for r, _, _ in self.runs(version)]
        return self._read(runs, schema) if runs else self.spark.createDataFrame([], schema)

    def _read(self, runs: list[str], schema: StructType) -> DataFrame:
        """Rows of runs; columns that a run does not have are NULL."""
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{r}" for r in sorted(runs)))

    @staticmethod
    def tier(size: int) -> int:
        return 0 if size <= SMALLEST else 1 + int(math.log(size / SMALLEST, FANOUT))

    def compact(self, target: int = TARGET_BYTES) -> int:
        """Merge tiers until none has ``FEWEST`` runs; each merge is one commit. Returns the last version.

        Larger runs stay as they are, so a row is rewritten once per tier, a number of times logarithmic in the store. Rows
        stay the same, with the columns of the store. If another writer commits first, the merge is planned anew.
        """
        while True:
            base, tiers = self.version(), {}
            for run, size, _ in self.runs(base):
                tiers.setdefault(self.tier(size), []).append((size, run))
            full = [t for t in sorted(tiers) if len(tiers[t]) >= FEWEST]
            if not full:
                return base
            chosen, schema = sorted(tiers[full[0]])[:MOST], self.schema(base)
            names = [r for _, r in chosen]
            folder = f"data/{uuid.uuid4().hex[:12]}/merged"
            files = max(1, round(sum(s for s, _ in chosen) / target))
            self._read(names, schema).coalesce(files).write.parquet(f"{self.path}/{folder}")
            kept = self.manifest(base).where(~F.col("run").isin(names))
            try:
                self._commit(kept.union(self._files(folder, F.lit(folder))), schema, base)
            except CommitConflict:
                self._fs.delete(self._at(folder), True)

    def vacuum(self, hours: float = 24.0) -> list[str]:
        """Delete what the last version does not name: runs, manifests, older commits and half-written ones. Returns the runs.

        Only what is older than ``hours`` goes, so that appends and merges on their way keep their files. Versions before
        the last can then no longer be read.
        """
        version, limit = self.version(), (time.time() - 3600 * hours) * 1000
        live, told = {r for r, _, _ in self.runs(version)}, self._told(version)["manifest"]
        old = lambda s: s.getModificationTime() <= limit
        gone = []
        for batch in self._list("data"):
            for run in self._list(f"data/{batch.getPath().getName()}"):
                name = f"data/{batch.getPath().getName()}/{run.getPath().getName()}"
                if run.isDirectory() and name not in live and old(run):
                    self._fs.delete(run.getPath(), True)
                    gone.append(name)
        for s in self._list("manifests"):
            if f"manifests/{s.getPath().getName()}" != told and old(s):
                self._fs.delete(s.getPath(), True)
        for s in self._list("commits"):
            if s.getPath().getName() != f"{version:012d}" and old(s):
                self._fs.delete(s.getPath(), False)
        return gone


def op2_compacted_shards(spark, sf_dir: str) -> DataFrame:
    """A store fed by one large and eight small arrivals, compacted, as its last manifest gives it back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    arrival = F.greatest(F.lit(0), F.pmod(F.xxhash64("doc_id"), F.lit(16)) - 7)
    store = ShardStore(spark, scratch_path(spark, "shards"))
    store.append(docs.withColumn("__wave", arrival), "__wave")
    store.compact()
    store.vacuum(hours=0)  # no other writer knows this store
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


OP2_SQL = "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents"
