"""Derived tables that follow their records: only the buckets of touched items are read, recomputed and swapped."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class _Folder:
    """Small files in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(name))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def write(self, name: str, text: str) -> bool:
        """Whether ``name`` is new: the text is written beside it and renamed, which fails if another writer was first."""
        out = self.fs.create(self._at(f".{name}.part"), True)
        out.write(bytearray(text.encode()))
        out.close()
        return not self.exists(name) and self.fs.rename(self._at(f".{name}.part"), self._at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text


class DerivedTable:
    """Records of items, and a table derived from each item's whole history, both in buckets by a hash of the item.

    history/epoch=E/bucket=B holds the records that came with batch E, result/epoch=E/bucket=B what is derived from all records
    of the bucket's items since then. The manifest of E says which epoch holds the result of each bucket; it is renamed into
    place last, so readers see all of a batch or nothing, and files of a batch that failed are written anew. A batch with
    an epoch that is committed already changes nothing; nor do records whose id is known. One writer at a time.

    ``derive`` makes the rows of the result from the records of some items; the result must hold the item's column. The
    manifest and the list of touched buckets are bounded by ``buckets``, whatever the number of items and records.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, item: str, record: str, derive: Callable[[DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.path, self.item, self.record, self.derive, self.buckets = spark, path.rstrip("/"), item, record, derive, buckets
        self.empty = spark.createDataFrame([], schema)
        self.manifests = _Folder(spark, f"{self.path}/manifests")
        self.columns = self.empty.columns
        self.result_schema = derive(self.empty).schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.item), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str, schema, keep: Column) -> DataFrame:
        if not _Folder(self.spark, f"{self.path}/{kind}").exists():
            return self.spark.createDataFrame([], schema).withColumns({"epoch": F.lit(0), "bucket": F.lit(0)}).where("false")
        whole = self.spark.createDataFrame([], schema).withColumns({"epoch": F.lit(0), "bucket": F.lit(0)}).schema
        return self.spark.read.schema(whole).parquet(f"{self.path}/{kind}").where(keep)

    def committed(self) -> tuple[int, dict[int, int]]:
        """The last epoch, -1 at first, and the epoch of each bucket's result."""
        names = [int(n) for n in self.manifests.names() if n.isdigit()]
        last = max(names, default=-1)
        return last, {int(b): e for b, e in json.loads(self.manifests.read(str(last))).items()} if names else {}

    def history(self, among: list[int] | None = None) -> DataFrame:
        """The committed records; ``among``: of these buckets, and no other bucket's files are read."""
        last, _ = self.committed()
        keep = F.col("epoch") <= last
        return self._read("history", self.empty.schema, keep if among is None else keep & F.col("bucket").isin(among)).select(*self.columns)

    def result(self, among: list[int] | None = None) -> DataFrame:
        """The derived table; with ``among`` only of these buckets."""
        _, where = self.committed()
        where = {b: e for b, e in where.items() if among is None or b in among}
        if not where:
            return self.spark.createDataFrame([], self.result_schema)
        current = F.create_map(*(F.lit(x) for be in sorted(where.items()) for x in be))
        return self._read("result", self.result_schema, F.try_element_at(current, F.col("bucket")) == F.col("epoch")).drop("epoch", "bucket")

    def touched_buckets(self, items: DataFrame) -> list[int]:
        return sorted(r["b"] for r in items.select(self._bucket().alias("b")).distinct().collect())

    def _swap(self, epoch: int, touched: DataFrame, among: list[int], records: DataFrame) -> None:
        """Writes the result of some buckets, the touched items recomputed and the others as they are, and commits."""
        _, where = self.committed()
        keys = touched.select(self.item).distinct()
        fresh = self.derive(records.join(keys, self.item, "left_semi"))
        kept = self.result(among).join(keys, self.item, "left_anti")
        both = kept.unionByName(fresh).withColumn("bucket", self._bucket())
        both.repartition(len(among), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/result/epoch={epoch}")
        if not self.manifests.write(str(epoch), json.dumps(where | dict.fromkeys(among, epoch))):
            raise RuntimeError(f"epoch {epoch} was committed by another writer")

    def apply(self, batch: DataFrame, epoch: int) -> bool:
        """Takes in a batch of records; False if its epoch was taken in before. NULL items have no bucket of their own and are kept as one item."""
        last, where = self.committed()
        if epoch <= last:
            return False
        rows = batch.select(*self.columns).dropDuplicates([self.record])
        among = self.touched_buckets(rows)
        if not among:
            self.manifests.write(str(epoch), json.dumps(where))
            return True
        known = self.history(among)
        new = rows.join(known.select(self.record), self.record, "left_anti").withColumn("bucket", self._bucket())
        folder = f"{self.path}/history/epoch={epoch}"
        new.repartition(len(among), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        added = self._read("history", self.empty.schema, F.col("epoch") == epoch).select(*self.columns)
        self._swap(epoch, added, among, known.unionByName(added))
        return True

    def refresh(self, items: DataFrame) -> int:
        """Recomputes some items from their records, as after a change of the rule; returns how many buckets were read."""
        among = self.touched_buckets(items)
        if among:
            self._swap(self.committed()[0] + 1, items, among, self.history(among))
        return len(among)

    def recent(self, at: str, days: int) -> DataFrame:
        """Items with a record on the last ``days`` days that have records."""
        rows = self.history()
        last = rows.agg(F.max(F.to_date(at)).alias("_last"))
        return rows.join(F.broadcast(last)).where(F.to_date(at) > F.date_sub("_last", days)).select(self.item).distinct()  # one row

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the results that none of the last ``keep`` manifests names, and older manifests; not beside a running batch."""
        names = sorted(int(n) for n in self.manifests.names() if n.isdigit())
        used = {e for n in names[-keep:] for e in json.loads(self.manifests.read(str(n))).values()}
        results = _Folder(self.spark, f"{self.path}/result")
        for name in results.names():
            if name.startswith("epoch=") and int(name[6:]) not in used:
                results.delete(name)
        for n in names[:-keep]:
            self.manifests.delete(str(n))


def follow(table: DerivedTable, source: str, checkpoint: str, files_at_once: int = 1) -> int:
    """Takes in the files of a folder that the checkpoint's ledger does not know yet, in batches; returns the last epoch.

    The ledger of the stream names the files of each batch before the batch is taken in, and the table knows the epochs that
    it has: a batch that was cut short is taken in again, whole, and one that was committed is left out.
    """
    stream = table.spark.readStream.schema(table.empty.schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    query = stream.writeStream.foreachBatch(lambda batch, epoch: table.apply(batch, epoch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.committed()[0]
