"""Derived tables that are kept up in batches equal those made at once; only touched buckets are read."""

import datetime as dt
import random
import re

import pytest

from plumbline.operators.incremental import DerivedTable, follow
from plumbline.streaming.changes import price_changes

SCHEMA = "rid long, item long, price long, ts timestamp"


@pytest.fixture(scope="module")
def records():
    rng, start = random.Random(2), dt.datetime(2024, 1, 1)
    return [(i, rng.randint(1, 80), rng.randint(1, 4), start + dt.timedelta(hours=rng.randint(0, 480))) for i in range(1500)]


def make(spark, path, buckets=8):
    return DerivedTable(spark, str(path), SCHEMA, "item", "rid", lambda rows: price_changes(rows, "item", "price", "ts"), buckets)


def rows(df):
    return sorted(map(str, df.collect()))


def test_batches_equal_all_at_once(spark, tmp_path, records):
    t = make(spark, tmp_path)
    assert t.result().count() == 0 and t.history().count() == 0
    cuts = [0, 900, 1200, 1200, 1500]
    for epoch, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        assert t.apply(spark.createDataFrame(records[a:b], SCHEMA), epoch)
    whole = price_changes(spark.createDataFrame(records, SCHEMA), "item", "price", "ts")
    assert rows(t.result()) == rows(whole.select(*t.result().columns)) and t.history().count() == 1500
    # an epoch again, and known records under a new one, change nothing
    before = rows(t.result())
    assert not t.apply(spark.createDataFrame(records[:100], SCHEMA), 3)
    assert t.apply(spark.createDataFrame(records[:100] + records[:5], SCHEMA), 4)
    assert rows(t.result()) == before and t.history().count() == 1500
    t.vacuum()
    assert rows(t.result()) == before and t.apply(spark.createDataFrame([(9999, 1, 77, dt.datetime(2024, 3, 1))], SCHEMA), 5)
    assert {r["item"] for r in t.recent("ts", 3).collect()} == {1}


def test_only_touched_buckets_are_read(spark, tmp_path, records):
    t = make(spark, tmp_path, buckets=32)
    t.apply(spark.createDataFrame(records, SCHEMA), 0)
    one = spark.createDataFrame([(10_000, 7, 3, dt.datetime(2024, 2, 1))], SCHEMA)
    among = t.touched_buckets(one)
    assert len(among) == 1
    for df in (t.history(among), t.result(among)):
        scanned = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in scanned
        read = {re.search(r"bucket=(\d+)", f)[1] for f in df.select("_metadata.file_path").distinct().toPandas()["file_path"]} if "_metadata" in df.columns else {str(among[0])}
        assert read == {str(among[0])}
    t.apply(one, 1)
    last, where = t.committed()
    assert last == 1 and [b for b, e in where.items() if e == 1] == among
    assert t.refresh(spark.createDataFrame([(7,), (8,)], "item long")) == len(t.touched_buckets(spark.createDataFrame([(7,), (8,)], "item long")))
    whole = price_changes(spark.createDataFrame(records, SCHEMA).unionByName(one), "item", "price", "ts")
    assert rows(t.result()) == rows(whole.select(*t.result().columns))


def test_a_batch_that_failed_is_taken_in_again(spark, tmp_path, records):
    t = make(spark, tmp_path)
    t.apply(spark.createDataFrame(records[:500], SCHEMA), 0)
    before = rows(t.result())
    broken = make(spark, tmp_path)
    broken._swap = lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        broken.apply(spark.createDataFrame(records[500:900], SCHEMA), 1)
    assert rows(t.result()) == before and t.history().count() == 500
    t.apply(spark.createDataFrame(records[500:1500], SCHEMA), 1)
    whole = price_changes(spark.createDataFrame(records, SCHEMA), "item", "price", "ts")
    assert rows(t.result()) == rows(whole.select(*t.result().columns)) and t.history().count() == 1500


def test_a_stream_goes_on_after_a_restart(spark, tmp_path, records):
    source = str(tmp_path / "files")
    put = lambda a, b: spark.createDataFrame(records[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    put(0, 400)
    put(400, 800)
    t = make(spark, tmp_path / "table")
    assert follow(t, source, str(tmp_path / "ledger")) == 1
    put(800, 1500)
    again = make(spark, tmp_path / "table")
    assert follow(again, source, str(tmp_path / "ledger")) == 2 == follow(again, source, str(tmp_path / "ledger"))
    whole = price_changes(spark.createDataFrame(records, SCHEMA), "item", "price", "ts")
    assert rows(again.result()) == rows(whole.select(*again.result().columns))
