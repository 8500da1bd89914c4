"""Price events as a stream: daily votes with late data, recomputation of touched items, listings that fall silent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.timeline import changes, daily_majority


def daily_votes(events: DataFrame, item: str, value: str, at: str, late: str = "2 days") -> DataFrame:
    """(item, day, value, votes) per event-time day; state is dropped ``late`` after a day."""
    rows = events.withColumn("_ts", F.col(at).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", "1 day").alias("_w"), item, value).agg(F.count(F.lit(1)).alias("votes")).select(item, F.to_date("_w.start").alias("day"), value, "votes")


def price_changes(history: DataFrame, item: str, value: str, at: str) -> DataFrame:
    """Daily majority changes of a whole history."""
    return changes(daily_majority(history.withColumn("day", F.to_date(at)), [item], value), [item], value)


def recompute_touched(read_history: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame], None], item: str, value: str, at: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the items of a batch are recomputed from their whole history and handed to ``write`` with the touched keys."""

    def handle(batch: DataFrame, _: int) -> None:
        touched = batch.select(item).distinct().persist()
        write(price_changes(read_history().join(touched, item, "left_semi"), item, value, at), touched)
        touched.unpersist()

    return handle


def silent_listings(confirmations: DataFrame, item: str, at: str, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """(item, last_confirmed, state): ``active`` with each confirmation, ``inactive`` once the watermark is ``hours`` past the last one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({item: [key[0]], "last_confirmed": [pd.Timestamp(last, unit="ms")], "state": ["inactive"]})
            return
        last = max([state.get[0]] if state.exists else [0])
        for pdf in batches:
            if len(pdf):
                last = max(last, int(pdf["_ts"].max().timestamp() * 1000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({item: [key[0]], "last_confirmed": [pd.Timestamp(last, unit="ms")], "state": ["active"]})

    rows = confirmations.withColumn("_ts", F.col(at).cast("timestamp")).withWatermark("_ts", late).select(item, "_ts")
    kind = confirmations.schema[item].dataType.simpleString()
    return rows.groupBy(item).applyInPandasWithState(step, f"{item} {kind}, last_confirmed timestamp, state string", "last long", "append", GroupStateTimeout.EventTimeTimeout)
