"""Streaming counterparts: windowed counts, first-seen words, starts of activity."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import stage

#: Keyed state with timers needs this store of state; it keeps state on disk, not in the heap.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def windowed(stream: DataFrame, key: Column, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per key and event-time window; rows later than ``late`` behind are left out, but for
    complete results, which keep every window."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("win"), key.alias("key")).agg(F.count("*").alias("n")).select("win.start", "win.end", "key", "n")


def first_seen(stream: DataFrame, key: str = "w") -> DataFrame:
    """Each key once, when it first comes, with the size of its first batch.

    State is one number a key and lasts as long as the stream: it grows with the distinct keys.
    :func:`starts` is the form whose state goes with time.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def once(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = sum(len(p) for p in pdfs)
        if not state.exists:
            state.update((n,))
            yield pd.DataFrame({"key": [k[0]], "n_first": [n]})

    return stream.groupBy(key).applyInPandasWithState(once, "key string, n_first long", "n long", "append", GroupStateTimeout.NoTimeout)


def starts(stream: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes", quiet: str = "6 hours") -> DataFrame:
    """(key, started): when a key comes for the first time, or again after more than ``quiet`` without it.

    A key's state is the time it was last seen; a timer clears it when the watermark has passed
    ``quiet`` after that, so state holds only keys that were active lately. Rows older than the
    watermark are left out; a batch may hold any part of a key's rows.
    """
    rest = int(pd.Timedelta(quiet) / pd.Timedelta(milliseconds=1))

    class Starts(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "at long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            at = pd.concat([r["at_"] for r in rows]).sort_values()
            before = self.last.get()[0] if self.last.exists() else None
            gap = at.diff()
            gap.iloc[0] = rest * 1000 + 1 if before is None else at.iloc[0] - before
            last = int(max(at.iloc[-1], before or at.iloc[-1]))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.last.update((last,))
            self.handle.registerTimer(last // 1000 + rest + 1)
            began = at[gap > rest * 1000]
            if len(began):
                # plain objects: the worker joins the frames of several keys, and their types have to agree
                yield pd.DataFrame({"key": pd.Series([str(key[0])] * len(began), dtype=object), "started": began.astype("int64").tolist()})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            self.last.clear()
            return iter(())

        def close(self) -> None:
            pass

    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    timed = timed.select(ts, F.col(key).cast("string").alias("key_"), F.unix_micros(ts).alias("at_"))
    return timed.groupBy("key_").transformWithStateInPandas(Starts(), "key string, started long", "append", "eventTime")


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is now, in as many batches as its source gives, and returns what it wrote.

    In the mode ``complete`` each batch writes the whole result anew, and the last one counts.
    """
    where = f"{stage.folder(spark)}/lexiloom-core/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/log").trigger(availableNow=True)
        if mode == "complete":
            writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{where}/rows"))
        else:
            writer = writer.format("parquet").option("path", f"{where}/rows")
        writer.start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")
