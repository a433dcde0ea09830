"""Rate audit of a stream of calls, call by call and per key, with state and event-time timers.

Calls may come late and in any order. They wait in the state of their key's group until the watermark has passed them; then
a timer puts them in order and each is compared with the key's one before it, which the state remembers. So the rows are those of
``incremental.spacing`` over all calls that are not later than the watermark allows, whatever the batches were. A group
keeps the calls of the watermark's delay and each key's last call, not its history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What keeps the state; timers need it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups that keys are dealt to by a hash, each with a state of its own, at most.
GROUPS = 4096
#: Calls that are kept in one value of a group's state, and that are returned at once, at most.
TOGETHER = 1 << 17


def packed(calls: pd.DataFrame) -> list[tuple[bytes]]:
    """Calls (key, us) as values of a state."""
    out = []
    for lo in range(0, len(calls), TOGETHER):
        some = calls.iloc[lo : lo + TOGETHER]
        batch = pa.record_batch([pa.array(some["key"], pa.string(), from_pandas=True), pa.array(some["us"].to_numpy(np.int64))], names=["key", "us"])
        with pa.ipc.new_stream(sink := pa.BufferOutputStream(), batch.schema) as writer:
            writer.write_batch(batch)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def unpacked(values: Iterator[tuple]) -> pd.DataFrame:
    found = [pa.ipc.open_stream(bytes(x[0])).read_all() for x in values]
    return pa.concat_tables(found).to_pandas() if found else pd.DataFrame({"key": np.zeros(0, object), "us": np.zeros(0, np.int64)})


class Spacing(StatefulProcessor):
    """Seconds since the key's call before, and whether they are less than the least spacing, of a group of keys.

    Calls wait packed, a value for each portion that comes, and there is a timer for the first of each portion and of what is
    left when one has fired; so values and timers grow with the portions, not with the calls or keys.
    """

    def __init__(self, least_us: int) -> None:
        self.least_us = least_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "calls binary")
        self.last = handle.getListState("last", "calls binary")
        self.served = handle.getValueState("served", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for b in rows:
            if len(b):
                self.waiting.appendList(packed(b))
                first = int(b["us"].min()) if first is None else min(first, int(b["us"].min()))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
            self.served.clear()
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms = timerValues.getCurrentWatermarkInMs()
        if self.served.exists() and int(self.served.get()[0]) == ms:  # an earlier timer has done it
            yield from ()
            return
        self.served.update((ms,))
        waiting = unpacked(self.waiting.get()) if self.waiting.exists() else unpacked(iter(()))
        passed = waiting["us"].to_numpy() <= ms * 1000
        due, later = waiting[passed], waiting[~passed]
        if not len(due):
            yield from ()
            return
        if len(later):
            self.waiting.put(packed(later))
            self.handle.registerTimer(-(-int(later["us"].min()) // 1000))
        else:
            self.waiting.clear()
        last = unpacked(self.last.get()) if self.last.exists() else unpacked(iter(()))
        both = pd.concat([last, due])  # of each key the last call before, if there is one, then those that are due
        old = np.arange(len(both)) < len(last)
        of, keys = pd.factorize(both["key"], use_na_sentinel=False)
        us = both["us"].to_numpy(np.int64)
        order = np.lexsort((us, ~old, of))
        of, us, old = of[order], us[order], old[order]
        first = np.diff(of, prepend=-1) != 0
        self.last.put(packed(pd.DataFrame({"key": keys, "us": us[np.r_[first[1:], True]]})))
        gaps = np.diff(us, prepend=0)
        gap_s, early = np.where(first, np.nan, gaps / 1e6), ~first & (gaps < self.least_us)
        out = pd.DataFrame({"key": np.asarray(keys, object)[of], "us": us, "gap_s": gap_s, "early": early})[~old]
        for lo in range(0, len(out), TOGETHER):
            yield out.iloc[lo : lo + TOGETHER]

    def close(self) -> None:
        pass


def spaced(calls: DataFrame, ts: str, key: str, limit: int, delay: str) -> DataFrame:
    """key (as text), ts, gap_s, early of each call of a stream once the watermark (``delay`` behind) has passed it.

    Needs ``spark.sql.streaming.stateStore.providerClass`` to be ``STATE_STORE``.
    """
    rows = calls.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", delay)
    rows = rows.withColumn("us", F.unix_micros("at")).withColumn("keys", F.pmod(F.xxhash64("key"), F.lit(GROUPS)))
    out = rows.groupBy("keys").transformWithStateInPandas(Spacing(60_000_000 // limit), "key string, us long, gap_s double, early boolean", "append", "eventTime")
    return out.select("key", F.timestamp_micros("us").alias("ts"), "gap_s", "early")
