"""Extensions for live captions: the batch operators' rules on streams.

These have no counterpart in batch results; they are offered for feeds.

`live_scenes` keeps cues back until the watermark has passed their time, so cues that
come in another order than they were spoken get the scenes that the batch has; cues
later than the watermark are dropped, as Spark does.  A track's state is the cues kept
back and three numbers, and goes when the track has been silent for `idle`; a track that
speaks again after that starts anew with scene 1.  Rows that are repeated by track and
seq count once, the last to come.  The state store must be RocksDB's
(`spark.sql.streaming.stateStore.providerClass`), as Spark asks of timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuegrid import constants as K

OUT = "track_id string, seq long, start_ms long, end_ms long, scene_no int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Scenes(StatefulProcessor):
    """The scene rule for one track at a time."""

    def __init__(self, low: int, high: int, gap: int, idle_ms: int):
        self.low, self.high, self.gap, self.idle_ms = low, high, gap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "last_end long, n int, scene int, heard long")
        self.waiting = handle.getMapState("waiting", "seq long", "at long, start_ms long, end_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, n, scene, heard = self.open.get() if self.open.exists() else (0, 0, 1, 0)
        times = set()
        for batch in rows:
            for r in batch.itertuples(index=False):
                self.waiting.updateValue((int(r.seq),), (int(r.at), int(r.start_ms), int(r.end_ms)))
                times.add(int(r.at))
        if times:
            # the watermark stays behind the largest time by its delay, so each time is passed by a later one
            for t in times | {max(times) + self.idle_ms}:
                self.handle.registerTimer(t + 1)
            self.open.update((last, n, scene, max(heard, *times)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready, held = [], False
        for (seq,), (at, start, end) in self.waiting.iterator():
            if at <= passed:
                ready.append((seq, start, end))
            else:
                held = True
        last, n, scene, heard = self.open.get() if self.open.exists() else (0, 0, 1, 0)
        out = []
        for seq, start, end in sorted(ready):
            if n >= self.high or (n >= self.low and start - last >= self.gap):
                n, scene = 0, scene + 1
            n, last = n + 1, end
            out.append((key[0], seq, start, end, scene))
            self.waiting.removeKey((seq,))
        if not held and heard + self.idle_ms <= passed:
            self.open.clear()
        elif out:
            self.open.update((last, n, scene, heard))
        if out:
            yield pd.DataFrame(out, columns=["track_id", "seq", "start_ms", "end_ms", "scene_no"])

    def close(self) -> None:
        pass


def live_scenes(
    cues: DataFrame,
    time: str = "ts",
    late: str = "10 seconds",
    idle_ms: int = 3_600_000,
    low: int = K.SCENE_MIN_CUES,
    high: int = K.SCENE_MAX_CUES,
    gap: int = K.SCENE_GAP_MS,
) -> DataFrame:
    """The scene rule over a stream of cues (track_id, seq, start_ms, end_ms and their time), which may come out of order by up to `late`."""
    known = cues.select("track_id", F.col("seq").cast("long").alias("seq"), "start_ms", "end_ms", F.col(time).alias("ts")).where(
        "track_id IS NOT NULL AND seq IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL AND ts IS NOT NULL",
    )
    timed = known.withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return timed.groupBy("track_id").transformWithStateInPandas(Scenes(low, high, gap, idle_ms), OUT, "append", "eventTime")


def live_sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "3.5 seconds", late: str = "1 minute") -> DataFrame:
    """The unbounded variant: sessions closed by a pause alone, with late events up to a bound."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count("*").alias("events")).select(
        key,
        F.col("session.start").alias("start"),
        F.col("session.end").alias("end"),
        "events",
    )


def drop_repeats(cues: DataFrame, time: str, keys: list[str], late: str = "1 minute") -> DataFrame:
    """Repeated cues of a feed, as long as they come within the bound."""
    return cues.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
