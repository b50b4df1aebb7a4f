"""Sampling of a stream of frames: every n-th frame of each video, the first `most` of them, as the batch operator gives them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attesta.storage import shared_folder

_SAMPLE = "video long, idx long, ts timestamp, place int"


class _Sampler(StatefulProcessor):
    """Per video how many frames went out, and the frames that wait for the watermark: at most as many as may still go out.

    A frame is final once the watermark has passed it, as no earlier one can follow. A timer at the first one's time tells
    that; all that are final by then go out, and the next one gets a timer. State is a row, read and written once a call.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "sent int, idx array<long>, ms array<long>")

    def _read(self) -> tuple[int, dict[int, int]]:
        if not self.state.exists():
            return 0, {}
        sent, idx, ms = self.state.get()
        return sent, dict(zip(idx, ms, strict=True))

    def _write(self, sent: int, waiting: dict[int, int]) -> None:
        self.state.update((sent, list(waiting), list(waiting.values())))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sent, had = self._read()
        held = dict(had)
        for frame in rows:
            held |= dict(zip(frame["idx"].tolist(), frame["ms"].tolist(), strict=True))
        kept = dict(sorted(held.items())[: max(0, self.most - sent)])
        if kept != had:
            self._write(sent, kept)
            if not had or min(kept.values()) != min(had.values()):
                self.handle.registerTimer(min(kept.values()) - 1)  # it expires as soon as rows of that time are late
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        sent, waiting = self._read()
        ready = sorted((idx, ms) for idx, ms in waiting.items() if ms - 1 <= now)[: max(0, self.most - sent)]
        if ready:
            left = {idx: ms for idx, ms in waiting.items() if ms - 1 > now}
            self._write(sent + len(ready), left)
            if left:
                self.handle.registerTimer(min(left.values()) - 1)
            yield pd.DataFrame({"video": key[0], "idx": [i for i, _ in ready], "ts": pd.to_datetime([m for _, m in ready], unit="ms"), "place": range(sent + 1, sent + len(ready) + 1)})

    def close(self) -> None:
        pass


def sample_stream(frames: DataFrame, every: int, most: int = 24, lateness: str = "10 seconds") -> DataFrame:
    """frames: video, idx, ts, streamed, in any order within `lateness`. The first `most` frames of each video whose idx is a
    multiple of `every`: video, idx, ts (to milliseconds), place from 1. Frames of a video have growing times.

    Rows later than that are dropped by the watermark; repeated ones count once. State is `most` frames a video at the most.
    The state store has to be RocksDB's (spark.sql.streaming.stateStore.providerClass).
    """
    f = frames.withWatermark("ts", lateness).where(F.pmod("idx", F.lit(max(1, every))) == 0)
    f = f.select(F.col("video").cast("long").alias("video"), F.col("idx").cast("long").alias("idx"), "ts", F.unix_millis("ts").alias("ms"))
    return f.groupBy("video").transformWithStateInPandas(_Sampler(most), outputStructType=_SAMPLE, outputMode="Append", timeMode="EventTime")


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONF = "spark.sql.streaming.stateStore.providerClass"


def run_to_end(stream: DataFrame) -> DataFrame:
    """All that a stream gives for the rows that are there now, as a table in the shared folder."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CONF)
    spark.conf.set(_CONF, PROVIDER)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(_CONF, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
