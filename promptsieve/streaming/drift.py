"""Score drift and its recalibration triggers on a stream.

The state of a stream is the list of its newest scores, a map of the windows that are still open, and the drift count.
An event-time timer per window closes it once the watermark has passed its end; its scores then join the list and
the window is judged, as the batch definition (``operators.adapt.drift``) judges it. Before the shuffle
each Arrow batch keeps only the newest scores of every stream and window, which no later step needs more of,
so a stream with a third of all events sends a small part of them.

Judgements and triggers go to two tables, written per micro-batch under its number: a micro-batch that is run
again after a failure replaces what it wrote.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from promptsieve.operators import adapt as A
from promptsieve.streaming import feedback as SF

cloudpickle.register_pickle_by_value(sys.modules[__name__])

JUDGED = (
    "stream_id long, win long, n_recent long, recent_mean double, recent_std double, drift_status int, drift_count long, recalibrate int"
)
TRIGGERS = "stream_id long, win long"
ROWS = "stream_id long, win long, ts timestamp, at long, event_id long, score double"


def _newest_of_batches(last: int):
    def cut(batches):
        for rows in batches:
            newest = rows.sort_values(["at", "event_id"], ascending=False)
            yield newest[newest.groupby(["stream_id", "win"], dropna=False).cumcount() < last]

    return cut


class DriftMonitor(StatefulProcessor):
    """Judges every window of one stream by the last scores up to its end."""

    def __init__(self, seconds: int, last: int, limit: float, mean: float, std: float, recalibrate_after: int, forget_after: int | None) -> None:
        self.seconds, self.last, self.limit, self.mean, self.std = seconds, last, limit, mean, std
        self.recalibrate_after, self.forget_after = recalibrate_after, forget_after

    def init(self, handle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "score double")  # in order, at most ``last``
        self.open = handle.getMapState("open", "win long", "at array<long>, event_id array<long>, score array<double>")
        self.count = handle.getValueState("count", "drifts long")

    def _end(self, win: int) -> int:
        return (win + 1) * self.seconds * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        arrived = pd.concat(list(rows)).dropna(subset=["score"])
        for win, part in arrived.groupby("win"):
            win = int(win)
            held = list(zip(*self.open.getValue((win,)))) if self.open.containsKey((win,)) else []
            if not held:
                self.handle.registerTimer(self._end(win))
                if self.forget_after is not None:
                    self.handle.registerTimer(self._end(win) + self.forget_after * 1000)
            held += zip(part["at"].tolist(), part["event_id"].tolist(), part["score"].tolist())
            held = sorted(held)[-self.last:]
            self.open.updateValue((win,), tuple(list(c) for c in zip(*held)))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import numpy as np
        import pandas as pd

        expired = expiredTimerInfo.getExpiryTimeInMs()
        windows = sorted(w for (w,) in self.open.keys())
        recent, drifts, out = None, 0, []
        for win in windows:
            if self._end(win) > expired:
                break
            if recent is None:
                recent = [s for (s,) in self.recent.get()] if self.recent.exists() else []
                drifts = self.count.get()[0] if self.count.exists() else 0
            recent = (recent + list(self.open.getValue((win,))[2]))[-self.last:]
            self.open.removeKey((win,))
            mean, std = float(np.mean(recent)), float(np.std(recent))
            away = abs(mean - self.mean)
            status = 0
            if len(recent) >= self.last and (away > self.limit or abs(std - self.std) > self.limit * 0.5):
                status = 2 if away > self.limit * 2 else 1
            drifts += status > 0
            full = drifts >= self.recalibrate_after
            drifts = 0 if full else drifts
            out.append((key[0], win, len(recent), mean, std, status, drifts, int(full)))
        if recent is not None:
            self.recent.put([(s,) for s in recent])
            self.count.update((drifts,))
        elif self.forget_after is not None and not windows and all(t <= expired for t in self.handle.listTimers()):
            self.recent.clear()
            self.count.clear()
        yield pd.DataFrame(out, columns=["stream_id", "win", "n_recent", "recent_mean", "recent_std", "drift_status", "drift_count", "recalibrate"])

    def close(self) -> None:
        pass


def drift_stream(
    feedback: DataFrame, seconds: int = A.DAY, last: int = 200, limit: float = 0.15, baseline_mean: float = 0.5, baseline_std: float = 0.2,
    recalibrate_after: int = 3, delay: str = "1 hour", beats: DataFrame | None = None, forget_after: int | None = None,
) -> DataFrame:
    """Streaming rows of ``adapt.drift``, one per closed window.

    ``feedback`` has stream_id, ts, event_id and score; rows without a score are left out.  Each
    ``recalibrate_after``-th drifting window triggers recalibration and resets the count.  With
    ``forget_after`` a stream without events for so many seconds starts anew.
    """
    SF.state_store(feedback.sparkSession)
    stamped = SF.with_heartbeats(feedback.select("stream_id", "ts", "event_id", "score"), beats)
    rows = stamped.select("stream_id", A.window_index(stamped, seconds).alias("win"), "ts", F.unix_micros("ts").alias("at"),
                          F.col("event_id").cast("long").alias("event_id"), F.col("score").cast("double").alias("score"))
    cut = rows.mapInPandas(_newest_of_batches(last), ROWS).withWatermark("ts", delay)
    monitor = DriftMonitor(seconds, last, limit, baseline_mean, baseline_std, recalibrate_after, forget_after)
    return cut.groupBy("stream_id").transformWithStateInPandas(monitor, JUDGED, "append", "eventTime")


def put(frame: DataFrame, folder: str, batch_id: int) -> None:
    """Write a micro-batch under its number; writing it again replaces it."""
    frame.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All micro-batches written with ``put``, with their number in ``batch``."""
    return spark.read.schema(f"{schema}, batch long").parquet(SF.make_folder(spark, folder))


def start_drift(judged: DataFrame, folder: str, on_trigger: Callable[[DataFrame], None] | None = None, **trigger) -> StreamingQuery:
    """Write judgements to ``folder``/judged and recalibration triggers to ``folder``/triggers.

    ``on_trigger`` is called with a micro-batch's triggers if there are any, such as to retrain (``loop.retrain``); it
    is called again if the micro-batch is run again.
    """
    def both(batch, batch_id):
        held = batch.persist()
        put(held, f"{folder}/judged", batch_id)
        triggers = held.where("recalibrate = 1").select("stream_id", "win")
        put(triggers, f"{folder}/triggers", batch_id)
        if on_trigger is not None and not triggers.isEmpty():
            on_trigger(triggers)
        held.unpersist()

    return (judged.writeStream.foreachBatch(both).option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def replay_drift(feedback: DataFrame, folder: str, seconds: int = A.DAY, **options) -> tuple[DataFrame, DataFrame]:
    """(judgements, triggers) of a bounded feedback stream, all windows included."""
    spark, beats = feedback.sparkSession, f"{folder}/beats"
    judged = drift_stream(feedback, seconds, beats=SF.heartbeats(spark, beats), **options)
    SF.finish(spark, lambda: start_drift(judged, folder), beats, seconds)
    return stored(spark, f"{folder}/judged", JUDGED).drop("batch"), stored(spark, f"{folder}/triggers", TRIGGERS).drop("batch")
