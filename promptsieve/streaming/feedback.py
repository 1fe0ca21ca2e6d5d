"""Feedback adaptation with Structured Streaming.

Two queries: the first closes event-time windows behind a watermark and appends them
to a table, the second folds closed windows into per-stream state.  Micro-batch
borders do not matter: state advances once per window, in window order.

The end of a bounded feed moves no watermark, so its last windows would stay open.  ``finish`` then adds
a heartbeat, a row of a later time without content, from a second source of the same query.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

from promptsieve.operators import adapt as A

# Ship the state functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NOW = (
    "fp_ema double, threshold double, a1 double, a2 double, a3 double, last_update long, day long, used long, updates long"
)
SNAPSHOT = "fp_ema double, threshold double, a1 double, a2 double, a3 double"
ADAPTED = (
    "stream_id long, win long, fp_ema double, threshold double, weight_1 double, weight_2 double, "
    "weight_3 double, updated int, restored int"
)
WINDOWS = (
    "stream_id long, win long, tp long, fp long, fn long, tn long, n long, fp_rate double, "
    "fn_rate double, accuracy double, component_3 double, component_1 double, component_2 double"
)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor must reach.

    Without that setting a ``local[...]`` session, whose only machine shares everything, gets a
    temporary folder; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="promptsieve-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def state_store(spark: SparkSession) -> None:
    """Queries started from now on keep their state in RocksDB, which states of several variables need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def make_folder(spark: SparkSession, path: str) -> str:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    return path


def heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming (ts) of the heartbeats written to the folder."""
    return spark.readStream.schema("ts timestamp").parquet(make_folder(spark, folder))


def with_heartbeats(feedback: DataFrame, beats: DataFrame | None) -> DataFrame:
    """The feedback with ``ts`` as an instant, and rows of heartbeats, in which all else is null."""
    stamped = feedback.withColumn("ts", A.instant(feedback))
    return stamped if beats is None else stamped.unionByName(beats, allowMissingColumns=True)


def closed_windows(feedback: DataFrame, seconds: int = A.DAY, delay: str = "1 hour", beats: DataFrame | None = None) -> DataFrame:
    """Streaming (stream_id, win, cells, rates) of windows the watermark has passed.

    ``feedback`` has stream_id, ts, pred and label; windows without a judged row are left out.  Later
    events are dropped: ``fed`` and ``closed`` of the query's observed metrics count judged rows that came
    in and rows of emitted windows (see ``LateCounter``).
    """
    p, y = F.col("pred"), F.col("label")
    stamped = with_heartbeats(feedback.select("stream_id", "ts", "pred", "label"), beats).observe(
        "fed", F.count_if(p.isin(0, 1) & y.isin(0, 1)).alias("rows")).withWatermark("ts", delay)
    cells = stamped.groupBy("stream_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 1)).alias("fn"), F.count_if((p == 0) & (y == 0)).alias("tn"),
    ).where("tp + fp + fn + tn > 0")
    win = F.floor(F.unix_timestamp(F.col("w.start")) / seconds).cast("bigint")
    rated = A.with_rates(cells.select("stream_id", win.alias("win"), "tp", "fp", "fn", "tn"))
    return rated.observe("closed", F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


class LateCounter(StreamingQueryListener):
    """Judged feedback rows that came too late for their window, over all queries it listens to.

    ``late`` is what came in and is in no emitted window: exact once all windows are closed, and before
    that it includes rows of windows still open.  Add it with ``spark.streams.addListener``.
    """

    def __init__(self) -> None:
        self.fed = self.closed = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.add(event.progress.observedMetrics)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def add(self, metrics) -> None:
        for name in ("fed", "closed"):
            if name in metrics:
                setattr(self, name, getattr(self, name) + (metrics[name]["rows"] or 0))

    @property
    def late(self) -> int:
        return self.fed - self.closed


def join_labels(predictions: DataFrame, labels: DataFrame, delay: str = "1 hour", within: str = "1 day") -> DataFrame:
    """Streaming join of predictions with labels that arrive up to ``within`` later."""
    p = predictions.withWatermark("ts", delay).alias("p")
    y = labels.withWatermark("label_ts", delay).alias("y")
    near = F.expr(f"y.label_ts between p.ts and p.ts + interval {within}")
    return p.join(y, (F.col("p.prompt_id") == F.col("y.prompt_id")) & near).select("p.*", "y.label")


class Governor(StatefulProcessor):
    """Threshold and weights of one stream, folded over its closed windows in order.

    Besides the present values it keeps a map of the values before each of the last ``keep`` updates.  A
    window whose error exceeds ``rollback_error`` takes back the newest update that is still in the map,
    threshold, average and weights alike, whatever the cooldown; the next such window goes further back.
    """

    def __init__(self, seconds: int, threshold: float, alpha: float, target_fp: float, low: float, high: float, weight_alpha: float,
                 direction: int, cooldown: int, per_day: int, rollback_error: float | None, keep: int) -> None:
        self.seconds, self.threshold, self.alpha, self.target_fp = seconds, threshold, alpha, target_fp
        self.low, self.high, self.weight_alpha, self.direction = low, high, weight_alpha, direction
        self.cooldown, self.per_day, self.rollback_error, self.keep = cooldown, per_day, rollback_error, keep

    def init(self, handle) -> None:
        self.now = handle.getValueState("now", NOW)
        self.history = handle.getMapState("history", "number long", SNAPSHOT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import math

        import pandas as pd

        start = (0.05, self.threshold, 0.85, 0.85, 0.85, -(10 ** 12), -1, 0, 0)
        *values, last, day, used, updates = self.now.get() if self.now.exists() else start
        out = []
        for s in pd.concat(list(rows)).sort_values("win").itertuples(index=False):
            at = (int(s.win) + 1) * self.seconds
            today = at // 86400
            used = used if today == day else 0
            burst = self.rollback_error is not None and s.accuracy < 1.0 - self.rollback_error
            restored = burst and self.history.containsKey((updates,))
            allowed = not burst and at - last >= self.cooldown and used < self.per_day
            if restored:
                values = list(self.history.getValue((updates,)))
                self.history.removeKey((updates,))
                updates -= 1
            elif allowed:
                updates += 1
                self.history.updateValue((updates,), tuple(values))
                if self.history.containsKey((updates - self.keep,)):
                    self.history.removeKey((updates - self.keep,))
                ema, thr, *components = values
                ema = self.alpha * s.fp_rate + (1.0 - self.alpha) * ema
                thr = min(self.high, max(self.low, thr + self.direction * self.alpha * (ema - self.target_fp)))
                seen = (s.component_1, s.component_2, s.component_3)
                values = [ema, thr, *(self.weight_alpha * c + (1.0 - self.weight_alpha) * a for c, a in zip(seen, components))]
                last, used = at, used + 1
            day = today
            top = max(values[2:])
            powers = [math.exp(a - top) for a in values[2:]]
            out.append((key[0], s.win, *values[:2], *(p / sum(powers) for p in powers), int(allowed), int(restored)))
        self.now.update((*values, last, day, used, updates))
        yield pd.DataFrame(out, columns=["stream_id", "win", "fp_ema", "threshold", "weight_1", "weight_2", "weight_3", "updated", "restored"])

    def close(self) -> None:
        pass


def adapt_stream(
    windows: DataFrame, seconds: int = A.DAY, threshold: float = 0.55, alpha: float = 0.001,
    target_fp: float = 0.05, low: float = 0.30, high: float = 0.80, weight_alpha: float = 0.05,
    direction: int = -1, cooldown: int = 600, per_day: int = 144, rollback_error: float | None = None, keep: int = 16,
) -> DataFrame:
    """Streaming threshold and weights after every closed window.

    An update needs ``cooldown`` seconds since the last one and at most ``per_day`` a day; otherwise the
    state stays and ``updated`` is 0.  With ``rollback_error`` a window whose error exceeds it restores
    what the last update changed (``restored``), and updates nothing.
    """
    state_store(windows.sparkSession)
    governor = Governor(seconds, threshold, alpha, target_fp, low, high, weight_alpha, direction, cooldown, per_day, rollback_error, keep)
    return windows.groupBy("stream_id").transformWithStateInPandas(governor, ADAPTED, "append", "none")


def start(stream: DataFrame, target: str) -> StreamingQuery:
    """Append all available input to a parquet table."""
    return (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", target + ".checkpoint")
            .trigger(availableNow=True).start(target))


def run_to_end(stream: DataFrame, target: str) -> DataFrame:
    """Process all available input into a parquet table and read it back."""
    start(stream, target).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def _instants(query: StreamingQuery, delay: timedelta) -> list[datetime]:
    """Event times that the query has reached."""
    read = lambda text: datetime.fromisoformat(text.replace("Z", "+00:00"))
    found = []
    for progress in query.recentProgress:
        times = progress["eventTime"]
        found += [read(times["max"])] if "max" in times else []
        mark = read(times["watermark"]) if "watermark" in times else datetime.fromtimestamp(0, timezone.utc)
        found += [mark + delay] if mark.timestamp() > 0 else []
    return found


def finish(spark: SparkSession, begin: Callable[[], StreamingQuery], beats: str, seconds: int = A.DAY, delay: timedelta = timedelta(hours=1)) -> list[StreamingQuery]:
    """Run a query over a bounded feed to its end: ``begin`` starts it on all available input, with heartbeats from
    the folder ``beats``.  A heartbeat behind the last window then closes what is open.  Events that
    come after that are late."""
    beat = lambda at: spark.createDataFrame([(at,)], "ts timestamp").coalesce(1).write.mode("append").parquet(beats)
    origin = datetime.fromtimestamp(0, timezone.utc)
    beat(origin)  # so that there is a micro-batch, which tells the watermark, even if all events were processed before
    queries = [begin()]
    queries[0].awaitTermination()
    reached = [t for t in _instants(queries[0], delay) if t > origin]
    if reached:
        beat(max(reached) + timedelta(seconds=seconds) + delay)
        queries.append(begin())
        queries[1].awaitTermination()
    return queries


def closed_to_end(feedback: DataFrame, target: str, seconds: int = A.DAY, counter: LateCounter | None = None) -> DataFrame:
    """The windows of a bounded feedback stream, the last ones too, as a parquet table."""
    spark = feedback.sparkSession
    windows = closed_windows(feedback, seconds, beats=heartbeats(spark, target + ".beats"))
    for query in finish(spark, lambda: start(windows, target), target + ".beats", seconds):
        for progress in query.recentProgress if counter is not None else ():
            counter.add(progress["observedMetrics"])
    return spark.read.schema(windows.schema).parquet(target)


def replay(spark: SparkSession, feedback: DataFrame, seconds: int = A.DAY, **options) -> DataFrame:
    """Both queries in turn over a bounded feedback stream; every window appears once."""
    folder = shared_folder(spark, "replay")
    closed_to_end(feedback, folder + "/windows", seconds)
    closed = spark.readStream.schema(WINDOWS).parquet(folder + "/windows")
    return run_to_end(adapt_stream(closed, seconds=seconds, **options), folder + "/adapted")
