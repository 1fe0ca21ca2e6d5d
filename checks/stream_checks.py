"""Streaming queries over the event table, against the batch definitions in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.feedback_checks import BUSY, LAST, NUDGE, fold_sql
from checks.feedback_checks import ORACLES as FB
from checks.signal_checks import rounded
from checks.sql import FEEDBACK
from promptsieve.sources import tables as T
from promptsieve.streaming import drift as DR
from promptsieve.streaming import feedback as SF
from promptsieve.streaming import loop as OL


def event_stream(spark, sf):
    schema = T.table(spark, sf, "events").schema
    # A file source reads folders; the filter picks the table's file among the others.
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return as_feedback(events)


def as_feedback(events):
    score = (F.col("event_id") * 37 % 100) / F.lit(100.0)
    return events.select(
        F.col("user_id").alias("stream_id"), "event_id", "ts", score.alias("score"), (score >= 0.55).cast("int").alias("pred"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def feedback_stream(spark, sf):
    return event_stream(spark, sf).select("stream_id", "ts", "pred", "label")


def busy_stream(spark, sf):
    """Two streams with half the events each, as in the batch checks."""
    return event_stream(spark, sf).withColumn("stream_id", F.col("stream_id") % 2)


def in_parts(spark, sf, parts, part):
    """The event table as a stream of one file per part, in the order of their numbers."""
    events, folder = T.table(spark, sf, "events"), SF.shared_folder(spark, "parts")
    for k in range(parts):
        events.where(part == k).coalesce(1).write.mode("append").parquet(folder)
    return as_feedback(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder))


def closed(spark, sf):
    return SF.closed_to_end(feedback_stream(spark, sf), SF.shared_folder(spark, "windows"))


def drifted(spark, sf):
    return DR.replay_drift(busy_stream(spark, sf), SF.shared_folder(spark, "drift"), last=LAST)


def late_feedback(spark, sf):
    """A third of the events after the other, so that most of the second and third come late."""
    counter = SF.LateCounter()
    feedback = in_parts(spark, sf, 3, F.col("event_id") % 3)
    windows = SF.closed_to_end(feedback, SF.shared_folder(spark, "late"), counter=counter)
    return windows.agg(F.sum("n").alias("closed")).select(
        F.lit(counter.fed).cast("long").alias("fed"), "closed", F.lit(counter.late).cast("long").alias("late"))


def buffer(spark, sf):
    folder = SF.shared_folder(spark, "buffer")
    stream = in_parts(spark, sf, 3, F.col("event_id") % 3).withColumn("stream_id", F.col("stream_id") % 2)
    OL.start_buffer(stream, folder).awaitTermination()
    return OL.buffered(spark, folder, size=5000, minimum=100).select("stream_id", "event_id", "buffered")


def online_loop(spark, sf):
    """Feedback and documents to score arrive in two halves, with a retraining after each, under two running queries."""
    folder, fed, asked = (SF.make_folder(spark, SF.shared_folder(spark, n)) for n in ("loop", "fed", "asked"))
    events, prompts = T.table(spark, sf, "events"), T.scores(spark, sf).select("prompt_id", "score")
    feedback = as_feedback(spark.readStream.schema(events.schema).parquet(fed)).withColumn("stream_id", F.col("stream_id") % 2)
    buffering = OL.start_buffer(feedback, folder, processingTime="1 second")
    scoring = OL.start_scoring(spark.readStream.schema(prompts.schema).parquet(asked), folder, processingTime="1 second")
    try:
        for half in (0, 1):
            events.where(F.col("event_id") % 2 == half).write.mode("append").parquet(fed)
            prompts.where(F.col("prompt_id") % 2 == half).write.mode("append").parquet(asked)
            buffering.processAllAvailable()
            scoring.processAllAvailable()
            OL.retrain(spark, folder)
    finally:
        buffering.stop()
        scoring.stop()
    return folder


def versions(spark, sf):
    return OL.Versions(spark, online_loop(spark, sf)).states()


QUERIES = {
    "streaming_windows": lambda s, sf: rounded(closed(s, sf).select("stream_id", "win", "tp", "fp", "fn", "tn", "fp_rate", "fn_rate")),
    "streaming_adaptation": lambda s, sf: rounded(SF.replay(s, feedback_stream(s, sf)).select(
        "stream_id", "win", *[(F.col(c) + NUDGE).alias(c) for c in ("fp_ema", "threshold")]), 9),
    "streaming_governor": lambda s, sf: SF.replay(s, feedback_stream(s, sf), cooldown=3 * 86_400).groupBy("stream_id").agg(
        F.sum("updated").alias("updates")),
    "streaming_drift": lambda s, sf: rounded(drifted(s, sf)[0]),
    "streaming_recalibration": lambda s, sf: drifted(s, sf)[1],
    "streaming_late_feedback": late_feedback,
    "streaming_buffer": buffer,
    "streaming_retraining": lambda s, sf: versions(s, sf).select(
        "version", "n", *[F.round(F.col(c) + NUDGE, 9).alias(c) for c in ("threshold", "fp_ema")]),
    "streaming_scores": lambda s, sf: OL.scored(s, online_loop(s, sf)).groupBy("version").agg(F.count(F.lit(1)).alias("n")),
}
_CELLS = f"""{FEEDBACK},
c as (select stream_id, cast(floor(epoch(ts) / 86400) as bigint) as win, count(case when pred = 1 and label = 1 then 1 end) as tp,
  count(case when pred = 1 and label = 0 then 1 end) as fp, count(case when pred = 0 and label = 1 then 1 end) as fn,
  count(case when pred = 0 and label = 0 then 1 end) as tn from feedback group by 1, 2)"""


def _retrain_sql() -> str:
    """One step of average and threshold per half, over the newest 5,000 events of each stream in that half."""
    moved = "least(cast(0.8 as double), greatest(cast(0.3 as double), prior - cast(0.001 as double) * (fp_ema - cast(0.05 as double))))"
    ema = lambda before: f"cast(0.001 as double) * fp / cast(greatest(fp + tn, 1) as double) + cast(0.999 as double) * {before}"
    return f"""with {BUSY}, r as (select *, event_id % 2 as half, row_number() over (partition by stream_id, event_id % 2 order by ts desc, event_id desc) as r from feedback),
cells as (select half, count(*) as n, count(case when pred = 1 and label = 0 then 1 end) as fp, count(case when pred = 0 and label = 0 then 1 end) as tn from r where r <= 5000 group by 1),
v1 as (select cast(1 as bigint) as version, n, {ema('cast(0.05 as double)')} as fp_ema, cast(0.55 as double) as prior from cells where half = 0),
t1 as (select version, n, fp_ema, {moved} as threshold from v1),
v2 as (select cast(2 as bigint) as version, cells.n, {ema('t1.fp_ema')} as fp_ema, t1.threshold as prior from cells, t1 where half = 1),
t2 as (select version, n, fp_ema, {moved} as threshold from v2)
select version, n, round(threshold + 1e-12, 9) as threshold, round(fp_ema + 1e-12, 9) as fp_ema from (select * from t1 union all select * from t2)"""


# Events are late by the watermark that the micro-batch before theirs closed windows with.
_LATE = f"""{FEEDBACK}, b as (select *, event_id % 3 as part, cast(floor(epoch(ts) / 86400) as bigint) as win from feedback),
m as (select part, max(epoch(ts)) as newest from b group by 1),
j as (select b.*, coalesce((select max(newest) from m where m.part < b.part - 1), 0) - 3600 as mark from b)"""
ORACLES = {
    "streaming_windows": f"""with {_CELLS} select stream_id, win, tp, fp, fn, tn, round(fp / cast(greatest(fp + tn, 1) as double), 6) as fp_rate,
  round(fn / cast(greatest(fn + tp, 1) as double), 6) as fn_rate from c""",
    "streaming_adaptation": f"{fold_sql(0.001)} select stream_id, win, round(fp_ema + 1e-12, 9) as fp_ema, round(threshold + 1e-12, 9) as threshold from p where rn > 0",
    "streaming_governor": f"""with recursive {_CELLS}, k as (select stream_id, win, row_number() over (partition by stream_id order by win) as rn from c),
g as (select stream_id, rn, win as last_win, cast(1 as bigint) as used from k where rn = 1
  union all select k.stream_id, k.rn, case when k.win - last_win >= 3 then k.win else last_win end, used + case when k.win - last_win >= 3 then 1 else 0 end
  from g join k on k.stream_id = g.stream_id and k.rn = g.rn + 1)
select stream_id, max(used) as updates from g group by 1""",
    "streaming_drift": FB["drift_check"],
    "streaming_recalibration": f"select stream_id, win from ({FB['drift_check']}) where recalibrate = 1",
    "streaming_late_feedback": f"""with {_LATE} select count(*) as fed, count(*) - count(case when (win + 1) * 86400 <= mark then 1 end) as closed,
  count(case when (win + 1) * 86400 <= mark then 1 end) as late from j""",
    "streaming_buffer": FB["feedback_buffer"],
    "streaming_retraining": _retrain_sql(),
    "streaming_scores": "select cast(doc_id % 2 as bigint) as version, count(*) as n from documents group by 1",
}
