from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from pyspark.sql import functions as F

from promptsieve.operators import adapt as A
from promptsieve.operators import learn as LN
from promptsieve.streaming import drift as DR
from promptsieve.streaming import feedback as SF
from promptsieve.streaming import loop as OL

SCORED = "stream_id long, ts timestamp, event_id long, score double"
EVENTS = "stream_id long, event_id long, ts timestamp, score double, pred int, label int"
SECONDS = 3600


def at(hour):
    return datetime(2024, 3, 1, tzinfo=timezone.utc) + timedelta(hours=hour)


def rows_of(frame, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.select(*columns).collect())


def scores(count, seed):
    """A hot and a thin stream whose scores move away and back."""
    rng = np.random.default_rng(seed)
    return [(0 if i % 10 else 1, at(48 * i / count), i, float(np.clip(rng.normal(0.5 + 0.4 * (i % count > count // 2), 0.2), 0, 1)))
            for i in range(count)]


def test_drift_over_many_micro_batches_and_restarts_equals_the_batch(spark, tmp_path):
    rows, folder, target = scores(1200, 1), str(tmp_path / "in"), str(tmp_path / "out")
    feed = spark.readStream.schema(SCORED).option("maxFilesPerTrigger", 1).parquet(SF.make_folder(spark, folder))
    options = {"last": 50, "baseline_std": 0.2}
    judged = DR.drift_stream(feed, SECONDS, beats=SF.heartbeats(spark, f"{target}/beats"), **options)
    seen = []
    for part in (rows[:500], rows[500:700], rows[700:]):  # a query each, from the same checkpoint
        spark.createDataFrame(part, SCORED).repartition(2).write.mode("append").parquet(folder)
        SF.finish(spark, lambda: DR.start_drift(judged, target, on_trigger=lambda t: seen.append(t.count())), f"{target}/beats", SECONDS) \
            if part[-1] == rows[-1] else DR.start_drift(judged, target, on_trigger=lambda t: seen.append(t.count())).awaitTermination()
    want = A.drift(spark.createDataFrame(rows, SCORED), SECONDS, **options)
    columns = ("stream_id", "win", "n_recent", "recent_mean", "recent_std", "drift_status", "drift_count", "recalibrate")
    assert rows_of(DR.stored(spark, f"{target}/judged", DR.JUDGED), *columns) == rows_of(want, *columns)
    triggers = rows_of(DR.stored(spark, f"{target}/triggers", DR.TRIGGERS), "stream_id", "win")
    assert triggers == rows_of(want.where("recalibrate = 1"), "stream_id", "win") and len(triggers) > 3
    assert sum(seen) == len(triggers)


def test_windows_hold_no_more_than_the_newest_scores(spark, tmp_path):
    rows = [(5, at(0) + timedelta(seconds=i % 3000), i, i / 4000) for i in range(4000)] + [(5, at(9), 9000, 0.1), (6, at(1), 9001, None)]
    spark.createDataFrame(rows, SCORED).write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(SCORED).parquet(str(tmp_path / "in"))
    judged, _ = DR.replay_drift(feed, str(tmp_path / "out"), SECONDS, last=20)
    want = A.drift(spark.createDataFrame(rows[:-1], SCORED), SECONDS, last=20)
    assert rows_of(judged, "win", "n_recent", "recent_mean") == rows_of(want, "win", "n_recent", "recent_mean")


def test_an_idle_stream_is_forgotten(spark, tmp_path):
    rows = [(1, at(h), h, 0.9) for h in (0, 1, 2, 40, 41)] + [(2, at(h), h + 100, 0.5) for h in range(42)]
    spark.createDataFrame(rows[:3] + rows[5:8], SCORED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(SCORED).parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")
    judged = DR.drift_stream(feed, SECONDS, last=2, beats=SF.heartbeats(spark, f"{target}/beats"), forget_after=10 * SECONDS)
    DR.start_drift(judged, target).awaitTermination()
    for part in (rows[8:40], rows[3:5] + rows[40:]):
        spark.createDataFrame(part, SCORED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        DR.start_drift(judged, target).awaitTermination()
    SF.finish(spark, lambda: DR.start_drift(judged, target), f"{target}/beats", SECONDS)
    found = {r.win: r.n_recent for r in DR.stored(spark, f"{target}/judged", DR.JUDGED).where("stream_id = 1").collect()}
    assert [found[w] for w in sorted(found)] == [1, 2, 2, 1, 2]


def test_late_feedback_is_counted(spark, tmp_path):
    schema = "stream_id long, ts timestamp, pred int, label int"
    folder = str(tmp_path / "in")
    on_time = [(i % 3, at(h), 1, h % 2) for i, h in enumerate(range(30))]
    parts = [on_time[:20], on_time[20:], [(0, at(29.5), 1, 1)], [(0, at(1), 1, 1), (1, at(2), 0, 1), (2, at(3), 0, 0), (0, at(29.6), 0, 0)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    counter, listener = SF.LateCounter(), SF.LateCounter()
    spark.streams.addListener(listener)
    try:
        windows = SF.closed_to_end(feed, str(tmp_path / "out"), SECONDS, counter=counter)
        assert windows.agg(F.sum("n")).first()[0] == 32
        assert (counter.fed, counter.closed, counter.late) == (35, 32, 3)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        assert listener.late == 3
    finally:
        spark.streams.removeListener(listener)


def test_every_window_of_a_bounded_feed_appears_once(spark, tmp_path):
    schema = "stream_id long, ts timestamp, pred int, label int"
    rows = [(i % 4, at(i * 0.7), i % 2, i % 3 % 2) for i in range(100)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    columns = ("stream_id", "win", "tp", "fp", "fn", "tn")
    found = SF.closed_to_end(feed, str(tmp_path / "out"), SECONDS)
    assert rows_of(found, *columns) == rows_of(A.feedback_windows(spark.createDataFrame(rows, schema), SECONDS), *columns)


WINDOW = "stream_id long, win long, fp_rate double, accuracy double, component_1 double, component_2 double, component_3 double"


@pytest.mark.parametrize("files", [1, 6])
def test_rollback_restores_threshold_and_weights(spark, tmp_path, files):
    good = lambda w, fp: (3, w, fp, 0.9, 1 - fp, 0.8 - 0.01 * w, 0.9)
    bad = lambda w: (3, w, 0.9, 0.2, 0.1, 0.1, 0.2)
    rows = [good(0, 0.3), good(1, 0.5), good(2, 0.1), bad(3), bad(4), good(5, 0.2)]
    schema, target = SF.WINDOWS, str(tmp_path / "in")
    full = [(s, w, 0, 0, 0, 0, 10, fp, 0.0, acc, c3, c1, c2) for s, w, fp, acc, c1, c2, c3 in rows]
    for part in np.array_split(np.arange(6), files):
        spark.createDataFrame([full[i] for i in part], schema).coalesce(1).write.mode("append").parquet(target)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(target)
    path = {r.win: r for r in SF.run_to_end(SF.adapt_stream(feed, alpha=0.5, rollback_error=0.5), str(tmp_path / "out")).collect()}
    values = lambda w: [path[w][c] for c in ("fp_ema", "threshold", "weight_1", "weight_2", "weight_3")]
    assert values(3) == values(1) != values(2)  # the first burst takes back window 2's update
    assert values(4) == values(0) != values(1)  # and the second that of window 1
    assert [(path[w].updated, path[w].restored) for w in range(6)] == [(1, 0), (1, 0), (1, 0), (0, 1), (0, 1), (1, 0)]
    assert values(5) != values(4)
    # Without bursts in between window 5 would go on from window 0.
    spark.createDataFrame([full[0], full[5]], schema).coalesce(1).write.parquet(str(tmp_path / "two"))
    two = SF.run_to_end(SF.adapt_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "two")), alpha=0.5), str(tmp_path / "o2"))
    assert [r.threshold for r in two.where("win = 5").collect()] == [path[5].threshold]


def events(count, start, rng):
    label = rng.integers(0, 2, count)
    score = np.clip(rng.normal(0.3 + 0.3 * label, 0.2), 0, 1)
    return [(i % 2, start + i, at((start + i) / 100), float(score[i]), int(score[i] > 0.55), int(label[i])) for i in range(count)]


def test_a_replayed_micro_batch_leaves_the_buffer_unchanged(spark, tmp_path):
    folder = str(tmp_path)
    rows = [*events(300, 0, np.random.default_rng(1)), (0, 999, at(50), None, 1, 1), (1, 998, at(50), 0.4, 0, None)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/in")
    feed = spark.readStream.schema(EVENTS).parquet(f"{folder}/in")
    found = []
    for run in range(2):
        query = OL.start_buffer(feed, folder, size=100)
        query.awaitTermination()
        found.append(rows_of(DR.stored(spark, f"{folder}/buffer", OL.EVENTS), "batch", "event_id"))
        # As after a failure between writing and committing: the micro-batch is not recorded as done.
        commit = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/buffer.checkpoint/commits/0")
        if run == 0:
            assert commit.getFileSystem(spark._jsc.hadoopConfiguration()).delete(commit, False)
    assert found[0] == found[1] and len(found[0]) == 200
    want = A.feedback_buffer(spark.createDataFrame(rows[:300], EVENTS), size=100, minimum=1)
    assert rows_of(OL.buffered(spark, folder, size=100), "stream_id", "event_id", "buffered") == rows_of(want, "stream_id", "event_id", "buffered")


def test_two_rounds_of_retraining_change_a_running_query(spark, tmp_path):
    folder, rng = str(tmp_path), np.random.default_rng(2)
    fed, asked = SF.make_folder(spark, f"{folder}/fed"), SF.make_folder(spark, f"{folder}/asked")
    buffering = OL.start_buffer(spark.readStream.schema(EVENTS).parquet(fed), folder, processingTime="100 milliseconds")
    scoring = OL.start_scoring(spark.readStream.schema("prompt_id long, score double").parquet(asked), folder, processingTime="100 milliseconds")
    rounds = [events(400, 0, rng), events(300, 1000, rng)]
    made = []
    try:
        for k in range(3):
            spark.createDataFrame([(10 * k + i, i / 10) for i in range(10)], "prompt_id long, score double").coalesce(1).write.mode("append").parquet(asked)
            scoring.processAllAvailable()
            if k < 2:
                spark.createDataFrame(rounds[k], EVENTS).coalesce(1).write.mode("append").parquet(fed)
                buffering.processAllAvailable()
                made.append(OL.retrain(spark, folder))
                assert OL.retrain(spark, folder) is None  # the buffer is cleared
    finally:
        buffering.stop()
        scoring.stop()
    assert [m.state["n"] for m in made] == [400, 300] and [m.state["version"] for m in made] == [1, 2]
    by_version = {}
    for r in OL.scored(spark, folder).orderBy("prompt_id").collect():
        by_version.setdefault(r.version, []).append((r.score, r.calibrated, r.pred))
    assert sorted(by_version) == [0, 1, 2]
    assert all(s == c and p == (s >= 0.55) for s, c, p in by_version[0])
    for k in (0, 1):
        # The published version is what the library fits on that round's events alone.
        _, state = LN.retrain_on_feedback(spark.createDataFrame(rounds[k], EVENTS), *((0.55, 0.05) if k == 0 else (made[0].state["threshold"], made[0].state["fp_ema"])), 200)
        assert state["threshold"] == pytest.approx(made[k].state["threshold"]) and state["baseline_mean"] == pytest.approx(made[k].state["baseline_mean"])
        calibrated = [c for _, c, _ in by_version[k + 1]]
        assert calibrated == sorted(calibrated) and calibrated != [s for s, _, _ in by_version[k + 1]]
    assert by_version[1] != by_version[2]
    states = OL.Versions(spark, folder).states().collect()
    assert [s.upto_batch for s in states] == sorted({s.upto_batch for s in states})


def test_only_one_of_two_retrainers_publishes(spark, tmp_path):
    rows = spark.createDataFrame(events(300, 0, np.random.default_rng(3)), EVENTS)
    calibrator, state = LN.retrain_on_feedback(rows, 0.55)
    state |= {"version": 1, "n": 300, "upto_batch": 0}
    versions = OL.Versions(spark, str(tmp_path))
    assert versions.newest().state["version"] == 0 and versions.states().count() == 0
    assert versions.publish(calibrator, state) and not versions.publish(calibrator, state | {"threshold": 0.1})
    newest = versions.newest()
    assert newest.state["threshold"] == state["threshold"] and versions.numbers() == [1]
    probe = spark.createDataFrame([(i, i / 20) for i in range(20)], "prompt_id long, score double")
    assert rows_of(newest.transform(probe), "prompt_id", "calibrated") == rows_of(calibrator.transform(probe), "prompt_id", "calibrated")


def test_too_few_or_one_sided_events_make_no_version(spark, tmp_path):
    folder = str(tmp_path)
    assert OL.retrain(spark, folder) is None
    spark.createDataFrame([(0, i, at(i), 0.5, 1, 1) for i in range(250)], EVENTS).coalesce(1).write.parquet(f"{folder}/in")
    OL.start_buffer(spark.readStream.schema(EVENTS).parquet(f"{folder}/in"), folder).awaitTermination()
    assert OL.retrain(spark, folder) is None and OL.retrain(spark, folder, minimum=1000) is None
    assert OL.Versions(spark, folder).numbers() == []
