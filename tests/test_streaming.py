from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from promptsieve.operators import adapt as A
from promptsieve.streaming import feedback as SF


def stream_of(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def at(hour):
    return datetime(2024, 3, 1, tzinfo=timezone.utc) + timedelta(hours=hour)


def test_labels_join_within_their_time(spark, tmp_path):
    predictions = stream_of(spark, str(tmp_path / "p"), [(i, at(i), 0.1 * i) for i in range(6)], "prompt_id long, ts timestamp, score double")
    labels = stream_of(spark, str(tmp_path / "y"), [(0, at(1), 1), (1, at(0), 1), (2, at(20), 0), (3, at(40), 1), (9, at(9), 1), (5, at(5), 0)],
                       "prompt_id long, label_ts timestamp, label int")
    joined = SF.run_to_end(SF.join_labels(predictions, labels), str(tmp_path / "out"))
    # The label of 1 came before its prediction and that of 3 more than a day later.
    assert sorted((r.prompt_id, r.label) for r in joined.collect()) == [(0, 1), (2, 0), (5, 0)]


def test_daily_limit_and_cooldown(spark, tmp_path):
    rows = [(7, at(h), 1, 0) for h in range(0, 72)] + [(7, at(200), 1, 1)]
    feedback = stream_of(spark, str(tmp_path / "f"), rows, "stream_id long, ts timestamp, pred int, label int")
    folder = str(tmp_path / "w")
    SF.run_to_end(SF.closed_windows(feedback, seconds=3600), folder)
    windows = spark.readStream.schema(SF.WINDOWS).parquet(folder)
    adapted = SF.run_to_end(SF.adapt_stream(windows, seconds=3600, cooldown=3600, per_day=5), str(tmp_path / "a"))
    days = adapted.groupBy(F.floor((F.col("win") + 1) / 24).alias("day")).agg(F.sum("updated").alias("n"), F.count("*").alias("windows")).collect()
    assert {r.n for r in days} <= {1, 5} and max(r.n for r in days) == 5 and sum(r.windows for r in days) == 72


def test_windows_do_not_depend_on_the_session_zone(spark, tmp_path):
    rows = [(1, at(h), h % 2, 1) for h in range(60)] + [(1, at(400), 1, 1)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    schema = "stream_id long, ts timestamp, pred int, label int"
    try:
        found = []
        for i, name in enumerate(("UTC", "Asia/Tokyo")):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            feedback = stream_of(spark, str(tmp_path / f"z{i}"), rows, schema)
            spark.conf.set("spark.sql.session.timeZone", name)
            streamed = SF.run_to_end(SF.closed_windows(feedback), str(tmp_path / f"o{i}"))
            batch = A.feedback_windows(spark.read.parquet(str(tmp_path / f"z{i}")))
            found.append(sorted((r.win, r.tp, r.fn) for r in streamed.collect()))
            last = max(r.win for r in batch.collect())
            assert found[-1] == sorted((r.win, r.tp, r.fn) for r in batch.collect() if r.win < last)
        assert found[0] == found[1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
