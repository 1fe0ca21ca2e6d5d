"""Online adaptation as batch folds over tumbling event-time windows.

The unit of update is one window of one feedback stream.  Events are aggregated to
windows first (map-side), so a stream holding a third of all events contributes one
row per window like any other.  The order-dependent state is then folded in blocks of
at most BLOCK windows: averages decay linearly and clamped steps compose to clamped
steps, so each block reduces to a few numbers, and only those numbers are folded along
the stream.  No task ever holds more than a block, or one summary per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from promptsieve.functions import metrics as M
from promptsieve.functions import text as X

BLOCK = 128
DAY = 86_400
COMPONENTS = ("pattern", "similarity", "model")
KEYS = ("stream_id", "win")


def instant(frame: DataFrame, column: str = "ts") -> Column:
    """The column as an instant; a wall-clock time without zone is taken as UTC, whatever the session's zone."""
    if dict(frame.dtypes)[column] == "timestamp_ntz":
        return F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())
    return F.col(column).cast("timestamp")


def window_index(frame: DataFrame, seconds: int, column: str = "ts") -> Column:
    """Number of the tumbling window since the epoch, independent of the session time zone."""
    return F.floor(F.unix_timestamp(instant(frame, column)) / F.lit(seconds)).cast("bigint")


def with_rates(cells: DataFrame, published: bool = False) -> DataFrame:
    """Adds n, fp_rate, fn_rate, accuracy and the three component accuracies.

    The published third component is the share of positive predictions; the default is
    the accuracy.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    accuracy = M.ratio(tp + tn, n)
    rated = cells.select(
        "*", n.alias("n"), M.ratio(fp, fp + tn).alias("fp_rate"), M.ratio(fn, fn + tp).alias("fn_rate"),
        accuracy.alias("accuracy"), (M.ratio(tp + fp, n) if published else accuracy).alias("component_3"),
    )
    return rated.withColumn("component_1", 1.0 - F.col("fp_rate")).withColumn("component_2", 1.0 - F.col("fn_rate"))


def feedback_windows(feedback: DataFrame, seconds: int = DAY, published: bool = False) -> DataFrame:
    """Confusion counts and rates per (stream_id, win)."""
    p, y = F.col("pred"), F.col("label")
    cells = feedback.groupBy("stream_id", window_index(feedback, seconds).alias("win")).agg(
        F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 1)).alias("fn"), F.count_if((p == 0) & (y == 0)).alias("tn"),
    )
    return with_rates(cells, published)


def _along(blocks: DataFrame, start: Column, step, names: Sequence[str]) -> DataFrame:
    """(stream_id, block, state before the block), folding block summaries in order.

    ``step(state, summary)`` gives the next state; one summary per block and stream.
    """
    summaries = blocks.groupBy("stream_id").agg(F.sort_array(F.collect_list("summary")).alias("all"))
    folded = summaries.select("stream_id", F.aggregate(
        "all",
        F.struct(start.alias("now"), F.array(start).alias("seen")),
        lambda acc, s: F.struct(
            step(acc["now"], s).alias("now"), F.concat(acc["seen"], F.array(step(acc["now"], s))).alias("seen")
        ),
        lambda acc: acc["seen"],
    ).alias("seen"), F.col("all.block").alias("blocks"))
    return folded.select(
        "stream_id", F.explode(F.arrays_zip("blocks", F.slice("seen", 1, F.size("blocks")).alias("state"))).alias("x")
    ).select(
        "stream_id", F.col("x.blocks").alias("block"), *[F.col(f"x.state.{n}").alias(f"in_{n}") for n in names]
    )


def adaptive_path(
    windows: DataFrame, threshold: float = 0.55, alpha: float = 0.001, target_fp: float = 0.05,
    low: float = 0.30, high: float = 0.80, accuracy: float = 0.85, weight_alpha: float = 0.05,
    clip: tuple[float, float] | None = None, direction: int = -1, max_change: float | None = None,
    min_samples: int = 0, block: int = BLOCK,
) -> DataFrame:
    """Threshold and blend weights after every window of every stream.

    fp_ema <- alpha * fp + (1 - alpha) * fp_ema, threshold moves by
    direction * alpha * (fp_ema - target) and is clamped; the component accuracies decay
    with ``weight_alpha`` and their softmax is the weights.  ``direction=-1`` is as
    published: many false positives lower the threshold.  ``max_change`` bounds one step
    and ``min_samples`` skips thin windows; both are off by default.
    """
    emas = ("f", "a1", "a2", "a3")
    rate = {"f": alpha, "a1": weight_alpha, "a2": weight_alpha, "a3": weight_alpha}
    source = {"f": "fp_rate", "a1": "component_1", "a2": "component_2", "a3": "component_3"}
    start = {"f": 0.05, "a1": accuracy, "a2": accuracy, "a3": accuracy}

    def decay(state: Column, s: Column) -> list[Column]:
        return [(rate[e] * s[e] + (1.0 - rate[e]) * state[e]).alias(e) for e in emas]

    blocks = windows.where(F.col("n") >= min_samples).groupBy(
        "stream_id", F.floor(F.col("win") / block).alias("block")
    ).agg(F.sort_array(F.collect_list(F.struct("win", *[F.col(source[e]).alias(e) for e in emas]))).alias("steps"))

    # What a block adds to each average when started from zero.
    zero = F.struct(*[F.lit(0.0).alias(e) for e in emas])
    local = F.aggregate("steps", zero, lambda state, s: F.struct(*decay(state, s)))
    summarised = blocks.withColumn("summary", F.struct(F.col("block"), F.size("steps").alias("m"), local.alias("local")))
    carried = _along(
        summarised, F.struct(*[F.lit(start[e]).alias(e) for e in emas]),
        lambda state, s: F.struct(*[
            (F.pow(F.lit(1.0 - rate[e]), s["m"]) * state[e] + s["local"][e]).alias(e) for e in emas
        ]), emas,
    )

    def bounded(x: Column) -> Column:
        return F.least(F.lit(high), F.greatest(F.lit(low), x))

    def advance(state: Column, s: Column) -> Column:
        averages = decay(state, s)
        move = direction * alpha * (averages[0] - target_fp)
        if max_change is not None:
            move = F.least(F.lit(max_change), F.greatest(F.lit(-max_change), move))
        return F.struct(
            s["win"].alias("win"), *averages, (state["shift"] + move).alias("shift"),
            bounded(state["lo"] + move).alias("lo"), bounded(state["hi"] + move).alias("hi"),
        )

    # x -> min(hi, max(lo, x + shift)) is the effect of all steps of the block so far.
    opened = F.struct(
        F.lit(None).cast("bigint").alias("win"), *[F.col(f"in_{e}").alias(e) for e in emas],
        F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"),
    )
    empty = F.array().cast("array<struct<win:bigint,f:double,a1:double,a2:double,a3:double,shift:double,lo:double,hi:double>>")
    walked = blocks.join(carried, ["stream_id", "block"]).select("stream_id", "block", F.aggregate(
        "steps", F.struct(opened.alias("now"), empty.alias("seen")),
        lambda acc, s: F.struct(
            advance(acc["now"], s).alias("now"), F.concat(acc["seen"], F.array(advance(acc["now"], s))).alias("seen")
        ),
        lambda acc: acc["seen"],
    ).alias("states"))
    effect = lambda x, s: F.least(s["hi"], F.greatest(s["lo"], x + s["shift"]))
    ended = walked.withColumn("summary", F.struct(
        F.col("block"), *[F.element_at("states", -1)[n].alias(n) for n in ("shift", "lo", "hi")]
    ))
    thresholds = _along(
        ended, F.struct(F.lit(float(threshold)).alias("t")),
        lambda state, s: F.struct(effect(state["t"], s).alias("t")), ("t",),
    )
    path = walked.join(thresholds, ["stream_id", "block"]).select(
        "stream_id", "in_t", F.explode("states").alias("s")
    ).select(
        "stream_id", F.col("s.win").alias("win"), F.col("s.f").alias("fp_ema"),
        effect(F.col("in_t"), F.col("s")).alias("threshold"),
        *[F.col(f"s.a{i}").alias(f"accuracy_{i}") for i in (1, 2, 3)],
    )
    top = F.greatest("accuracy_1", "accuracy_2", "accuracy_3")
    powers = [F.exp(F.col(f"accuracy_{i}") - top) for i in (1, 2, 3)]
    weights = [p / (powers[0] + powers[1] + powers[2]) for p in powers]
    if clip is not None:
        weights = [F.least(F.lit(clip[1]), F.greatest(F.lit(clip[0]), w)) for w in weights]
    return path.select("*", *[w.alias(f"weight_{i}") for i, w in enumerate(weights, 1)])


def recent_scores(feedback: DataFrame, seconds: int = DAY, last: int = 200) -> DataFrame:
    """(stream_id, win, score) of the ``last`` scores up to the end of each window.

    Each window keeps at most ``last`` of its own rows, cut before the shuffle.  A row
    then goes only to the following windows that still need it: at most ``last`` rows
    arrive at any window, whatever the size of the stream.
    """
    keyed = feedback.select("stream_id", window_index(feedback, seconds).alias("win"), "ts", "event_id", "score")
    newest = keyed.withColumn("r", F.row_number().over(
        W.partitionBy(*KEYS).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    )).where(F.col("r") <= last).drop("ts", "event_id")
    counts = keyed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    in_order = W.partitionBy("stream_id").orderBy("win")
    running = counts.withColumn("upto", F.sum("n").over(in_order))
    # Later windows are non-empty, so at most ``last`` of them can still need a row.
    ahead = F.collect_list(F.struct("win", "upto")).over(in_order.rowsBetween(0, last - 1))
    listed = running.withColumn("_ahead", ahead)
    needs = listed.select("stream_id", F.col("win").alias("source"), "upto", F.explode("_ahead").alias("w")).select(
        "stream_id", "source", F.col("w.win").alias("win"), (F.lit(last) - (F.col("w.upto") - F.col("upto"))).alias("room"),
    ).where(F.col("room") > 0)
    return needs.join(newest.withColumnRenamed("win", "source"), ["stream_id", "source"]).where(
        F.col("r") <= F.col("room")
    ).select(*KEYS, "score")


def drift(
    feedback: DataFrame, seconds: int = DAY, last: int = 200, limit: float = 0.15,
    baseline_mean: float = 0.5, baseline_std: float = 0.2, recalibrate_after: int = 3,
) -> DataFrame:
    """Drift status per window: 0 none, 1 shifted, 2 strongly shifted mean.

    Fewer than ``last`` scores give 0.  Every third drifting window triggers
    recalibration and resets the count.
    """
    recent = recent_scores(feedback, seconds, last).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_recent"), F.avg("score").alias("recent_mean"), F.stddev_pop("score").alias("recent_std")
    )
    mean_shift = F.abs(F.col("recent_mean") - baseline_mean)
    std_shift = F.abs(F.col("recent_std") - baseline_std)
    status = (
        F.when(F.col("n_recent") < last, 0)
        .when((mean_shift > limit) | (std_shift > limit * 0.5), F.when(mean_shift > limit * 2, 2).otherwise(1))
        .otherwise(0)
    )
    judged = recent.withColumn("drift_status", status)
    drifting = (F.col("drift_status") > 0).cast("bigint")
    so_far = F.sum(drifting).over(W.partitionBy("stream_id").orderBy("win"))
    return judged.withColumn("_d", so_far).select(
        *KEYS, "n_recent", "recent_mean", "recent_std", "drift_status",
        (F.col("_d") % recalibrate_after).alias("drift_count"),
        ((F.col("drift_status") > 0) & (F.col("_d") % recalibrate_after == 0)).cast("int").alias("recalibrate"),
    )


def stability(windows: DataFrame, last: int = 10, limit: float = 0.05) -> DataFrame:
    """Adds ``stable``: fewer than ``last`` accuracies, or their deviation below the limit."""
    frame = W.partitionBy("stream_id").orderBy("win").rowsBetween(-(last - 1), 0)
    return windows.select(
        *KEYS, "accuracy", F.stddev_pop("accuracy").over(frame).alias("accuracy_std"),
        F.count(F.lit(1)).over(frame).alias("n_recent"),
    ).withColumn("stable", ((F.col("n_recent") < last) | (F.col("accuracy_std") < limit)).cast("int"))


def error_states(windows: DataFrame, baseline_error: float = 0.0, last: int = 100, warm_up: int = 10) -> DataFrame:
    """NORMAL, DRIFT_WARN, ROLLBACK or EMERGENCY from the last errors of each stream."""
    ordered = W.partitionBy("stream_id").orderBy("win")
    frame = ordered.rowsBetween(-(last - 1), 0)
    error = 1.0 - F.col("accuracy")
    return windows.select(
        *KEYS, F.avg(error).over(frame).alias("mean_error"), F.stddev_pop(error).over(frame).alias("error_std"),
        F.row_number().over(ordered).alias("_seen"),
    ).select(*KEYS, "mean_error", "error_std", (
        F.when(F.col("_seen") < warm_up, "NORMAL")
        .when(F.col("mean_error") > baseline_error + 0.10, "ROLLBACK")
        .when(F.col("mean_error") > 0.30, "EMERGENCY")
        .when(F.col("error_std") > 0.15, "DRIFT_WARN")
        .otherwise("NORMAL")
    ).alias("state"))


def feedback_buffer(feedback: DataFrame, size: int = 5000, minimum: int = 100) -> DataFrame:
    """The newest ``size`` events of each stream that has at least ``minimum`` of them.

    Events are counted per hour first, which is summed map-side; hours that newer ones already
    fill are dropped before any event is ranked, so a hot stream is never sorted whole,
    whatever the size.
    """
    hour = F.unix_timestamp(F.col("ts").cast("timestamp")) / F.lit(3600)
    placed = feedback.withColumn("_hour", F.floor(hour).cast("bigint"))
    newer = W.partitionBy("stream_id").orderBy(F.col("_hour").desc()).rowsBetween(W.unboundedPreceding, -1)
    hours = placed.groupBy("stream_id", "_hour").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0))).where(F.col("_newer") < size).select("stream_id", "_hour")
    needed = placed.join(hours, ["stream_id", "_hour"], "left_semi").drop("_hour")
    newest = needed.withColumn("_r", F.row_number().over(
        W.partitionBy("stream_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    )).where(F.col("_r") <= size)
    held = newest.groupBy("stream_id").agg(F.count(F.lit(1)).alias("buffered")).where(F.col("buffered") >= minimum)
    return newest.drop("_r").join(held, "stream_id")


def mine_patterns(judged: DataFrame, known: Sequence[str] = (), per_kind: int | None = None, most: int | None = None, score: float = 0.7, seed: int = 42) -> DataFrame:
    """(prompt_id, position, pattern, score): new word patterns from missed and false alarms.

    Three-word patterns from missed attacks, then four-word patterns from false alarms at a lower
    score; from all of them, or from ``per_kind`` of each and ``most`` in all (published: 50 and 200).
    """
    from promptsieve.functions.hashing import unit_hash

    order = unit_hash(F.col("prompt_id"), seed)
    escape = lambda w: F.regexp_replace(w, r"([()\[\]{}?*+\-|^$\\.&~#])", r"\\$1")
    parts = []
    for kind, (pred, label, n, value) in enumerate(((0, 1, 3, score), (1, 0, 4, score - 0.1))):
        wrong = judged.where((F.col("pred") == pred) & (F.col("is_malicious") == label))
        chosen = wrong.select("prompt_id", "prompt_text", order.alias("h"))
        if per_kind is not None:
            chosen = chosen.orderBy("h", "prompt_id").limit(per_kind)
        tokens = chosen.select("prompt_id", "h", X.words(F.col("prompt_text")).alias("w"))
        escaped = tokens.select("prompt_id", "h", F.transform("w", escape).alias("w"))
        grams = F.transform(X.word_ngrams(F.col("w"), n), lambda g: F.replace(g, F.lit(" "), F.lit(r"\s+")))
        parts.append(escaped.select(F.lit(kind).alias("kind"), "h", "prompt_id", F.posexplode(grams).alias("position", "pattern"), F.lit(value).alias("score")))
    mined = parts[0].unionByName(parts[1])
    if known:
        mined = mined.where(~F.col("pattern").isin(list(known)))
    if most is not None:
        mined = mined.orderBy("kind", "h", "prompt_id", "position").limit(most)
    return mined.select("prompt_id", "position", "pattern", "score")
