"""Feedback windows, adaptive state, drift and stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.data_checks import detect_sql, hashed, prompts
from checks.signal_checks import rounded
from checks.sql import FEEDBACK, LABELS, SEEDED, words
from promptsieve import lexicon as L
from promptsieve.operators import adapt as A
from promptsieve.operators import patterns as P
from promptsieve.sources import tables as T

LAST = 200


def feedback(spark, sf):
    return T.feedback(spark, sf)


def busy(spark, sf):
    """Two streams with half the events each: enough for the published 200 scores and 100 events."""
    return feedback(spark, sf).withColumn("stream_id", F.col("stream_id") % 2)


def windows(spark, sf):
    return A.feedback_windows(feedback(spark, sf))


# Averages of simple fractions often end in an exact 5; a nudge keeps such ties apart
# from the last bit of the arithmetic.
NUDGE = 1e-12


def path(spark, sf, *names, **options):
    folded = A.adaptive_path(windows(spark, sf), **options)
    return rounded(folded.select("stream_id", "win", *[(F.col(n) + NUDGE).alias(n) for n in names]), 9)


QUERIES = {
    "feedback_windows": lambda s, sf: rounded(windows(s, sf).select("stream_id", "win", "tp", "fp", "fn", "tn", "fp_rate", "fn_rate")),
    "component_accuracy": lambda s, sf: rounded(windows(s, sf).select("stream_id", "win", "component_1", "component_2", "component_3")),
    "component_accuracy_published": lambda s, sf: rounded(
        A.feedback_windows(feedback(s, sf), published=True).select("stream_id", "win", "component_1", "component_2", "component_3")),
    # Small blocks here, so that the carry from block to block is exercised.
    "adaptive_threshold": lambda s, sf: path(s, sf, "fp_ema", "threshold", block=8),
    "adaptive_threshold_clamped": lambda s, sf: path(s, sf, "fp_ema", "threshold", block=8, alpha=0.5),
    "adaptive_weights": lambda s, sf: path(s, sf, "accuracy_1", "accuracy_2", "accuracy_3", "weight_1", "weight_2", "weight_3", block=8),
    "drift_check": lambda s, sf: rounded(A.drift(busy(s, sf), last=LAST)),
    "stability_check": lambda s, sf: rounded(A.stability(windows(s, sf)).drop("n_recent")),
    "error_states": lambda s, sf: rounded(A.error_states(windows(s, sf), baseline_error=0.5)),
    "feedback_buffer": lambda s, sf: A.feedback_buffer(busy(s, sf), size=5000, minimum=100).select("stream_id", "event_id", "buffered"),
    "mined_patterns": lambda s, sf: rounded(A.mine_patterns(P.flag_by_gate(prompts(s, sf)), list(L.PATTERN_SCORES), per_kind=50, most=200)),
}

_W = f"""{FEEDBACK},
c as (select stream_id, cast(floor(epoch(ts) / 86400) as bigint) as win, count(case when pred = 1 and label = 1 then 1 end) as tp,
  count(case when pred = 1 and label = 0 then 1 end) as fp, count(case when pred = 0 and label = 1 then 1 end) as fn,
  count(case when pred = 0 and label = 0 then 1 end) as tn from feedback group by 1, 2),
w as (select *, fp / cast(greatest(fp + tn, 1) as double) as fp_rate, fn / cast(greatest(fn + tp, 1) as double) as fn_rate,
  (tp + tn) / cast(tp + fp + fn + tn as double) as accuracy, (tp + fp) / cast(tp + fp + fn + tn as double) as said,
  row_number() over (partition by stream_id order by win) as rn from c)"""


def fold_sql(alpha: float) -> str:
    a = f"cast({alpha} as double)"
    ema = f"({a} * w.fp_rate + (1 - {a}) * p.fp_ema)"
    step = lambda i, v: f"cast(0.05 as double) * {v} + cast(0.95 as double) * p.a{i}"
    return f"""with recursive {_W},
p as (select stream_id, cast(0 as bigint) as rn, cast(null as bigint) as win, cast(0.05 as double) as fp_ema, cast(0.55 as double) as threshold,
    cast(0.85 as double) as a1, cast(0.85 as double) as a2, cast(0.85 as double) as a3 from (select distinct stream_id from w)
  union all select w.stream_id, w.rn, w.win, {ema}, least(cast(0.8 as double), greatest(cast(0.3 as double), p.threshold - {a} * ({ema} - cast(0.05 as double)))),
    {step(1, '(1 - w.fp_rate)')}, {step(2, '(1 - w.fn_rate)')}, {step(3, 'w.accuracy')}
  from p join w on w.stream_id = p.stream_id and w.rn = p.rn + 1)"""


_EXP = "(exp(a1 - greatest(a1, a2, a3)) + exp(a2 - greatest(a1, a2, a3)) + exp(a3 - greatest(a1, a2, a3)))"
BUSY = FEEDBACK.replace("user_id as stream_id", "user_id % 2 as stream_id")
_DRIFT = f"""{BUSY},
e as (select stream_id, cast(floor(epoch(ts) / 86400) as bigint) as win, score, row_number() over (partition by stream_id order by ts, event_id) as rn from feedback),
we as (select stream_id, win, max(rn) as upto from e group by 1, 2),
rc as (select we.stream_id, we.win, count(*) as n_recent, avg(score) as m, stddev_pop(score) as s from we join e on e.stream_id = we.stream_id and e.rn <= we.upto and e.rn > we.upto - {LAST} group by 1, 2),
st as (select *, case when n_recent < {LAST} then 0 when abs(m - 0.5) > cast(0.15 as double) or abs(s - 0.2) > cast(0.075 as double) then case when abs(m - 0.5) > cast(0.3 as double) then 2 else 1 end else 0 end as drift_status from rc),
cu as (select *, cast(sum(case when drift_status > 0 then 1 else 0 end) over (partition by stream_id order by win) as bigint) as d from st)"""


def mined_sql() -> str:
    escaped = r"list_transform({w}, lambda x: regexp_replace(x, '([()\[\]{{}}?*+\-|^$\\.&~#])', '\\\1', 'g'))".format(w=words("prompt_text"))
    join = lambda n: " || '\\s+' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    part = lambda kind, cond, n, score: f"""(select {kind} as kind, h, prompt_id, cast(i - 1 as integer) as position, {join(n)} as pattern, cast({score} as double) as score
  from (select h, prompt_id, w, unnest(range(1, len(w) - {n - 2})) as i from
    (select prompt_id, {hashed('prompt_id')} as h, {escaped} as w from j where {cond} order by h, prompt_id limit 50)))"""
    return f"""with {SEEDED}, {LABELS}, j as (select s.prompt_id, prompt_text, is_malicious, {detect_sql('prompt_text')} as pred from seeded s join labelled using (prompt_id)),
m as ({part(0, 'pred = 0 and is_malicious = 1', 3, 0.7)} union all {part(1, 'pred = 1 and is_malicious = 0', 4, 0.6)}),
t as (select * from m order by kind, h, prompt_id, position limit 200)
select prompt_id, position, pattern, round(score, 6) as score from t"""


ORACLES = {
    "feedback_windows": f"with {_W} select stream_id, win, tp, fp, fn, tn, round(fp_rate, 6) as fp_rate, round(fn_rate, 6) as fn_rate from w",
    "component_accuracy": f"with {_W} select stream_id, win, round(1 - fp_rate, 6) as component_1, round(1 - fn_rate, 6) as component_2, round(accuracy, 6) as component_3 from w",
    "component_accuracy_published": f"with {_W} select stream_id, win, round(1 - fp_rate, 6) as component_1, round(1 - fn_rate, 6) as component_2, round(said, 6) as component_3 from w",
    "adaptive_threshold": f"{fold_sql(0.001)} select stream_id, win, round(fp_ema + 1e-12, 9) as fp_ema, round(threshold + 1e-12, 9) as threshold from p where rn > 0",
    "adaptive_threshold_clamped": f"{fold_sql(0.5)} select stream_id, win, round(fp_ema + 1e-12, 9) as fp_ema, round(threshold + 1e-12, 9) as threshold from p where rn > 0",
    "adaptive_weights": f"""{fold_sql(0.001)} select stream_id, win, round(a1 + 1e-12, 9) as accuracy_1, round(a2 + 1e-12, 9) as accuracy_2, round(a3 + 1e-12, 9) as accuracy_3,
  {', '.join(f'round(exp(a{i} - greatest(a1, a2, a3)) / {_EXP} + 1e-12, 9) as weight_{i}' for i in (1, 2, 3))} from p where rn > 0""",
    "drift_check": f"""with {_DRIFT} select stream_id, win, n_recent, round(m, 6) as recent_mean, round(s, 6) as recent_std, drift_status, d % 3 as drift_count,
  cast(drift_status > 0 and d % 3 = 0 as integer) as recalibrate from cu""",
    "stability_check": f"""with {_W}, s as (select stream_id, win, accuracy, stddev_pop(accuracy) over f as sd, count(*) over f as k from w window f as (partition by stream_id order by win rows 9 preceding))
select stream_id, win, round(accuracy, 6) as accuracy, round(sd, 6) as accuracy_std, cast(k < 10 or sd < cast(0.05 as double) as integer) as stable from s""",
    "error_states": f"""with {_W}, s as (select stream_id, win, avg(1 - accuracy) over f as m, stddev_pop(1 - accuracy) over f as sd, rn from w window f as (partition by stream_id order by win rows 99 preceding))
select stream_id, win, round(m, 6) as mean_error, round(sd, 6) as error_std, case when rn < 10 then 'NORMAL' when m > cast(0.6 as double) then 'ROLLBACK' when m > cast(0.3 as double) then 'EMERGENCY'
  when sd > cast(0.15 as double) then 'DRIFT_WARN' else 'NORMAL' end as state from s""",
    "feedback_buffer": f"""with {BUSY}, r as (select stream_id, event_id, row_number() over (partition by stream_id order by ts desc, event_id desc) as r from feedback),
b as (select *, count(*) over (partition by stream_id) as buffered from r where r <= 5000) select stream_id, event_id, buffered from b where buffered >= 100""",
    "mined_patterns": mined_sql(),
}
