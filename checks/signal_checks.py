"""Seven signals and evaluation aggregates: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.sql import LABELS, SCORES, SEEDED, VECTORS, doubles, r6, sql_list, words
from promptsieve import lexicon as L
from promptsieve.operators import centroids as C
from promptsieve.operators import evaluate as E
from promptsieve.operators import signals as S
from promptsieve.sources import tables as T


def rounded(frame: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison; other columns as they are."""
    return frame.select(*[
        F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes
    ])


def signal_table(spark: SparkSession, sf: str) -> DataFrame:
    texts = T.seeded_texts(spark, sf)
    vectors = T.vectors(spark, sf)
    model = C.CentroidModel.fit_cosine(vectors, "category")
    return S.signals(texts, S.collect_stats(texts), C.max_similarity(vectors, model))


def composite_table(spark: SparkSession, sf: str) -> DataFrame:
    return S.composite(signal_table(spark, sf)).join(T.labels(spark, sf), "prompt_id")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Signals, weighted composite and the 50-point threshold sweep."""
    return rounded(E.threshold_sweep(composite_table(spark, sf)))


KW = f"kw as (select unnest({sql_list(L.SPARSE_KEYWORDS)}) as keyword)"
STATS = f"""{SEEDED},
{KW},
corpus as (select count(*) as documents, avg(length(prompt_text)) as mean_length from seeded),
dfs as (select keyword, count(prompt_id) as df from kw left join seeded on contains(lower(prompt_text), keyword) group by keyword),
idf as (select keyword, df, case when df > 0 then ln(cast(documents as double) / df) else ln(documents / cast(2 as double)) end as idf from dfs, corpus)"""

SIGNALS = f"""{STATS},
{LABELS},
{VECTORS},
tok as (select prompt_id, prompt_text, lower(prompt_text) as low, length(prompt_text) as nc, {words('prompt_text')} as w from seeded),
chist as (select prompt_id, c, count(*) as n from (select prompt_id, unnest(string_split(low, '')) as c from tok) group by all),
cent as (select t.prompt_id, sum(-(n / cast(nc as double)) * log2(n / cast(nc as double))) as ce from chist join tok t using (prompt_id) group by 1),
whist as (select prompt_id, x, count(*) as n from (select prompt_id, unnest(w) as x from tok) group by all),
went as (select prompt_id, count(*) as dw, sum(n) as nw,
           sum(-(n / cast(tw as double)) * log2(n / cast(tw as double))) as we,
           sum(n * length(x)) / cast(sum(n) as double) as awl,
           sum(case when list_contains({sql_list(L.COMMON_WORDS)}, x) then n else 0 end) as common,
           sum(case when list_contains({sql_list(L.ATTACK_WORDS)}, x) then n else 0 end) as attack
         from (select *, sum(n) over (partition by prompt_id) as tw from whist) group by 1),
phr as (select unnest({sql_list(L.ATTACK_PHRASES)}) as p),
subs as (select prompt_id, count(*) as sub from tok join phr on contains(low, p) group by 1),
gram as (select prompt_id, i, w[i] || ' ' || w[i+1] as bg, case when i <= len(w) - 2 then w[i] || ' ' || w[i+1] || ' ' || w[i+2] end as tg
         from (select prompt_id, w, unnest(range(1, len(w))) as i from tok)),
gm as (select prompt_id, count(case when bg in (select p from phr) then 1 end) as bgm,
              count(case when tg in (select p from phr) then 1 end) as tgm from gram group by 1),
sparse as (select prompt_id, sum(idf) as s from tok join idf on contains(low, keyword) group by 1),
dims as (select prompt_id, category, unnest(embedding) as v, generate_subscripts(embedding, 1) as d from vecs),
cmean as (select category, d, avg(cast(v as double)) as m from dims group by all),
cunit as (select category, d, m / greatest(sqrt(sum(m * m) over (partition by category)), 1e-8) as u from cmean),
vnorm as (select prompt_id, greatest(sqrt(sum(cast(v as double) * cast(v as double))), 1e-8) as nrm from dims group by 1),
csim as (select a.prompt_id, c.category, sum(cast(a.v as double) * c.u) / any_value(n.nrm) as sim
         from dims a join cunit c on a.d = c.d join vnorm n on n.prompt_id = a.prompt_id group by 1, 2),
cmax as (select prompt_id, max(sim) as centroid from csim group by 1),
signals as (
  select t.prompt_id,
    coalesce(sparse.s, 0) / (select sum(idf) from idf) as sparse_idf,
    coalesce(cmax.centroid, 0) as centroid,
    case when nw >= 2 then greatest(0, least(1, 0.4 * (ce / 8.0) + 0.3 * (dw / cast(nw as double)) + 0.3 * least(1, awl / 10.0))) else 0 end as perplexity,
    case when nw >= 1 then greatest(0, least(1, 0.6 * (ce / 6.5) + 0.4 * (we / log2(greatest(dw, 2))))) else 0 end as entropy,
    case when nw >= 1 then greatest(0, least(1, 0.5 * (1 - common / cast(nw as double)) + 0.5 * least(1, attack / cast(nw as double) * 3))) else 0 end as token_frequency,
    case when nw >= 2 then greatest(0, least(1, 0.5 * ((bgm + 1.5 * tgm) / cast(2 * nw - 3 as double)) + 0.5 * least(1, coalesce(sub, 0) * 0.2))) else 0 end as ngram_overlap,
    ln(1 + nc) / ln(1 + (select mean_length from corpus)) as length_norm
  from tok t left join cent using (prompt_id) left join went using (prompt_id) left join subs using (prompt_id)
    left join gm using (prompt_id) left join sparse using (prompt_id) left join cmax using (prompt_id)),
composite as (select s.*, l.is_malicious, l.attack_category,
    {' + '.join(f"{w} * {s}" for s, w in L.SIGNAL_WEIGHTS.items())} as score
  from signals s join labelled l using (prompt_id))"""

LONG = " union all ".join(
    f"select prompt_id, is_malicious, '{s}' as signal, {s} as value from composite" for s in L.SIGNALS
)

METRIC_SQL = {
    "accuracy": "(tp + tn) / cast(tp + fp + tn + fn as double)",
    "balanced_accuracy": "(tp / cast(tp + fn as double) + tn / cast(tn + fp as double)) / 2",
    "precision": "case when tp + fp = 0 then 0 else tp / cast(tp + fp as double) end",
    "recall": "tp / cast(tp + fn as double)",
    "f1": "case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / cast(2 * tp + fp + fn as double) end",
    "mcc": """case when (tp + fp) * (tn + fn) = 0 then 0 else
      (cast(tp as double) * tn - cast(fp as double) * fn) / sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn)) end""",
    "kappa": """((tp + tn) / cast(tp + fp + tn + fn as double) - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (cast(tp + fp + tn + fn as double) * (tp + fp + tn + fn)))
      / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (cast(tp + fp + tn + fn as double) * (tp + fp + tn + fn)))""",
    "fpr": "fp / cast(fp + tn as double)",
    "fnr": "fn / cast(fn + tp as double)",
}


def metrics_sql(names) -> str:
    return ", ".join(r6(METRIC_SQL[n], n) for n in names)


def cells_sql(pred: str, by: str = "") -> str:
    return f"""{by} count(case when {pred} and is_malicious = 1 then 1 end) as tp,
      count(case when {pred} and is_malicious = 0 then 1 end) as fp,
      count(case when not ({pred}) and is_malicious = 0 then 1 end) as tn,
      count(case when not ({pred}) and is_malicious = 1 then 1 end) as fn"""


def sweep_sql(source: str, thresholds) -> str:
    return f"""select threshold, {cells_sql('score >= threshold')}
      from {source}, (select unnest({doubles(thresholds)}) as threshold) group by threshold"""


SWEEP_COLUMNS = f"round(threshold, 6) as threshold, tp, fp, tn, fn, {metrics_sql(E.SWEEP_METRICS)}"
AT_HALF = "score >= cast(0.5 as double)"
RANK = f"""{SCORES},
bys as (select score, count(case when is_malicious = 1 then 1 end) as pos, count(case when is_malicious = 0 then 1 end) as neg from scores group by 1),
rk as (select score, pos, neg,
  cast(sum(pos) over (order by score desc) as bigint) as tp, cast(sum(neg) over (order by score desc) as bigint) as fp,
  cast(sum(pos) over () as bigint) as n_pos, cast(sum(neg) over () as bigint) as n_neg,
  lead(pos) over (order by score desc) as next_pos, lead(neg) over (order by score desc) as next_neg from bys)"""


def half(frame: DataFrame) -> DataFrame:
    return frame.withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def _signal(name: str):
    return lambda spark, sf: rounded(signal_table(spark, sf).select("prompt_id", name))


def _ranked(spark, sf):
    return E.ranked(T.scores(spark, sf))


QUERIES = {
    "composite_threshold_sweep": flagship,
    "corpus_statistics": lambda s, sf: rounded(S.corpus_stats(T.seeded_texts(s, sf))),
    **{f"signal_{n}": _signal(n) for n in L.SIGNALS},
    "composite_score": lambda s, sf: rounded(composite_table(s, sf).select("prompt_id", "score")),
    "signal_discrimination": lambda s, sf: rounded(S.discrimination(composite_table(s, sf))),
    "signal_statistics": lambda s, sf: rounded(S.statistics(signal_table(s, sf))),
    "category_breakdown": lambda s, sf: rounded(S.by_category(composite_table(s, sf))),
    "confusion_matrix": lambda s, sf: E.confusion(half(T.scores(s, sf)), F.col("pred")),
    "classification_metrics": lambda s, sf: rounded(
        E.with_metrics(E.confusion(half(T.scores(s, sf)), F.col("pred")),
                       ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "fpr", "fnr"))),
    "agreement_metrics": lambda s, sf: rounded(
        E.with_metrics(E.confusion(half(T.scores(s, sf)), F.col("pred")), ("mcc", "kappa"))),
    "class_report": lambda s, sf: rounded(E.class_report(half(T.scores(s, sf)), "pred")),
    "roc_auc": lambda s, sf: rounded(E.roc_auc(_ranked(s, sf))),
    "average_precision": lambda s, sf: rounded(E.average_precision(_ranked(s, sf))),
    "roc_curve": lambda s, sf: rounded(E.roc_curve(_ranked(s, sf))),
    "pr_curve": lambda s, sf: rounded(E.pr_curve(_ranked(s, sf))),
    "score_threshold_sweep": lambda s, sf: rounded(E.threshold_sweep(T.scores(s, sf))),
    "constrained_threshold": lambda s, sf: rounded(
        E.constrained_optimum(E.threshold_sweep(T.scores(s, sf)))),
    "constrained_threshold_wide": lambda s, sf: rounded(
        E.constrained_optimum(E.threshold_sweep(T.scores(s, sf)), max_fnr=0.5)),
    "best_f1_threshold": lambda s, sf: rounded(E.best_f1_threshold(T.scores(s, sf))),
    "calibration_error": lambda s, sf: rounded(E.calibration_error(T.scores(s, sf))),
    "score_histogram": lambda s, sf: rounded(E.score_histogram(T.scores(s, sf))),
    "majority_baseline": lambda s, sf: rounded(E.majority_baseline(T.labels(s, sf))),
    "category_threshold_sweep": lambda s, sf: rounded(
        E.threshold_sweep(T.scores(s, sf).withColumn("fold", F.col("prompt_id") % 3), by=["fold"])),
}

_CONSTRAINED = """
picked as (select * from sw order by case when fnr <= {limit} then 0 else 1 end,
  case when fnr <= {limit} then -balanced_accuracy else fnr end, threshold limit 1)"""


def _constrained(limit: float) -> str:
    return f"""with {SCORES},
sw0 as ({sweep_sql('scores', E.SWEEP_THRESHOLDS)}),
sw as (select threshold, tp, fp, tn, fn, {', '.join(f"{METRIC_SQL[m]} as {m}" for m in E.SWEEP_METRICS)} from sw0),
{_CONSTRAINED.format(limit=f"cast({limit} as double)")}
select round(threshold, 6) as threshold, tp, fp, tn, fn, {', '.join(r6(m, m) for m in E.SWEEP_METRICS)} from picked"""


ORACLES = {
    "composite_threshold_sweep": f"with {SIGNALS}, sw as ({sweep_sql('composite', E.SWEEP_THRESHOLDS)}) select {SWEEP_COLUMNS} from sw",
    "corpus_statistics": f"with {STATS} select keyword, documents, round(mean_length, 6) as mean_length, df, round(idf, 6) as idf from idf, corpus",
    **{f"signal_{n}": f"with {SIGNALS} select prompt_id, round({n}, 6) as {n} from signals" for n in L.SIGNALS},
    "composite_score": f"with {SIGNALS} select prompt_id, round(score, 6) as score from composite",
    "signal_discrimination": f"""with {SIGNALS}, long as ({LONG}),
m as (select signal, avg(case when is_malicious = 0 then value end) as benign_mean, avg(case when is_malicious = 1 then value end) as malicious_mean from long group by 1)
select signal, round(benign_mean, 6) as benign_mean, round(malicious_mean, 6) as malicious_mean, round(abs(malicious_mean - benign_mean), 6) as delta,
  case when abs(malicious_mean - benign_mean) > 0.1 then 'STRONG' when abs(malicious_mean - benign_mean) > 0.05 then 'MODERATE' else 'WEAK' end as status from m""",
    "signal_statistics": f"with {SIGNALS}, long as ({LONG}) select signal, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from long group by 1",
    "category_breakdown": f"""with {SIGNALS} select attack_category,
  round(avg(case when cast({AT_HALF} as integer) = is_malicious then cast(1 as double) else 0 end), 6) as accuracy, count(*) as n_samples,
  count(case when is_malicious = 1 then 1 end) as n_malicious, count(case when is_malicious = 0 then 1 end) as n_benign from composite group by 1""",
    "confusion_matrix": f"with {SCORES} select {cells_sql(AT_HALF)} from scores",
    "classification_metrics": f"with {SCORES}, c as (select {cells_sql(AT_HALF)} from scores) select *, {metrics_sql(('accuracy', 'balanced_accuracy', 'precision', 'recall', 'f1', 'fpr', 'fnr'))} from c",
    "agreement_metrics": f"with {SCORES}, c as (select {cells_sql(AT_HALF)} from scores) select *, {metrics_sql(('mcc', 'kappa'))} from c",
    "class_report": f"""with {SCORES}, p as (select is_malicious as y, cast({AT_HALF} as integer) as p from scores),
k as (select unnest([0, 1]) as c),
r as (select c, count(case when y = c and p = c then 1 end) as hit, count(case when p = c then 1 end) as said, count(case when y = c then 1 end) as support from k, p group by c),
m as (select cast(c as varchar) as class, case when said = 0 then 0 else hit / cast(said as double) end as precision, case when support = 0 then 0 else hit / cast(support as double) end as recall,
  case when said + support = 0 then 0 else 2 * hit / cast(said + support as double) end as f1, support from r),
u as (select * from m union all select 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from m)
select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from u""",
    "roc_auc": f"with {RANK} select round(sum(neg * (tp - pos + pos / cast(2 as double))) / (max(n_pos) * cast(max(n_neg) as double)), 6) as roc_auc from rk",
    "average_precision": f"with {RANK} select round(sum(pos * (tp / cast(tp + fp as double))) / max(n_pos), 6) as average_precision from rk",
    "roc_curve": f"""with {RANK} select round(score, 6) as threshold, round(fp / cast(n_neg as double), 6) as fpr, round(tp / cast(n_pos as double), 6) as tpr from rk
where tp + fp = pos + neg or next_pos is null or next_pos <> pos or next_neg <> neg
union all select cast('infinity' as double), 0, 0""",
    "pr_curve": f"""with {RANK} select round(score, 6) as threshold, round(tp / cast(tp + fp as double), 6) as precision, round(tp / cast(n_pos as double), 6) as recall from rk
union all select cast('infinity' as double), 1, 0""",
    "score_threshold_sweep": f"with {SCORES}, sw as ({sweep_sql('scores', E.SWEEP_THRESHOLDS)}) select {SWEEP_COLUMNS} from sw",
    "constrained_threshold": _constrained(0.05),
    "constrained_threshold_wide": _constrained(0.5),
    "best_f1_threshold": f"""with {SCORES}, sw as ({sweep_sql('scores', E.f1_thresholds())}), f as (select threshold, {METRIC_SQL['f1']} as f1 from sw)
select round(threshold, 6) as threshold, round(f1, 6) as f1 from f order by f1 desc, threshold limit 1""",
    "calibration_error": f"""with {SCORES}, edges as (select unnest(range(0, 10)) as i),
b as (select i, count(*) as n, avg(cast(is_malicious as double)) as y, avg(score) as p from scores join edges
  on score >= i * cast(0.1 as double) and score < case when i = 9 then cast(1 as double) else (i + 1) * cast(0.1 as double) end group by 1)
select round(sum(n * abs(y - p)) / (select count(*) from scores), 6) as ece, cast(sum(n) as bigint) as n_binned, (select count(*) from scores) as n from b""",
    "score_histogram": f"""with {SCORES}, r as (select is_malicious, min(score) as lo, max(score) as hi, count(*) as n_class from scores group by 1),
h as (select is_malicious, cast(least(floor((score - lo) / (hi - lo) * 50), 49) as integer) as bin, any_value(lo) as lo, any_value(hi) as hi, any_value(n_class) as n_class, count(*) as n
  from scores join r using (is_malicious) group by 1, 2)
select is_malicious, bin, round(lo + bin * ((hi - lo) / 50), 6) as bin_start, n, round(n / (n_class * ((hi - lo) / 50)), 6) as density from h""",
    "majority_baseline": f"""with {LABELS}, c as (select is_malicious, count(*) as n from labelled group by 1)
select round(max(n) / cast(sum(n) as double), 6) as baseline, (select is_malicious from c order by n desc, is_malicious limit 1) as majority_class, cast(sum(n) as bigint) as n from c""",
    "category_threshold_sweep": f"""with {SCORES}, sw as (select prompt_id % 3 as fold, threshold, {cells_sql('score >= threshold')}
  from scores, (select unnest({doubles(E.SWEEP_THRESHOLDS)}) as threshold) group by 1, 2)
select fold, {SWEEP_COLUMNS} from sw""",
}
