"""Data preparation, robustness, blending, generalisation and ablation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.scorer_checks import SCORED, prompts
from checks.signal_checks import METRIC_SQL, ORACLES as SIGNAL_SQL, SIGNALS, cells_sql, composite_table, rounded
from checks.sql import LABELS, SCORES, SEEDED, TEXTS, VECTORS, hashed, quote, sql_list
from promptsieve import lexicon as L
from promptsieve.functions import unicode as UN
from promptsieve.operators import compare as CP
from promptsieve.operators import decision as D
from promptsieve.operators import evaluate as E
from promptsieve.operators import patterns as P
from promptsieve.operators import prepare as PR
from promptsieve.operators import robustness as R
from promptsieve.operators import signals as S
from promptsieve.plans import holdout as HO
from promptsieve.sources import sinks
from promptsieve.sources import tables as T
from promptsieve.streaming.feedback import shared_folder

INFERRED = ("documents", "conversations", "pages", "benchmark")
HALVES = {"train": 0.8, "val": 0.1, "test": 0.1}
SPLIT_71 = {"train": 0.711, "val": 0.089, "test": 0.2}


def ids(spark, sf):
    return T.labels(spark, sf)


def loaded(spark, sf):
    rows = T.load_prompts(spark, f"{sf}/conversations.parquet", id_col="conv_id", text_col="text", label_col="role",
                          category_col="role", malicious=("user", "tool"))
    return rows.select("prompt_id", F.length("prompt_text").alias("n_chars"), F.md5(F.encode("prompt_text", "utf-8")).alias("digest"),
                       "is_malicious", "attack_category")


def reported(spark, sf):
    """The threshold sweep as read back from a report in each format; computed once, for the first."""
    report, found = rounded(E.threshold_sweep(T.scores(spark, sf))), []
    for fmt in ("parquet", "json", "csv"):
        path = shared_folder(spark, f"report-{fmt}")
        sinks.write_report(report, path, fmt)
        report = sinks.read_report(spark, path, fmt, report.schema)
        found.append(report.withColumn("format", F.lit(fmt)))
    return reduce(DataFrame.unionByName, found)


def inferred(spark, sf):
    found = [(t, *PR.infer_columns(T.table(spark, sf, t), exact=True)) for t in INFERRED]
    return spark.createDataFrame(found, "table_name string, label_column string, text_column string")


def external(spark, sf):
    table = lambda n: T.table(spark, sf, n)
    turns = table("conversations").withColumn("item_id", F.col("conv_id") * 1000 + F.col("turn"))
    asked = table("documents").join(table("labels"), "doc_id")
    return PR.normalise_external([
        PR.ExternalSet("goals", table("benchmark"), "item_id", "text", F.lit(1)),
        PR.ExternalSet("goals", table("pages"), "page_id", "url", F.lit(0)),
        PR.ExternalSet("typed", turns, "item_id", "text", F.col("role") == "user"),
        PR.ExternalSet("questions", asked, "doc_id", "text", F.col("toxic")),
        PR.ExternalSet("hub", table("pages"), "page_id", "html", F.col("page_id") % 2 == 0),
    ])


def judged_external(spark, sf):
    return P.flag_by_gate(external(spark, sf)).select("dataset", "is_malicious", "pred")


def home(spark, sf):
    own = P.flag_by_gate(prompts(spark, sf)).select("is_malicious", "pred")
    return CP.by_dataset(own.withColumn("dataset", F.lit("home")))


def sample(spark, sf):
    return R.sample_malicious(prompts(spark, sf), 200)


def components(spark, sf):
    pattern = P.pattern_scores(T.seeded_texts(spark, sf)).select("prompt_id", "pattern_score")
    stand_in = T.scores(spark, sf).select(
        "prompt_id", F.col("score").alias("probability"),
        ((F.col("prompt_id") * 31 % 100) / 100.0).alias("similarity"),
        ((F.col("prompt_id") * 17 % 100) / 100.0).alias("keyword_score"),
    )
    return pattern.join(stand_in, "prompt_id")


ABLATION_THRESHOLD = 0.35


def signal_ablation(spark, sf) -> DataFrame:
    """One row per experiment: the composite with all signals, and without each one."""
    frame = composite_table(spark, sf)
    kept = {"full": L.SIGNAL_WEIGHTS, **{
        f"no_{s}": {k: w for k, w in L.SIGNAL_WEIGHTS.items() if k != s} for s in L.SIGNALS
    }}
    variants = F.array(*[
        F.struct(F.lit(n).alias("experiment"), F.lit(len(w)).alias("total_features"),
                 reduce(lambda a, b: a + b, [F.col(s) * v for s, v in w.items()]).alias("score"))
        for n, w in kept.items()
    ])
    long = frame.select("is_malicious", F.explode(variants).alias("v")).select("is_malicious", "v.*")
    pred = (F.col("score") >= ABLATION_THRESHOLD).cast("int")
    cells = E.confusion(long, pred, by=["experiment", "total_features"])
    return E.with_metrics(cells, ("accuracy", "precision", "recall", "f1", "fpr", "fnr"))


def _split_counts(frame, *keys):
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "prompt_table": lambda s, sf: T.prompts(s, sf).select("prompt_id", F.length("prompt_text").alias("n_chars"), "is_malicious", "attack_category"),
    "load_prompts": loaded,
    "report_sinks": reported,
    "infer_columns": inferred,
    "class_distribution": lambda s, sf: PR.class_distribution(ids(s, sf)),
    "stratified_sample": lambda s, sf: PR.stratified_sample(ids(s, sf), 300).select("prompt_id", "is_malicious"),
    "stratified_sample_by_class": lambda s, sf: PR.stratified_sample(
        T.vectors(s, sf).select("prompt_id", "label"), 100, strata=["label"]),
    "stratified_split": lambda s, sf: PR.stratified_split(ids(s, sf), HALVES).select("prompt_id", "split"),
    "stratified_split_two_keys": lambda s, sf: PR.stratified_split(
        ids(s, sf), SPLIT_71, ["is_malicious", "attack_category"]).select("prompt_id", "split"),
    "hash_split": lambda s, sf: PR.hash_split(ids(s, sf), HALVES).select("prompt_id", "split"),
    "stratified_folds": lambda s, sf: PR.stratified_folds(ids(s, sf), 5).select("prompt_id", "is_malicious", "fold"),
    "calibration_halves": lambda s, sf: PR.stratified_folds(ids(s, sf), 2, seed=7).select("prompt_id", "fold"),
    "exact_duplicates": lambda s, sf: PR.drop_duplicates(T.texts(s, sf)),
    "label_reconciliation": lambda s, sf: PR.reconcile_labels(T.prompts(s, sf)),
    "length_filter": lambda s, sf: PR.length_filter(T.texts(s, sf)).select("prompt_id", F.length("prompt_text").alias("n_chars")),
    "category_downsampling": lambda s, sf: _split_counts(PR.downsample_category(ids(s, sf), "jailbreak", 0.2), "attack_category"),
    "external_sets": external,
    "normalised_texts": lambda s, sf: T.seeded_texts(s, sf).select(
        "prompt_id", F.md5(UN.without_marks(F.col("prompt_text")).cast("binary")).alias("digest"),
        F.md5(UN.leet(UN.one_spelling(F.col("prompt_text"))).cast("binary")).alias("leet_digest")),
    "leave_one_out_sides": lambda s, sf: HO.side_sizes(HO.with_quoting(external(s, sf))),
    "external_caps": lambda s, sf: PR.cap_datasets(external(s, sf).select("dataset", "item_id", "is_malicious"), 250),
    "embedding_alignment": lambda s, sf: T.vectors(s, sf).select("prompt_id", "label").join(ids(s, sf), "prompt_id"),
    "robustness_transforms": lambda s, sf: R.transformed(T.seeded_texts(s, sf)).select(
        "prompt_id", "transform", F.md5(F.col("prompt_text").cast("binary")).alias("digest")),
    "robustness_report": lambda s, sf: R.detection_report(sample(s, sf), P.flag_by_gate),
    "robustness_average": lambda s, sf: rounded(R.average_detection(R.detection_report(sample(s, sf), P.flag_by_gate))),
    "blend_decision": lambda s, sf: rounded(D.blend(components(s, sf)).select("prompt_id", "score", "pred")),
    "gated_decision": lambda s, sf: rounded(D.gated_blend(components(s, sf)).select("prompt_id", "score", "pred")),
    "cross_dataset": lambda s, sf: rounded(CP.by_dataset(judged_external(s, sf))),
    "generalisation_gap": lambda s, sf: rounded(CP.generalisation_gap(CP.by_dataset(judged_external(s, sf)), home(s, sf))),
    "signal_ablation": lambda s, sf: rounded(signal_ablation(s, sf)),
    "ablation_deltas": lambda s, sf: rounded(CP.ablation_deltas(signal_ablation(s, sf))),
    "ablation_findings": lambda s, sf: rounded(CP.ablation_findings(signal_ablation(s, sf))),
}


def rank_sql(source: str, strata: str, key: str = "prompt_id", seed: int = 42) -> str:
    return f"""rk as (select *, row_number() over (partition by {strata} order by {hashed(key, seed)}, {key}) as rank,
  count(*) over (partition by {strata}) as size, count(*) over () as total from {source})"""


def split_sql(point: str, fractions) -> str:
    edge, out = 0.0, "case "
    names = list(fractions)
    for n in names[:-1]:
        edge += fractions[n]
        out += f"when {point} < cast({edge!r} as double) then '{n}' "
    return out + f"else '{names[-1]}' end as split"


def infer_sql() -> str:
    parts = []
    known = {"documents": (None, "text"), "conversations": (None, "text"), "pages": (None, None), "benchmark": (None, "text")}
    columns = {
        "documents": ["doc_id", "text", "lang", "source", "n_chars"], "conversations": ["conv_id", "turn", "role", "text"],
        "pages": ["page_id", "url", "html"], "benchmark": ["item_id", "text"],
    }
    for t, (_, text) in known.items():
        d = " union all ".join(f"select {i} as i, '{c}' as c, count(distinct {c}) as n from {t}" for i, c in enumerate(columns[t]))
        label = f"(select c from ({d}) order by n, i limit 1)"
        if text is None:
            ln = " union all ".join(f"select '{c}' as c, avg(length({c})) as n from {t}" for c in columns[t][1:])
            text_sql = f"(select c from ({ln}) order by n desc limit 1)"
        else:
            text_sql = f"'{text}'"
        parts.append(f"select '{t}' as table_name, {label} as label_column, {text_sql} as text_column")
    return " union all ".join(parts)


_SPELLED = r"trim(regexp_replace(lower(strip_accents(prompt_text)), '\s+', ' ', 'g'))"
EXTERNAL = """ext as (
  select 'goals' as dataset, item_id, coalesce(text, '') as prompt_text, 1 as is_malicious from benchmark
  union all select 'goals', page_id, coalesce(url, ''), 0 from pages
  union all select 'typed', conv_id * 1000 + turn, coalesce(text, ''), cast(role = 'user' as integer) from conversations
  union all select 'questions', d.doc_id, coalesce(d.text, ''), l.toxic from documents d join labels l on l.doc_id = d.doc_id
  union all select 'hub', page_id, coalesce(html, ''), cast(page_id % 2 = 0 as integer) from pages)"""


def detect_sql(column: str) -> str:
    """The gate at 0.6 is reached exactly when any pattern matches."""
    tests = " or ".join(f"regexp_matches({column}, {quote('(?i)' + p)})" for p in L.PATTERN_SCORES)
    return f"cast(({tests}) as integer)"


def replaced_sql(column: str, pairs) -> str:
    for old, new in pairs:
        column = f"replace({column}, {quote(old)}, {quote(new)})"
    return column


def mixed_sql(i: str, seed: int) -> str:
    return f"(((prompt_id % 100003) * 7919 + {i} * 104729 + {seed * 15485863}) % 1000003)"


def swapped_sql(table, seed: int) -> str:
    old, new = "".join(table) + "".join(table).upper(), "".join(table.values()) * 2
    return (f"array_to_string(list_transform(string_split(prompt_text, ''), lambda c, i: "
            f"case when {mixed_sql('(i - 1)', seed)} % 10 < 3 then translate(c, {quote(old)}, {quote(new)}) else c end), '')")


VARIANTS = {
    "original": "prompt_text",
    "paraphrase": replaced_sql("prompt_text", L.PARAPHRASES),
    "misspelling": swapped_sql(L.LEET, 1),
    "unicode": swapped_sql(L.CYRILLIC, 2),
    "base64": f"{quote(L.BASE64_PREFIX)} || to_base64(encode(prompt_text))",
    "roleplay": f"({sql_list(L.ROLEPLAY_PREFIXES)})[{mixed_sql('0', 7)} % 3 + 1] || prompt_text",
    "euphemistic": replaced_sql("prompt_text", L.EUPHEMISMS),
    "long_context": f"{quote(L.LONG_PREFIX)} || prompt_text || {quote(L.LONG_SUFFIX)}",
}
_SAMPLE = f"""{SEEDED}, {LABELS},
smp as (select s.prompt_id, s.prompt_text from seeded s join labelled l using (prompt_id) where l.is_malicious = 1 order by {hashed('s.prompt_id')}, s.prompt_id limit 200)"""
_VARIED = " union all ".join(f"select prompt_id, '{n}' as transform, {e} as txt from smp" for n, e in VARIANTS.items())
_REPORT = f"""{_SAMPLE}, var as ({_VARIED}), jd as (select transform, {detect_sql('txt')} as pred from var),
rt as (select transform, count(*) as n, avg(cast(pred as double)) * 100 as rate from jd group by 1)"""
_COMPONENTS = f"""{SCORED}, {SCORES}, cmp as (select p.prompt_id, pattern_score, score as probability,
  (p.prompt_id * 31 % 100) / cast(100 as double) as similarity, (p.prompt_id * 17 % 100) / cast(100 as double) as keyword_score from pat p join scores using (prompt_id))"""


def blend_sql(similarity: str) -> str:
    gated = "case when pattern_score >= cast(0.6 as double) then pattern_score else 0 end"
    return f"""with {_COMPONENTS}, b as (select prompt_id, cast(0.1 as double) * {gated} + cast(0.1 as double) * {similarity} + cast(0.8 as double) * probability as score from cmp)
select prompt_id, round(score, 6) as score, cast(score >= cast(0.55 as double) as integer) as pred from b"""


_JUDGED = f"{EXTERNAL}, je as (select dataset, is_malicious, {detect_sql('prompt_text')} as pred from ext)"
_BY = f"ed as (select dataset, count(*) as n, {cells_sql('pred = 1')} from je group by 1), em as (select dataset, n, {METRIC_SQL['accuracy']} as accuracy, {METRIC_SQL['f1']} as f1 from ed)"
_HOME = f"""{SEEDED}, {LABELS}, jh as (select l.is_malicious, {detect_sql('prompt_text')} as pred from seeded join labelled l using (prompt_id)),
hc as (select {cells_sql('pred = 1')} from jh), hm as (select {METRIC_SQL['accuracy']} as accuracy, {METRIC_SQL['f1']} as f1 from hc)"""

_KEPT = {"full": L.SIGNALS, **{f"no_{s}": tuple(k for k in L.SIGNALS if k != s) for s in L.SIGNALS}}
_ABL_ROWS = " union all ".join(
    f"select '{n}' as experiment, {len(k)} as total_features, is_malicious, {' + '.join(f'{s} * cast({L.SIGNAL_WEIGHTS[s]} as double)' for s in k)} as score from composite"
    for n, k in _KEPT.items()
)
_ABL_METRICS = ("accuracy", "precision", "recall", "f1", "fpr", "fnr")
ABLATION = f"""{SIGNALS}, av as ({_ABL_ROWS}),
ac as (select experiment, total_features, {cells_sql('score >= cast(0.35 as double)')} from av group by 1, 2),
ab as (select *, {', '.join(f"{METRIC_SQL[m]} as {m}" for m in _ABL_METRICS)} from ac)"""
_DELTAS = f"""{ABLATION}, dl as (select a.experiment, {', '.join(f'a.{m} - b.{m} as delta_{m}' for m in _ABL_METRICS)} from ab a join ab b on b.experiment = 'full' where a.experiment <> 'full')"""


def _pick(finding, source, value, descending):
    order = "desc" if descending else "asc"
    return f"(select '{finding}' as finding, experiment, round({value}, 6) as value from {source} order by {value} {order}, experiment {order} limit 1)"


_FINDINGS = " union all ".join(
    [_pick("largest_f1_decrease", "dl", "delta_f1", False), _pick("smallest_f1_decrease", "dl", "delta_f1", True)]
    + [_pick(f"best_{m}", "ab", m, m not in ("fpr", "fnr")) for m in _ABL_METRICS]
    + [_pick("best_tradeoff", "ab", "f1 - cast(0.0001 as double) * total_features", True)]
)

ORACLES = {
    "prompt_table": f"with {TEXTS}, {LABELS} select t.prompt_id, cast(length(prompt_text) as integer) as n_chars, is_malicious, attack_category from texts t join labelled using (prompt_id)",
    "load_prompts": """select conv_id as prompt_id, cast(length(coalesce(text, '')) as integer) as n_chars, md5(coalesce(text, '')) as digest,
  cast(role in ('user', 'tool') as integer) as is_malicious, role as attack_category from conversations""",
    "report_sinks": f"select r.*, f.format from ({SIGNAL_SQL['score_threshold_sweep']}) r, (values ('parquet'), ('json'), ('csv')) f(format)",
    "infer_columns": infer_sql(),
    "class_distribution": f"with {LABELS} select is_malicious, count(*) as n from labelled group by 1",
    "stratified_sample": f"with {LABELS}, {rank_sql('labelled', 'is_malicious')} select prompt_id, is_malicious from rk where total <= 300 or rank <= floor(300 * size / cast(total as double))",
    "stratified_sample_by_class": f"with {VECTORS}, {rank_sql('vecs', 'label')} select prompt_id, label from rk where total <= 100 or rank <= floor(100 * size / cast(total as double))",
    "stratified_split": f"with {LABELS}, {rank_sql('labelled', 'is_malicious')} select prompt_id, {split_sql('(rank - 0.5) / cast(size as double)', HALVES)} from rk",
    "stratified_split_two_keys": f"with {LABELS}, {rank_sql('labelled', 'is_malicious, attack_category')} select prompt_id, {split_sql('(rank - 0.5) / cast(size as double)', SPLIT_71)} from rk",
    "hash_split": f"with {LABELS} select prompt_id, {split_sql(hashed('prompt_id') + ' / cast(4294967296 as double)', HALVES)} from labelled",
    "stratified_folds": f"with {LABELS}, {rank_sql('labelled', 'is_malicious')} select prompt_id, is_malicious, cast((rank - 1) % 5 as integer) as fold from rk",
    "calibration_halves": f"with {LABELS}, {rank_sql('labelled', 'is_malicious', seed=7)} select prompt_id, cast((rank - 1) % 2 as integer) as fold from rk",
    "exact_duplicates": f"with {TEXTS} select min(prompt_id) as prompt_id, count(*) as copies from texts group by prompt_text",
    "label_reconciliation": f"""with {TEXTS}, {LABELS}, j as (select t.prompt_id, prompt_text, is_malicious from texts t join labelled using (prompt_id))
select prompt_id, is_malicious, cast(avg(cast(is_malicious as double)) over (partition by prompt_text) >= cast(0.5 as double) as integer) as reconciled from j""",
    "length_filter": f"with {TEXTS} select prompt_id, cast(length(prompt_text) as integer) as n_chars from texts where length(prompt_text) between 5 and 20000",
    "category_downsampling": f"with {LABELS} select attack_category, count(*) as n from labelled where attack_category <> 'jailbreak' or {hashed('prompt_id')} < {int(0.2 * (1 << 32))} group by 1",
    "external_sets": f"with {EXTERNAL} select * from ext",
    "normalised_texts": f"""with {SEEDED} select prompt_id, md5(strip_accents(prompt_text)) as digest,
  md5(translate({_SPELLED}, '0134578@$', 'oieastbas')) as leet_digest from seeded""",
    "leave_one_out_sides": f"""with {EXTERNAL}, g as (select dataset, md5({_SPELLED}) as g from ext),
q as (select g, list(distinct dataset) as sets from g group by 1),
m as (select dataset, unnest(sets) as held_out from g join q using (g)),
h as (select held_out, count(case when dataset = held_out then 1 end) as n_test, count(case when dataset <> held_out then 1 end) as n_left_out from m group by 1)
select held_out, (select count(*) from ext) - n_test - n_left_out as n_train, n_test, n_left_out from h""",
    "external_caps": f"with {EXTERNAL}, {rank_sql('ext', 'dataset', 'item_id')} select dataset, item_id, is_malicious from rk where rank <= 250",
    "embedding_alignment": f"with {VECTORS}, {LABELS} select prompt_id, v.label, l.is_malicious, l.attack_category from vecs v join labelled l using (prompt_id)",
    "robustness_transforms": f"with {SEEDED}, var as ({_VARIED.replace('from smp', 'from seeded')}) select prompt_id, transform, md5(txt) as digest from var",
    "robustness_report": f"""with {_REPORT} select transform, n, round(rate, 1) as detection_rate, round(100 - rate, 1) as attack_success_rate,
  case when rate >= 80 then 'PASS' when rate < 50 then 'FAIL' else 'WARN' end as verdict from rt""",
    "robustness_average": f"with {_REPORT} select round(avg(round(rate, 1)), 6) as average_detection_rate from rt where transform <> 'original'",
    "blend_decision": blend_sql("similarity"),
    "gated_decision": blend_sql("(case when pattern_score >= cast(0.6 as double) then greatest(similarity, keyword_score) else 0 end)"),
    "cross_dataset": f"with {_JUDGED}, {_BY} select dataset, n, round(accuracy, 6) as accuracy, round(f1, 6) as f1 from em",
    "generalisation_gap": f"""with {_JUDGED}, {_BY}, {_HOME}, mc as (select avg(accuracy) as a, avg(f1) as f from em)
select round(accuracy, 6) as home_accuracy, round(f1, 6) as home_f1, round(a, 6) as external_accuracy, round(f, 6) as external_f1, round((accuracy - a) * 100, 6) as accuracy_drop_points from hm, mc""",
    "signal_ablation": f"with {ABLATION} select experiment, total_features, tp, fp, tn, fn, {', '.join(f'round({m}, 6) as {m}' for m in _ABL_METRICS)} from ab",
    "ablation_deltas": f"with {_DELTAS} select experiment, {', '.join(f'round(delta_{m}, 6) as delta_{m}' for m in _ABL_METRICS)} from dl",
    "ablation_findings": f"with {_DELTAS} {_FINDINGS}",
}
