"""Embedding-space operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.signal_checks import METRIC_SQL, rounded
from checks.sql import VECTORS, hashed
from promptsieve.operators import centroids as C
from promptsieve.operators import evaluate as E
from promptsieve.plans import centroid_study as S
from promptsieve.sources import tables as T

# Three stand-in embedding models: the whole vector, and two transforms of every entry.
MODELS = {
    "plain": (lambda v: v, "v"),
    "signed_root": (lambda v: F.signum(v) * F.sqrt(F.abs(v)), "sign(v) * sqrt(abs(v))"),
    "rounded": (lambda v: F.floor(v * 8) / 8, "floor(v * 8) / 8"),
}


def vectors(spark, sf):
    return T.vectors(spark, sf)


def cosine(spark, sf, by="is_malicious"):
    frame = vectors(spark, sf)
    return C.score_cosine(frame, C.CentroidModel.fit_cosine(frame, by))


def euclidean(spark, sf, by="is_malicious"):
    frame = vectors(spark, sf)
    return C.score_euclidean(frame, C.CentroidModel.fit_euclidean(frame, by))


def long(frame, column, name, classes):
    """One row per (prompt, class) of an array column in class order."""
    return rounded(frame.select("prompt_id", F.posexplode(column).alias("i", name)).select(
        "prompt_id", F.get(F.array(*map(F.lit, classes)), F.col("i")).alias("class"), name
    ))


def dims(frame, column, name):
    return frame.select("*", F.posexplode(column).alias("d", name)).drop(column)


def models(spark, sf):
    frame = vectors(spark, sf)
    return {n: frame.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), f)) for n, (f, _) in MODELS.items()}


def four_way(spark, sf):
    frame = vectors(spark, sf)
    model = C.CentroidModel.fit_cosine(frame, "category")
    scored = C.score_cosine(frame, model)
    malicious = C.max_similarity(frame, model, classes=(1, 2, 3))
    return rounded(scored.select("prompt_id", "category", "prediction").join(
        malicious.withColumnRenamed("centroid", "malicious_similarity"), "prompt_id"))


B = f"""{VECTORS},
dims as (select prompt_id, is_malicious, category, label, cast(unnest(embedding) as double) as v, generate_subscripts(embedding, 1) as d from vecs)"""


def means(by: str) -> str:
    return f"cm as (select {by} as class, d, avg(v) as m, count(*) as n from dims group by all), cu as (select class, d, n, m, m / sqrt(sum(m * m) over (partition by class)) as u from cm)"


NORMED = "vn as (select prompt_id, sqrt(sum(v * v)) as nrm from dims group by 1)"


def sims(by: str) -> str:
    return f"""{B}, {means(by)}, {NORMED},
sim as (select a.prompt_id, c.class, sum(a.v * c.u) / any_value(nrm) as s from dims a join cu c using (d) join vn using (prompt_id) group by 1, 2)"""


def dists(by: str) -> str:
    return f"""{B}, {means(by)},
sc as (select d, avg(v) as mu, case when stddev_pop(v) > 0 then stddev_pop(v) else 1 end as sd from dims group by 1),
dist as (select a.prompt_id, c.class, sqrt(sum(power((a.v - mu) / sd - (c.m - mu) / sd, 2))) as x from dims a join cm c using (d) join sc using (d) group by 1, 2)"""


ARGMAX = "pr as (select prompt_id, class as prediction from (select *, row_number() over (partition by prompt_id order by s desc, class) as rn from sim) where rn = 1)"
ARGMIN = "pr as (select prompt_id, class as prediction from (select *, row_number() over (partition by prompt_id order by x, class) as rn from dist) where rn = 1)"
SIM_MARGIN = "mg as (select prompt_id, max(case when class = 1 then s end) - max(case when class = 0 then s end) as margin from sim group by 1)"
DIST_MARGIN = "mg as (select prompt_id, max(case when class = 0 then x end) - max(case when class = 1 then x end) as margin from dist group by 1)"


_COSINE = f"""vn as (select prompt_id, sqrt(sum(v * v)) as nrm from dims group by 1),
sim as (select a.prompt_id, c.class, sum(a.v * c.u) / any_value(nrm) as s from dims a join cu c using (d) join vn using (prompt_id) where not a.tr and c.tr group by 1, 2),
{ARGMAX},
pb as (select prompt_id, max(case when class = 1 then exp(s) end) / sum(exp(s)) as p from sim group by 1)"""
_EUCLIDEAN = f"""sc as (select d, avg(v) as mu, case when stddev_pop(v) > 0 then stddev_pop(v) else 1 end as sd from dims where tr group by 1),
dist as (select a.prompt_id, c.class, sqrt(sum(power((a.v - mu) / sd - (c.m - mu) / sd, 2))) as x from dims a join cu c using (d) join sc using (d) where not a.tr and c.tr group by 1, 2),
{ARGMIN},
pb as (select prompt_id, max(case when class = 1 then 1 / (x + 1e-8) end) / sum(1 / (x + 1e-8)) as p from dist group by 1)"""


def study_sql(name: str, method: str) -> str:
    """One model's row: nearest centroid, trained on four fifths by hash and tested on the rest."""
    return f"""(with {VECTORS}, dims as (select prompt_id, is_malicious, tr, {MODELS[name][1]} as v, d from
  (select prompt_id, is_malicious, {hashed('prompt_id')} / cast(4294967296 as double) < cast(0.8 as double) as tr,
          cast(unnest(embedding) as double) as v, generate_subscripts(embedding, 1) as d from vecs)),
cm as (select tr, is_malicious as class, d, avg(v) as m from dims group by all),
cu as (select tr, class, d, m, m / sqrt(sum(m * m) over (partition by tr, class)) as u from cm),
{_COSINE if method == 'cosine' else _EUCLIDEAN},
al as (select v.prompt_id, is_malicious as y, prediction as q, round(p, 9) as p from vecs v join pr using (prompt_id) join pb using (prompt_id)),
cells as (select count(case when q = 1 and y = 1 then 1 end) as tp, count(case when q = 1 and y = 0 then 1 end) as fp, count(case when q = 0 and y = 0 then 1 end) as tn, count(case when q = 0 and y = 1 then 1 end) as fn from al),
k as (select unnest([0, 1]) as c),
r as (select c, count(case when y = c and q = c then 1 end) as hit, count(case when q = c then 1 end) as said, count(case when y = c then 1 end) as support from k, al group by c),
w as (select sum(case when said = 0 then 0 else hit / cast(said as double) end * support) / sum(support) as precision, sum(hit / cast(support as double) * support) / sum(support) as recall,
  sum(2 * hit / cast(said + support as double) * support) / sum(support) as f1_score from r),
bys as (select p, count(case when y = 1 then 1 end) as pos, count(case when y = 0 then 1 end) as neg from al group by 1),
rk as (select pos, neg, sum(pos) over (order by p desc) - pos as above, sum(pos) over () as np, sum(neg) over () as nn from bys),
auc as (select sum(neg * (above + pos / cast(2 as double))) / (max(np) * cast(max(nn) as double)) as auc_roc from rk),
cc as (select sum(case when a.tr then a.u * b.u end) as centroid_similarity, sum(case when not a.tr then a.u * b.u end) as test_similarity
  from cu a join cu b using (tr, d) where a.class = 0 and b.class = 1),
bl as (select greatest(sum(y), count(*) - sum(y)) / cast(count(*) as double) as baseline from al)
select '{name}' as model, '{method}' as method, {METRIC_SQL['accuracy']} as accuracy, f1_score, precision, recall, auc_roc, centroid_similarity, test_similarity, baseline from cells, w, auc, cc, bl)"""


STUDY = f"st as ({' union all '.join(study_sql(n, m) for n in MODELS for m in ('cosine', 'euclidean'))})"
STUDY_COLUMNS = ", ".join(f"round({c}, 6) as {c}" for c in ("accuracy", "f1_score", "precision", "recall", "auc_roc", "centroid_similarity", "test_similarity"))

QUERIES = {
    "class_centroids": lambda s, sf: rounded(dims(C.unit_means(vectors(s, sf), "category"), "centroid", "value")),
    "l2_normalise": lambda s, sf: rounded(dims(C.l2_normalise(vectors(s, sf)).select("prompt_id", "embedding"), "embedding", "value")),
    "scale_statistics": lambda s, sf: rounded(C.scale_statistics(vectors(s, sf)).select(
        "n", F.posexplode(F.arrays_zip("mean", "scale")).alias("d", "p")).select("n", "d", "p.mean", "p.scale")),
    "cosine_similarity": lambda s, sf: long(cosine(s, sf, "label"), "similarities", "similarity", range(10)),
    "euclidean_distance": lambda s, sf: long(euclidean(s, sf, "label"), "distances", "distance", range(10)),
    "nearest_centroid_cosine": lambda s, sf: cosine(s, sf, "label").select("prompt_id", "label", "prediction"),
    "nearest_centroid_euclidean": lambda s, sf: euclidean(s, sf, "label").select("prompt_id", "label", "prediction"),
    "softmax_probabilities": lambda s, sf: long(cosine(s, sf, "category"), "probabilities", "probability", [0, 1, 2, 3]),
    "inverse_distance_probabilities": lambda s, sf: long(euclidean(s, sf, "category"), "probabilities", "probability", [0, 1, 2, 3]),
    "similarity_margin": lambda s, sf: rounded(C.margins(cosine(s, sf)).select("prompt_id", "margin")),
    "distance_margin": lambda s, sf: rounded(C.margins(euclidean(s, sf)).select("prompt_id", "margin")),
    "margin_statistics": lambda s, sf: rounded(C.margin_statistics(C.margins(cosine(s, sf)))),
    "centroid_similarity": lambda s, sf: rounded(C.centroid_similarity(vectors(s, sf))),
    "centroid_overlap": lambda s, sf: rounded(C.overlap_index(vectors(s, sf), "category")),
    "four_centroid_signals": four_way,
    "model_comparison": lambda s, sf: rounded(S.with_mean_row(S.compare(models(s, sf))).drop("baseline")),
    "collapse_check": lambda s, sf: rounded(C.collapse_check(S.compare(models(s, sf)), F.col("baseline"))
                                            .select("model", "method", "accuracy", "auc_roc", "centroid_similarity", "collapsed")),
}
ORACLES = {
    "class_centroids": f"with {B}, {means('category')} select class, n, cast(d - 1 as integer) as d, round(u, 6) as value from cu",
    "l2_normalise": f"with {B}, {NORMED} select prompt_id, cast(d - 1 as integer) as d, round(v / nrm, 6) as value from dims join vn using (prompt_id)",
    "scale_statistics": f"with {B} select count(*) as n, cast(d - 1 as integer) as d, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as scale from dims group by d",
    "cosine_similarity": f"with {sims('label')} select prompt_id, class, round(s, 6) as similarity from sim",
    "euclidean_distance": f"with {dists('label')} select prompt_id, class, round(x, 6) as distance from dist",
    "nearest_centroid_cosine": f"with {sims('label')}, {ARGMAX} select prompt_id, label, prediction from vecs join pr using (prompt_id)",
    "nearest_centroid_euclidean": f"with {dists('label')}, {ARGMIN} select prompt_id, label, prediction from vecs join pr using (prompt_id)",
    "softmax_probabilities": f"with {sims('category')} select prompt_id, class, round(exp(s) / sum(exp(s)) over (partition by prompt_id), 6) as probability from sim",
    "inverse_distance_probabilities": f"with {dists('category')} select prompt_id, class, round((1 / (x + 1e-8)) / sum(1 / (x + 1e-8)) over (partition by prompt_id), 6) as probability from dist",
    "similarity_margin": f"with {sims('is_malicious')}, {SIM_MARGIN} select prompt_id, round(margin, 6) as margin from mg",
    "distance_margin": f"with {dists('is_malicious')}, {DIST_MARGIN} select prompt_id, round(margin, 6) as margin from mg",
    "margin_statistics": f"""with {sims('is_malicious')}, {SIM_MARGIN} select is_malicious, count(*) as n, round(avg(margin), 6) as mean_margin, round(stddev_pop(margin), 6) as std_margin,
  round(avg(case when abs(margin) < 0.01 then cast(1 as double) else 0 end) * 100, 6) as pct_near_zero from mg join vecs using (prompt_id) group by 1""",
    "centroid_similarity": f"with {B}, {means('is_malicious')} select round(sum(a.m * b.m), 6) as dot, round(sum(a.u * b.u), 6) as cosine from cu a join cu b using (d) where a.class = 0 and b.class = 1",
    "centroid_overlap": f"""with {B}, {means('category')}, pairs as (select a.class as x, b.class as y, sum(a.u * b.u) as s from cu a join cu b on a.d = b.d and a.class < b.class group by 1, 2)
select (select count(distinct class) from cu) as classes, round(avg(s), 6) as overlap from pairs""",
    "four_centroid_signals": f"""with {sims('category')}, {ARGMAX}, ms as (select prompt_id, max(s) as ms from sim where class > 0 group by 1)
select prompt_id, category, prediction, round(ms, 6) as malicious_similarity from vecs join pr using (prompt_id) join ms using (prompt_id)""",
    "model_comparison": f"""with {STUDY}, u as (select * from st union all select 'mean', method, avg(accuracy), avg(f1_score), avg(precision), avg(recall), avg(auc_roc), avg(centroid_similarity), avg(test_similarity), avg(baseline) from st group by method)
select model, method, {STUDY_COLUMNS} from u""",
    "collapse_check": f"""with {STUDY} select model, method, round(accuracy, 6) as accuracy, round(auc_roc, 6) as auc_roc, round(centroid_similarity, 6) as centroid_similarity,
  cast(centroid_similarity > cast(0.95 as double) and auc_roc < cast(0.55 as double) and accuracy < baseline as integer) as collapsed from st""",
}
