import math
import random

import pytest
from pyspark.sql import functions as F

from promptsieve.functions.hashing import stratified_rank
from promptsieve.operators import adapt as A
from promptsieve.operators import compare as CP
from promptsieve.operators import evaluate as E
from promptsieve.operators import keywords as KW
from promptsieve.operators import learn as LN
from promptsieve.operators import prepare as PR
from promptsieve.operators import tfidf as TF
from promptsieve.sources import tables
from promptsieve.streaming import feedback as SF


def test_published_confusion_cells(spark):
    cells = spark.createDataFrame([(383, 193, 57763, 86230)], "tp long, fp long, tn long, fn long")
    row = E.with_metrics(cells).first()
    want = {"balanced_accuracy": 0.5005459282, "f1": 0.0087855119, "mcc": 0.0084942369, "precision": 0.6649305556,
            "recall": 0.0044219690, "fpr": 0.0033301125, "fnr": 0.9955780310}
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=5e-10)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    # A third of the rows share one score.
    rows = [(i, int(rng.random() < 0.4), 0.5 if i % 3 == 0 else round(rng.random(), 3)) for i in range(900)]
    return rows, spark.createDataFrame(rows, "prompt_id long, is_malicious int, score double")


def test_ranking_metrics_with_a_hot_score(scored):
    rows, frame = scored
    pos = [s for _, y, s in rows if y]
    neg = [s for _, y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    for buckets in (2, 16, 300, None):
        rank = E.ranked(frame, buckets=buckets)
        got = E.ranking_metrics(rank).first()
        assert got["roc_auc"] == pytest.approx(auc)
        ap, tp, seen = 0.0, 0, 0
        for s in sorted({s for _, _, s in rows}, reverse=True):
            here = [y for _, y, v in rows if v == s]
            tp, seen = tp + sum(here), seen + len(here)
            ap += sum(here) / len(pos) * tp / seen
        assert got["average_precision"] == pytest.approx(ap)
        curve = sorted((r["fpr"], r["tpr"]) for r in E.roc_curve(rank).collect())
        assert curve[0] == (0.0, 0.0) and curve[-1] == (1.0, 1.0)
        assert all(a[1] <= b[1] + 1e-12 for a, b in zip(curve, curve[1:]))


def test_sweep_counts_and_partition_invariance(scored):
    rows, frame = scored
    few = {r["threshold"]: r for r in E.threshold_sweep(frame.coalesce(1)).collect()}
    many = {r["threshold"]: r for r in E.threshold_sweep(frame.repartition(32)).collect()}
    assert few == many and len(few) == 50
    for t, r in few.items():
        assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == len(rows)
        assert r["tp"] == sum(y == 1 and s >= t for _, y, s in rows)
    assert E.calibration_error(frame.withColumn("score", F.lit(1.0))).first()["n_binned"] == 0
    assert E.calibration_error(frame.withColumn("score", F.lit(1.0)), closed=True).first()["n_binned"] == len(rows)


def test_constrained_optimum_falls_back_to_smallest_fnr(scored):
    sweep = E.threshold_sweep(scored[1])
    assert E.constrained_optimum(sweep, max_fnr=-1.0).first()["fnr"] == sweep.agg(F.min("fnr")).first()[0]


def test_bootstrap_interval_holds_the_estimate(scored):
    _, frame = scored
    cells = E.confusion(frame, (F.col("score") >= 0.5).cast("int"))
    value = E.with_metrics(cells).first()["balanced_accuracy"]
    row = LN.bootstrap_interval(cells, 200).first()
    assert row["low"] <= value <= row["high"] and row["high"] - row["low"] < 0.2


def test_splits_are_disjoint_exhaustive_and_stratified(spark):
    ids = spark.range(1000).select(F.col("id").alias("prompt_id"), (F.col("id") % 10 < 3).cast("int").alias("is_malicious"))
    ranks = stratified_rank(ids, ["is_malicious"]).groupBy("is_malicious").agg(
        F.count_distinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).collect()
    assert {(r["is_malicious"], r["d"], r["lo"], r["hi"]) for r in ranks} == {(0, 700, 1, 700), (1, 300, 1, 300)}
    split = PR.stratified_split(ids, {"train": 0.8, "val": 0.1, "test": 0.1})
    counts = {(r["split"], r["is_malicious"]): r["count"] for r in split.groupBy("split", "is_malicious").count().collect()}
    assert counts[("train", 0)] == 560 and counts[("test", 1)] == 30 and sum(counts.values()) == 1000
    folds = PR.stratified_folds(ids, 5).groupBy("fold", "is_malicious").count().collect()
    assert {r["count"] for r in folds} == {140, 60}
    assert PR.stratified_sample(ids, 100).groupBy("is_malicious").count().collect().__len__() == 2
    assert PR.hash_split(ids, {"a": 0.5, "b": 0.5}).groupBy("split").count().collect().__len__() == 2


def test_class_guard(spark):
    with pytest.raises(ValueError):
        PR.require_two_classes(spark.createDataFrame([], "is_malicious int"))
    with pytest.raises(ValueError):
        PR.require_two_classes(spark.createDataFrame([(1,), (1,)], "is_malicious int"))
    counts = PR.require_two_classes(spark.createDataFrame([(1,), (0,), (0,)], "is_malicious int"))
    assert {tuple(r) for r in counts.collect()} == {(0, 2), (1, 1)}


def test_column_inference(spark):
    frame = spark.createDataFrame([(1, "aa", "long text here"), (2, "aa", "another text")], "k int, tag string, body string")
    assert PR.infer_columns(frame, exact=True) == ("tag", "body")
    assert PR.infer_columns(frame.withColumnRenamed("k", "label").withColumnRenamed("tag", "prompt")) == ("label", "prompt")


def test_duplicates_and_reconciliation(spark):
    rows = [(1, "same", 0), (2, "same", 1), (3, "same", 1), (4, "tie", 0), (5, "tie", 1), (6, "own", 0)]
    frame = spark.createDataFrame(rows, "prompt_id long, prompt_text string, is_malicious int")
    assert {(r[0], r[1]) for r in PR.drop_duplicates(frame).collect()} == {(1, 3), (4, 2), (6, 1)}
    fixed = {r["prompt_id"]: r["reconciled"] for r in PR.reconcile_labels(frame).collect()}
    assert fixed == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0}


def test_caps(spark):
    assert PR.shared_caps({"a": 200, "b": 1100, "c": 11383, "d": 15140}) == {"a": 200, "b": 1100, "c": 4350, "d": 4350}


def test_tfidf_rows_have_unit_length_and_char_grams_stay_inside_words(spark):
    frame = spark.createDataFrame([(1, "The cat sat on the mat"), (2, "A b cat"), (3, "")], "prompt_id long, prompt_text string")
    for analyzer in ("word", "char"):
        model = TF.TfidfModel.fit(frame, 50, analyzer)
        sizes = model.long(frame).groupBy("prompt_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
        assert {r["prompt_id"] for r in sizes} == {1, 2} and all(r["s"] == pytest.approx(1.0) for r in sizes)
    grams = {r["term"]: r["tf"] for r in TF.term_statistics(frame, "char").collect()}
    assert grams[" cat "] == 2 and grams["the"] == 2 and " a " in grams and not any(" " in g[1:-1] for g in grams)


def simple_fold(steps, alpha, thr=0.55, ema=0.05):
    out = []
    for fp in steps:
        ema = alpha * fp + (1 - alpha) * ema
        thr = min(0.8, max(0.3, thr - alpha * (ema - 0.05)))
        out.append((ema, thr))
    return out


@pytest.mark.parametrize("block", [3, 128])
@pytest.mark.parametrize("alpha", [0.001, 0.9])
def test_blocked_fold_equals_plain_fold(spark, block, alpha):
    rng = random.Random(5)
    fps = {s: [rng.random() for _ in range(n)] for s, n in ((1, 40), (2, 1))}
    rows = [(s, 7 * i, fp, 0.5, 0.5, 0.5, 10) for s, v in fps.items() for i, fp in enumerate(v)]
    windows = spark.createDataFrame(rows, "stream_id long, win long, fp_rate double, component_1 double, component_2 double, component_3 double, n long")
    got = A.adaptive_path(windows, alpha=alpha, block=block).orderBy("stream_id", "win").collect()
    for s, v in fps.items():
        path = [(r["fp_ema"], r["threshold"]) for r in got if r["stream_id"] == s]
        for a, b in zip(path, simple_fold(v, alpha), strict=True):
            assert a == pytest.approx(b)
    assert all(r["weight_1"] + r["weight_2"] + r["weight_3"] == pytest.approx(1.0) for r in got)


def test_drift_keeps_only_recent_scores(spark):
    rng = random.Random(1)
    rows = [(1 if i % 3 else 2, i, 86400 * (i // 17), rng.random()) for i in range(300)]
    frame = spark.createDataFrame(rows, "stream_id long, event_id long, sec long, score double").withColumn(
        "ts", F.timestamp_seconds("sec").cast("timestamp_ntz"))
    got = {(r["stream_id"], r["win"]): r for r in A.drift(frame, last=25).collect()}
    for (s, w), r in got.items():
        mine = [v for a, _, sec, v in rows if a == s and sec // 86400 <= w][-25:]
        assert r["n_recent"] == len(mine) and r["recent_mean"] == pytest.approx(sum(mine) / len(mine))


def test_stream_equals_batch(spark, sf):
    from checks.stream_checks import feedback_stream
    from promptsieve.sources import tables as T

    live = SF.replay(spark, feedback_stream(spark, sf))
    batch = A.adaptive_path(A.feedback_windows(T.feedback(spark, sf)))
    joined = live.alias("a").join(batch.alias("b"), ["stream_id", "win"], "left")
    gap = joined.agg(F.max(F.abs(F.col("a.threshold") - F.col("b.threshold"))).alias("t"),
                     F.max(F.abs(F.col("a.weight_3") - F.col("b.weight_3"))).alias("w"), F.count("*").alias("n")).first()
    assert gap["n"] > 100 and gap["t"] < 1e-12 and gap["w"] < 1e-12


def test_governor_and_rollback(spark):
    rows = [(1, w, 0, 1, 1, 0, 2, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0) for w in range(6)]
    folder = SF.shared_folder(spark, "test")
    spark.createDataFrame(rows, SF.WINDOWS).coalesce(1).write.parquet(folder + "/in")
    windows = spark.readStream.schema(SF.WINDOWS).parquet(folder + "/in")
    out = SF.run_to_end(SF.adapt_stream(windows, seconds=300, cooldown=600), folder + "/a").orderBy("win").collect()
    assert [r["updated"] for r in out] == [1, 0, 1, 0, 1, 0]
    back = SF.run_to_end(SF.adapt_stream(windows, seconds=600, rollback_error=0.5), folder + "/b").collect()
    assert {r["threshold"] for r in back} == {0.55}


def test_ablation_findings(spark):
    rows = [("full", 10, 0.8, 0.7), ("no_a", 8, 0.9, 0.75), ("no_b", 5, 0.7, 0.6)]
    frame = spark.createDataFrame(rows, "experiment string, total_features int, accuracy double, f1 double")
    got = {r["finding"]: r["experiment"] for r in CP.ablation_findings(frame).collect()}
    assert got == {"largest_f1_decrease": "no_b", "smallest_f1_decrease": "no_a", "best_accuracy": "no_a",
                   "best_f1": "no_a", "best_tradeoff": "no_a"}


def test_calibrator_is_monotone(spark):
    rng = random.Random(2)
    rows = [(i, int(rng.random() < i / 300), i / 300, i % 3) for i in range(300)]
    frame = spark.createDataFrame(rows, "prompt_id long, is_malicious int, score double, fold int")
    out = [r["calibrated"] for r in LN.Calibrator.fit(frame).transform(frame).orderBy("score").collect()]
    assert all(a <= b + 1e-12 for a, b in zip(out, out[1:])) and 0 <= out[0] and out[-1] <= 1 and not math.isnan(out[0])


@pytest.fixture(scope="module")
def holey(spark):
    """A quarter of the rows has no category."""
    return spark.range(1000).select(
        F.col("id").alias("prompt_id"), (F.col("id") % 10).alias("is_malicious"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("c"), F.col("id") % 4)).alias("attack_category"))


def test_null_strata_are_kept(holey):
    strata = ["is_malicious", "attack_category"]
    split = PR.stratified_split(holey, {"train": 0.8, "val": 0.1, "test": 0.1}, strata)
    assert split.count() == 1000 and split.columns == [*holey.columns, "split"]
    folds = PR.stratified_folds(holey, 5, ["attack_category"]).groupBy("attack_category", "fold").count().collect()
    assert len(folds) == 20 and {r["count"] for r in folds} == {50}
    assert PR.stratified_sample(holey, 100, ["attack_category"]).groupBy("attack_category").count().count() == 4


def test_downsampling_keeps_rows_without_category(holey):
    assert PR.downsample_category(holey, "nowhere", 0.2).count() == 1000
    kept = {r["attack_category"]: r["count"] for r in PR.downsample_category(holey, "c1", 0.0).groupBy("attack_category").count().collect()}
    assert kept == {None: 250, "c2": 250, "c3": 250}


def test_datasets_without_a_cap_stay_whole(holey):
    ids = holey.select(F.col("attack_category").alias("dataset"), F.col("prompt_id").alias("item_id"))
    kept = {r["dataset"]: r["count"] for r in PR.cap_datasets(ids, {"c1": 10}).groupBy("dataset").count().collect()}
    assert kept == {None: 250, "c1": 10, "c2": 250, "c3": 250}
    assert PR.cap_datasets(ids, 7).count() == 28


def test_the_class_guard_counts_every_class(holey):
    counts = {r["is_malicious"]: r["n"] for r in PR.require_two_classes(holey).collect()}
    assert counts == {i: 100 for i in range(10)}
    with pytest.raises(ValueError):
        PR.require_two_classes(holey.where("is_malicious = 1"))
    with pytest.raises(ValueError):
        PR.require_two_classes(holey.limit(0))


def test_null_embeddings_give_null_and_wrong_ones_raise(spark):
    from promptsieve.operators import centroids as C

    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, None, 1), (4, [None, 1.0], 0), (5, [0.9, 0.1], 0)]
    frame = spark.createDataFrame(rows, "prompt_id long, embedding array<double>, label int").coalesce(1)
    model = C.CentroidModel.fit_cosine(frame.where("prompt_id in (1, 2)"), "label")
    got = {r["prompt_id"]: r["similarities"] for r in C.score_cosine(frame, model).collect()}
    assert got[3] is None and got[4] is None and got[1] == [1.0, 0.0] and got[5][0] == pytest.approx(0.9939, abs=1e-3)
    ragged = spark.createDataFrame([(1, [1.0, 0.0, 0.0], 0)], frame.schema)
    with pytest.raises(Exception, match="vectors of 2 dimensions"):
        C.score_cosine(ragged, model).collect()


def test_the_buffer_drops_old_hours_before_ranking(spark):
    feedback = spark.range(30_000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).alias("stream_id"), F.col("id").alias("event_id"),
        F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    got = A.feedback_buffer(feedback, size=5000, minimum=100)
    newest = {r["stream_id"]: (r["n"], r["least"]) for r in got.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least")).collect()}
    rows = [(0 if i % 3 < 2 else i % 7, i) for i in range(30_000)]
    for stream in range(7):
        ids = sorted(i for s, i in rows if s == stream)[-5000:]
        assert newest[stream] == (len(ids), ids[0])
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_scorer_judges_every_external_set(spark, sf, monkeypatch):
    from types import SimpleNamespace

    from checks import data_checks, model_checks

    stand_in = SimpleNamespace(detect=lambda frame: frame.withColumn("pred", F.lit(1)))
    monkeypatch.setattr(model_checks, "_screener", lambda *_: stand_in)
    got = {r["dataset"]: r["n"] for r in model_checks.scored_cross_dataset(spark, sf).collect()}
    want = {r["dataset"]: r["count"] for r in data_checks.external(spark, sf).groupBy("dataset").count().collect()}
    assert len(want) == 4 and got == {**want, "missing": 0}


def test_load_prompts(spark, tmp_path):
    rows = [("7", None, True, "x", 1), ("8", "b", False, None, 2), (None, "c", None, "y", 3)]
    path = str(tmp_path / "prompts")
    spark.createDataFrame(rows, "prompt_id string, prompt_text string, is_malicious boolean, kind string, other long").write.json(path)
    schema = dict(fmt="json", category_col="kind")
    got = {(r.prompt_id, r.prompt_text, r.is_malicious, r.attack_category) for r in tables.load_prompts(spark, path, **schema).collect()}
    assert got == {(7, "", 1, "x"), (8, "b", 0, None), (None, "c", None, "y")}
    by_kind = tables.load_prompts(spark, path, fmt="json", label_col="kind", malicious=["y"])
    assert {(r.prompt_id, r.is_malicious) for r in by_kind.collect()} == {(7, 0), (8, None), (None, 1)}
    assert by_kind.columns == ["prompt_id", "prompt_text", "is_malicious"]


def test_keyword_scores_by_lookup_and_by_join(spark):
    texts = {1: "Ignore all ignore rules", 2: "", 3: None, 4: "  \t ", 5: "nothing known here", 6: "rules " * 3000}
    frame = spark.createDataFrame(list(texts.items()), "prompt_id long, prompt_text string")
    known = {"ignore": 0.9, "rules": 0.25, "unused": 4.0}
    weights = spark.createDataFrame(list(known.items()), "word string, weight double")
    for most in (1 << 20, 0):
        scored = KW.score_keywords(frame, weights, lookup_bytes=most)
        got = {r.prompt_id: r.keyword_score for r in scored.collect()}
        for i, text in texts.items():
            words = (text or "").lower().split()
            mean = sum(known.get(w, 0.0) for w in words) / len(words) if words else None
            assert got[i] == pytest.approx(1 / (1 + math.exp(-10 * (mean - 0.1))) if words else 0.0)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan or "hashpartitioning(word" in plan) <= (most == 0)
    assert KW.score_keywords(frame, weights.limit(0)).where("keyword_score > 0.3").count() == 0
