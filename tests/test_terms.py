"""Term counts and word measures against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from promptsieve.functions import grams as G
from promptsieve.functions import text as X
from promptsieve.operators import features as FX
from promptsieve.operators import tfidf as TF

TEXTS = [None, "", " ", "One two one TWO one two", "a aa aaa aaaa", "naïve Ünïcode 🙂🙂 x_y 12", "\x85left right",
         " ".join(f"w{i % 7}" for i in range(130)), "one\ttwo"]


def char_grams(text):
    return [p[i:i + n] for w in (text or "").lower().split() for p in [f" {w} "] for n in (3, 4, 5) for i in range(len(p) - n + 1)]


@pytest.mark.parametrize("held", [1, 10, 1 << 18])
def test_totals_in_parts_equal_a_full_count(spark, held):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string").repartition(2)
    words = lambda t: t.split(" ") if t else []
    pairs = lambda t: words(t) + [" ".join(p) for p in zip(words(t), words(t)[1:])]
    for sizes, terms in (((3, 4, 5), char_grams), (None, pairs)):
        rows = G.term_totals(frame, sizes, held).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).collect()
        tf, df = Counter(), Counter()
        for t in TEXTS:
            tf.update(terms(t))
            df.update(set(terms(t)))
        assert {r.term: (r.tf, r.df) for r in rows} == {k: (n, df[k]) for k, n in tf.items()}


def test_equal_grams_leave_python_once_a_task(spark):
    """A task sent one row for each gram of each text, and held a batch's as Python objects."""
    frame = spark.createDataFrame([("the same words again and again",)] * 500, "prompt_text string").coalesce(1)
    parts = G.term_totals(frame, (3, 4, 5))
    grams = set(char_grams("the same words again and again"))
    assert parts.count() == len(grams)
    assert "Generate" not in TF.term_statistics(frame, "char")._jdf.queryExecution().executedPlan().toString()


def test_grams_of_a_vocabulary_by_position(spark):
    vocabulary = sorted({" on", "one", "aaa", "a aa", "zzz"})
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    frame = frame.unionByName(spark.range(100, 900).select(F.col("id").cast("int").alias("i"), F.lit("one on aaaa").alias("t"))).coalesce(1)
    got = dict(frame.select("i", G.word_bound_counts(F.col("t"), vocabulary=vocabulary)).collect())
    every = dict(frame.select("i", G.word_bound_counts(F.col("t"))).collect())
    for i, t in [*enumerate(TEXTS), (100, "one on aaaa"), (899, "one on aaaa")]:
        counts = Counter(char_grams(t))
        assert {r.term: r.tf for r in every[i]} == counts
        assert [(r.term, r.tf) for r in got[i]] == [(k, counts[v]) for k, v in enumerate(vocabulary) if v in counts]


def test_word_measures_equal_plain_python(spark):
    lists, phrases = [["one", "w1"], ["two"]], ["one two", "w0 w1 w2"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = dict(frame.select("i", G.word_measures(F.col("t"), (50, 4), lists, phrases)).collect())
    for i, t in enumerate(TEXTS):
        if t is None:
            assert got[i] is None
            continue
        w = t.split(" ") if t else []
        counts, pairs, triples = Counter(w), list(zip(w, w[1:])), list(zip(w, w[1:], w[2:]))
        want = [len(counts), sum(n == 1 for n in counts.values()), sum(n * math.log2(n) for n in counts.values()), len(set(pairs)), len(set(triples)),
                pairs.count(("one", "two")), triples.count(("w0", "w1", "w2"))]
        for size in (50, 4):
            parts = [len(set(w[s:s + size])) / size for s in range(0, len(w) - size + 1, size // 2)]
            want.append(sum(parts) / len(parts) if parts else len(counts) / max(len(w), 1))
        want += [sum(w.count(x) for x in m) for m in lists]
        assert got[i] == pytest.approx(want)


def test_word_features_sort_no_words(spark):
    """Distinct words, pairs and windows came from sorted arrays and regular expressions over them."""
    frame = spark.createDataFrame([(1, "One two one"), (2, None), (3, "")], "prompt_id long, prompt_text string")
    found = FX.features(frame, ["entropy_diversity", "linguistic"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and "array_distinct" not in plan
    rows = {r.prompt_id: r for r in found.collect()}
    assert rows[1].unique_word_ratio == pytest.approx(2 / 3) and rows[1].hapax_ratio == 0.5 and rows[1].sliding_ttr_50 == pytest.approx(2 / 3)
    assert rows[2].unique_word_ratio is None and rows[2].hapax_ratio == 0 and rows[3].sliding_ttr_50 == 0 == rows[3].word_entropy


def test_measures_keep_the_digits_of_column_expressions(spark):
    """Rounding to six digits showed sums taken in another order."""
    frame = spark.createDataFrame([(" ".join(f"w{(i * i + k) % 97 % (11 + k % 60)}" for i in range(200 + k)),) for k in range(60)], "t string")
    words = F.split("t", " ")
    found = frame.select(F.get(G.word_measures(F.col("t")), F.lit(2)).alias("got"), X.log_mass(X.word_runs(words)).alias("want")).collect()
    assert all(r.got == r.want for r in found)


def test_packed_grams_equal_plain_ones(spark, monkeypatch):
    """Grams were Python strings, counted one by one."""
    rng = random.Random(3)
    kinds = ["ab", "abc \t", "éß\x00x ", "".join(map(chr, range(0x4E00, 0x4E00 + 9000))) + " ", "🙂x  İΣ"]
    texts = [None, "", "\x00 a\x00", *("".join(rng.choices(kinds[i % 5], k=rng.randint(0, 400))) for i in range(200)),
             kinds[3], " ".join(kinds[3]), "ab cd " * 300]
    every = Counter(g for t in texts for g in char_grams(t))
    common = [g for g, _ in every.most_common(500)] + ["b a", "a", "abcdef"]
    for chars in (64, 1 << 20):
        monkeypatch.setattr(G, "CHARS", chars)
        parts = [b.to_pylist() for b in totals_of(G, texts)]
        tf, df = Counter(), Counter()
        for r in (r for part in parts for r in part):
            tf[r["term"]] += r["tf"]
            df[r["term"]] += r["df"]
        assert tf == every and df == Counter(g for t in texts for g in set(char_grams(t)))
        frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
        for vocabulary in (common[:3], [g for g in common if max(g) < "一"], common, ["zz9"], ["b a"]):
            got = dict(frame.select("i", G.word_bound_counts(F.col("t"), vocabulary=vocabulary)).collect())
            for i, t in enumerate(texts):
                counts = Counter(char_grams(t))
                assert [(r.term, r.tf) for r in got[i]] == [(k, counts[v]) for k, v in enumerate(vocabulary) if v in counts]


def totals_of(module, texts):
    """The parts that a task of ``term_totals`` sends."""
    import pyarrow as pa

    class Rows:
        def mapInArrow(self, function, schema):
            return function(pa.RecordBatch.from_arrays([pa.array(texts[i:i + 7], pa.string())], names=["t"]) for i in range(0, len(texts), 7))

    return list(module.term_totals(Rows(), (3, 4, 5), held=1 << 10))


def test_grams_are_counted_without_a_python_object_each(monkeypatch):
    monkeypatch.setattr(G, "_word_bound", None)
    rows = [r for part in totals_of(G, ["One two", "two"]) for r in part.to_pylist()]
    assert {r["term"]: (r["tf"], r["df"]) for r in rows} == {
        g: (n, 2 if g in char_grams("two") else 1) for g, n in Counter(char_grams("One two two")).items()}


@pytest.mark.parametrize("held", [20, 1 << 20])
def test_frequent_terms_equal_a_full_count(spark, monkeypatch, held):
    """All pairs were shuffled as strings, though most occur once."""
    rng = random.Random(5)
    texts = [None, "", "x", " .", *(" ".join(f"wé{int(rng.paretovariate(0.9))}" for _ in range(rng.randint(0, 60))) for _ in range(300))]
    frame = spark.createDataFrame([(t,) for t in texts], "prompt_text string").repartition(3)
    plain = TF.term_hashes
    monkeypatch.setattr(TF, "term_hashes", lambda rows, sent: plain(rows, held, sent))
    every = {r.term: (r.tf, r.df) for r in TF.term_statistics(frame).collect()}
    ranked = sorted(every, key=lambda t: (-every[t][0], t))
    hashes = plain(TF._joined_tokens(frame), held).groupBy("hash").agg(F.sum("n").alias("n")).collect()
    missed = next(r.n for r in hashes if r.hash is None)
    assert (missed > 0) == (held == 20)
    assert sum(r.n for r in hashes if r.hash is not None) <= sum(tf for tf, _ in every.values())
    for k in (1, 7, 100, 100_000):
        got = TF.vocabulary(frame, k).collect()
        assert [(r.term, r.tf, r.df) for r in got] == [(t, *every[t]) for t in ranked[:k]]
    assert TF.frequent_terms(frame, 7).count() < len(every) / 2


def test_terms_that_share_a_hash_are_told_apart(spark, monkeypatch):
    texts = ["aa bb cc dd"] * 5 + ["aa bb cc"] * 3 + ["aa ee"] * 4
    frame = spark.createDataFrame([(t,) for t in texts], "prompt_text string").coalesce(1)
    plain = G._hashed_words

    def few(some, powers):
        raw, kinds = plain(some, powers)
        return raw, [(kind[0] % 3, *kind[1:]) for kind in kinds]

    every = {r.term: (r.tf, r.df) for r in TF.term_statistics(frame).collect()}
    ranked = sorted(every, key=lambda t: (-every[t][0], t))
    monkeypatch.setattr(G, "_hashed_words", few)
    for k in (1, 4, len(ranked) + 1):
        assert [(r.term, r.tf, r.df) for r in TF.vocabulary(frame, k).collect()] == [(t, *every[t]) for t in ranked[:k]]
