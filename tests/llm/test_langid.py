import math
from collections import Counter

import numpy as np
import pyarrow as pa

from promptsieve.llm import langid, queries
from promptsieve.llm.common import utf8

SAMPLE = [("aa", "abracadabra abra cadabra. ".encode() * 5), ("bb", "der die das dem den. ".encode() * 6),
          ("bb", "über öde ".encode() * 3)]


def plain_bits(texts, model, text):
    """Code lengths straight from counts: the longest known context, then escapes."""
    bits = []
    for lang in model.languages:
        data = b"\n".join(t for l, t in texts if l == lang) + b"\n"
        counts = Counter(data[i:i + k] for k in range(1, model.depth + 2) for i in range(len(data) - k + 1))
        every = Counter()
        for l in model.languages:
            d = b"\n".join(t for x, t in texts if x == l) + b"\n"
            for k in range(1, model.depth + 1):
                for g, n in Counter(d[i:i + k] for i in range(len(d) - k + 1)).items():
                    every[g] = max(every[g], n)
        total = 0.0
        for i in range(len(text)):
            known = next(k for k in range(min(i, model.depth), -1, -1) if k == 0 or every[text[i - k:i]] >= 2)
            for k in range(known, -2, -1):
                if k < 0:
                    total += 8
                    break
                context = text[i - k:i]
                followers = {g[-1:]: n for g, n in counts.items() if len(g) == k + 1 and g[:-1] == context}
                t, q = sum(followers.values()), len(followers)
                if not q:
                    continue
                if (n := followers.get(text[i:i + 1])):
                    total -= math.log2(n / (t + q))
                    break
                total += math.log2((t + q) / q)
        bits.append(total)
    return bits


def test_code_lengths_are_exact_across_chunks():
    model = langid.train(SAMPLE, depth=3)
    texts = ["abra die das", "xyz über 42", "", "dem den abracadabra " * 3]
    data, offsets = utf8(pa.array(texts))
    for chunk in (7, 256):
        got = langid.code_lengths(model, data, offsets, chunk)
        want = [plain_bits(SAMPLE, model, t.encode()) for t in texts]
        assert np.allclose(got, want, atol=1e-3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_ppm_language(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.filter("held_out").join(truth, "doc_id").filter("lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_number_signs_are_no_letters(spark):
    model = langid.train(SAMPLE)
    rows = spark.createDataFrame([(1, "½ ² ① 42 Ⅷ"), (2, "½ a"), (3, "ª"), (4, "中"), (5, "_ \u0301")], "doc_id long, text string")
    for own in (model, None):
        got = {r.doc_id for r in langid.accepted(rows, own, most_bits=99.0).collect()}
        assert got == {2, 3, 4}
    assert {r.doc_id for r in langid.predictions(rows, model).collect() if r.lang_pred == "und"} == {1, 5}


def test_odd_rows(odd, none, odd_rows):
    from pyspark.sql import functions as F

    model = langid.train(langid.sample(odd, F.lit(True)))
    assert model.languages == ["de", "en", "fr"]
    got = {r.doc_id: r for r in langid.predictions(odd, model).collect() if r.doc_id is not None}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 4))
    assert got[8].lang_pred == "en"
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and kept.filter("doc_id in (1, 2, 3, 4)").count() == 0
    assert kept.filter("doc_id in (5, 6, 7, 8)").count() == 5
    assert langid.train(langid.sample(none, F.lit(True))) is None
    assert {r.lang_pred for r in langid.predictions(odd, None).collect()} == {"und"}
    assert langid.predictions(none, model).count() == 0 and langid.accepted(none, None).count() == 0


def test_every_context_seen_twice_is_kept_at_any_number_of_languages():
    texts = [(f"l{i:02d}", (f"{chr(97 + i)}b{chr(300 + 7 * i)} die {i} zeile {chr(98 + i)}{i * i} " * 4).encode()) for i in range(19)]
    model = langid.train(texts, depth=3)
    assert len(model.groups) == 3
    twice, occurring = set(), {}
    for lang, text in texts:
        data = text + b"\n"
        counts = Counter(data[i:i + k] for k in range(1, 4) for i in range(len(data) - k + 1))
        twice |= {g for g, n in counts.items() if n >= 2}
        occurring[lang] = set(counts)
    for trees in model.groups:
        here = set().union(*(occurring[l] for l in model.languages[trees.languages]))
        assert len(trees.shorter) == 1 + len(twice & here)
    data, offsets = utf8(pa.array(["die 7 zeile", "ab die ßx"]))
    got = langid.code_lengths(model, data, offsets)
    assert np.allclose(got, [plain_bits(texts, model, t.encode()) for t in ("die 7 zeile", "ab die ßx")], atol=1e-3)
    assert np.allclose(got, langid.code_lengths(langid.train(texts, depth=3, group=5), data, offsets))


def test_the_sample_has_every_language(spark):
    rows = spark.createDataFrame([(i, f"l{i % 300}", f"text {i} " * 20) for i in range(900)], "doc_id long, lang string, text string")
    picked = langid.sample(rows, rows.doc_id >= 0, total_bytes=300 * 150)
    assert len({lang for lang, _ in picked}) == 300
    assert sum(len(text) for _, text in picked) <= 300 * (150 + 180)
