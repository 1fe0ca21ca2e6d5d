import random

import numpy as np
from pyspark.sql import functions as F

from promptsieve.llm import queries, toxicity


def test_held_out_ranking_and_threshold(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_compression_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = got.filter("held_out").collect()
    score, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    order = np.argsort(np.argsort(score))
    auc = (order[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    hit = score >= 0.5
    # 352 toxic texts to learn from, and labels with noise; over the larger tables the area is above 0.99.
    assert auc > 0.88 and hit[y == 1].mean() > 0.5 and hit[y == 0].mean() < 0.03
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_windows_cover_every_word():
    texts = [b"", b"one", b" a b\tc\nd e f g h i j k l m ", b"x" * 1000]
    buffer, begin, end, owner = toxicity.windows(texts, 8, 4)
    for i, text in enumerate(texts):
        seen = {w for b, e in zip(begin[owner == i], end[owner == i]) for w in buffer[b:e].split()}
        assert seen == set(text.split())


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, "x"), (6, 0, "x"), (8, 0, "x"), (11, None, "x"), (None, 1, "x"), (10, 1, "x")],
                                   "doc_id long, toxic int, score string")
    sample = toxicity.sample(odd, labels, F.lit(True))
    assert sorted(y for y, _ in sample) == [0, 0, 0, 1, 1]
    got = toxicity.scores(odd, toxicity.train(sample)).collect()
    assert len(got) == odd.count() and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert {r.score for r in toxicity.scores(odd, toxicity.train([(0, b"only one label")])).collect()} == {0.0}
    assert toxicity.scores(none, None).count() == 0 and toxicity.train(toxicity.sample(none, labels, F.lit(True))) is None


def test_sample_is_bounded_by_bytes_before_it_is_read(spark):
    docs = spark.createDataFrame([(i, f"{i:04d} " * 200) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    whole = toxicity.sample(docs, labels, F.lit(True))
    bounded = toxicity.sample(docs, labels, F.lit(True), max_bytes=4500)
    assert len(whole) == 60
    for label in (0, 1):
        mine = [t for y, t in whole if y == label]
        assert [t for y, t in bounded if y == label] == mine[:5]  # the fifth begins below the bound


def test_rare_telling_words_enter_beside_a_dominant_one():
    pick = random.Random(6)
    plain = [f"plain{pick.randrange(10**6)}" for _ in range(500)]
    own = lambda n: [pick.choice(plain) for _ in range(n)]
    rare = [f"{a}{b}vile" for a in "bdfgk" for b in ("ar", "el", "im", "on", "uz", "yp", "ac", "ed")]
    toxic = [" ".join([*own(20), "dominant" if i % 2 else rare[i // 2 % 40], *own(20)]).encode() for i in range(1600)]
    ordinary = [" ".join(own(41)).encode() for _ in range(2000)]
    found = toxicity.telling(toxic, ordinary)
    assert all(f" {w}"[:5].encode() in found for w in [*rare, "dominant"])
