import random

import brute
import pytest
from pyspark.sql import functions as F

from promptsieve.llm import graph, jaccard


@pytest.mark.parametrize("n, num", [(4, 85), (5, 80)])
def test_components(spark, documents, texts, n, num):
    want = brute.linked(texts.items(), n, num, 100)
    got = jaccard.classes(documents, n, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(texts)


def test_a_large_family_of_near_copies(spark):
    pick = random.Random(3)
    base = [f"w{pick.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(pick.randrange(6)):
            words[pick.randrange(150)] = f"v{pick.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    rows += [(150 + i, " ".join(f"u{pick.randrange(10_000)}" for _ in range(60)) + " " + " ".join(base[:20])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, 4, 85, 100).collect()}
    assert got == brute.linked(rows, 4, 85, 100)


def test_paths_and_stars_contract(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5000, 5001), (5001, 5000)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.component, set()).add(r.node)
    assert sorted(map(len, parts.values())) == [2, 40, 61]


def test_odd_rows(odd, none, odd_rows):
    got = jaccard.classes(odd, 4, 85, 100).select("doc_id", "n_shingles", "component_id").collect()
    assert len(got) == len(odd_rows)
    assert sorted(r.component_id for r in got if r.doc_id in (5, 6, 7)) == [5, 5, 5, 5]
    assert {(r.n_shingles, r.component_id) for r in got if r.doc_id in (1, 2, 3)} == {(0, 1), (0, 2), (0, 3)}
    assert [r.n_shingles for r in got if r.doc_id == 11] == [1]
    kept = jaccard.deduplicated(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(odd_rows) - 3 and kept.filter(F.col("doc_id").isin(5, 6, 7)).count() == 1
    assert jaccard.classes(none).count() == 0 and jaccard.deduplicated(none).count() == 0
