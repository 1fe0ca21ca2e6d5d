import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from promptsieve.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END]


def checked(rows, texts, ids):
    """Every id is in exactly one piece, sequences are gapless, and only the last is short."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for i, pieces in by_doc.items():
        want, at = ids(texts[i]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(want[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    for s, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == packing.LENGTH or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_query_rows(spark, sf, texts, ids):
    checked(queries.op9_hilbert_packing(spark, sf).collect(), texts, ids)


def test_curve_visits_every_cell_by_steps_of_one():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * dimensions)
        points = np.column_stack([a.ravel() for a in axes])
        keys = packing.hilbert_keys(points, bits)
        assert sorted(keys) == list(range(1 << bits * dimensions))
        path = points[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_copies_are_neighbours(spark):
    kinds = ("apples pears plums ", "the quick brown fox ", "sorting and packing documents ")
    rows = [(i, kinds[i % 3] * 30) for i in range(60)]
    got = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), PATH, length=1 << 30).collect()
    order = [r.doc_id % 3 for r in sorted(got, key=lambda r: r.offset)]
    assert sum(a != b for a, b in zip(order, order[1:])) == 2


def test_odd_rows(odd, none, odd_rows, ids):
    from pyspark.sql import functions as F

    got = packing.pieces(odd, PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert sum(r.length for r in got) == sum(len(ids(t)) for _, t, *_ in odd_rows)
    once = {i: t for i, t, *_ in odd_rows if i not in (None, 6)}
    assert {r.doc_id for r in got if r.doc_id in once} == once.keys()
    assert len([r for r in got if r.doc_id == 6]) >= 2
    assert packing.pieces(none, PATH).count() == 0
