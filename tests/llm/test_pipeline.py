import zlib

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from promptsieve.llm import langid, pii
from promptsieve.llm.common import written


def test_stages_against_brute_force(spark, sf, documents, texts):
    stages = dict(corpus_pipeline.STAGES)
    docs = documents
    kept = stages["language"](spark, docs, sf)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns
    assert {i for i, t in texts.items() if not langid.LETTER.search(t)}.isdisjoint(ids) and len(ids) > 0.97 * len(texts)

    exact = stages["exact_duplicates"](spark, kept, sf)
    last = {texts[i]: i for i in sorted(ids)}
    ids = {r.doc_id for r in exact.select("doc_id").collect()}
    assert ids == set(last.values()) and exact.columns == docs.columns

    near = stages["near_duplicates"](spark, exact, sf)
    linked = brute.linked([(i, texts[i]) for i in sorted(ids)], 5, 80, 100)
    ids = {r.doc_id for r in near.select("doc_id").collect()}
    assert ids == {part for _, part in linked.values()} and near.columns == docs.columns

    clean = stages["personal_data"](spark, near, sf)
    field = pii.train()
    masked = {}
    for i in ids:
        base = pii.base_spans(texts[i])
        spans = sorted(base + pii.extra_spans(field, [texts[i]], [base])[0], key=lambda s: s[1])
        text, at = "", 0
        for kind, a, b in spans:
            if a >= at:
                text += texts[i][at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        masked[i] = text + texts[i][at:]
    rows = clean.collect()
    assert {r.doc_id: r.text for r in rows} == masked and clean.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in rows)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pieces = {}
    for r in stages["pack"](spark, clean, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length * 4 == len(r.ids)
    for i, text in masked.items():
        got = b"".join(bytes(r.ids) for r in sorted(pieces[i], key=lambda r: r.start))
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_odd_and_empty_tables(spark, odd, none, sf):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd, none.select(*columns)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, stage(spark, docs, sf)
            assert docs.columns == before.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_run_is_registered(spark, sf):
    import __spark_entry__ as entry

    names = entry.queries().keys()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_a_pending_result_keeps_its_tables(spark, documents):
    """A stage of one run does not drop what another run has yet to read."""
    a = corpus_pipeline.exact_duplicates(spark, documents.filter("doc_id < 50"), "")
    b = corpus_pipeline.exact_duplicates(spark, documents.filter("doc_id >= 50"), "")
    want = documents.filter("doc_id < 50").select(F.coalesce("text", F.lit(""))).distinct().count()
    corpus_pipeline.near_duplicates(spark, written(b, "test"), "").count()
    first = written(a, "test")
    assert first.count() == want
    kept = len(corpus_pipeline.WORKING["exact_duplicates"])
    corpus_pipeline.near_duplicates(spark, first, "").count()
    assert len(corpus_pipeline.WORKING.get("exact_duplicates", [])) < kept
