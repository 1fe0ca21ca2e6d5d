import hashlib

from promptsieve.llm import imatch
from promptsieve.llm.common import rereadable


def test_edited_texts_and_likeness(documents, texts):
    got = {r.doc_id: r for r in imatch.fingerprints(documents).collect()}
    ids = sorted(texts, reverse=True)
    by_text = {}
    for i, following in zip(ids, ids[1:] + ids[:1]):
        text, half = texts[i], len(texts[i]) // 2
        edited = text[:len(text) - half] + texts[following][:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1) == (r.fingerprint == got[following].fingerprint)
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
    mean = lambda c: sum(getattr(r, c) for r in got.values()) / len(got)
    assert mean("near_edited") > 10 * mean("near_next")


def test_order_case_and_repetition_do_not_count(spark):
    filler = [(i, f"filler{i} common{i % 40} shared{i % 25}") for i in range(600)]
    rows = [*filler, (1000, "Common1 shared2 common3, shared4!"), (1001, "shared4 common3 (shared2) common1 common1")]
    got = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), low=0.01, high=0.2).collect()}
    assert got[1000].fingerprint == got[1001].fingerprint and got[1001].near_next == 1
    assert len({got[i].fingerprint for i in range(600)}) > 100


def test_many_ranges_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 16)
    rows = [(i * i, f"text number {i}") for i in range(300)]
    docs = rereadable(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    followed = {r.key: r.next_text for r in imatch._followed(docs, 300, "doc_id", "text").collect()}
    assert followed == {i * i: f"text number {(i - 1) % 300}" for i in range(300)}


def test_odd_rows(spark, odd, none, odd_rows):
    got = imatch.fingerprints(odd).collect()
    assert len(got) == len(odd_rows)
    assert len({r.fingerprint for r in got if r.doc_id in (5, 6, 7)}) == 1
    assert {r.n_chars for r in got if r.doc_id in (1, 2)} == {0}
    assert imatch.fingerprints(none).count() == 0
    one = imatch.fingerprints(spark.createDataFrame([(1, "alone in the table")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1
