import hashlib

import pytest

from promptsieve.llm import grace


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {i: (max(groups[t or ""]), len(groups[t or ""])) for i, t in rows}


@pytest.mark.parametrize("limit", [grace.TABLE_BYTES, 20_000])
def test_groups(spark, documents, texts, limit):
    want = expected(texts.items())
    got = grace.duplicates(documents, limit=limit).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.doc_id] and r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_spilling_recurses_and_compares_whole_contents():
    records = [(i, True, i, f"content {i % 700} ".encode() * 20, 1) for i in range(3000)]
    made = []

    def folder():
        import tempfile
        made.append(made[0] if made else tempfile.mkdtemp())
        return made[-1]

    got = {row: rest for row, *rest in grace._resolve(records, 4000, 0, folder)}
    assert len(made) > 16  # buckets were parted again
    for i in range(3000):
        same = range(i % 700, 3000, 700)
        assert got[i] == [max(same), max(same), len(same)]


def test_colliding_hashes_stay_apart(monkeypatch):
    monkeypatch.setattr(grace.xxhash, "xxh3_64_intdigest", lambda content, seed=0: 7)
    table = grace.ContentTable()
    numbers = [table.find(f"{i % 40}".encode()) for i in range(2000)]
    assert numbers == [i % 40 for i in range(2000)]


def test_odd_rows(odd, none, odd_rows):
    got = grace.duplicates(odd).collect()
    assert len(got) == len(odd_rows) and sum(r.kept for r in got) == len({r[1] or "" for r in odd_rows})
    copies = [r for r in got if r.group_size == 4]
    assert {r.keep_id for r in copies} == {7} and len(copies) == 4
    assert {(r.doc_id, r.keep_id) for r in got if r.group_size == 3} == {(1, 2), (2, 2), (None, 2)}
    kept = grace.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == len({r[1] or "" for r in odd_rows})
    assert kept.filter("doc_id = 8").first().text == dict((r[0], r[1]) for r in odd_rows)[8]
    assert grace.duplicates(none).count() == 0 and grace.deduplicated(none).count() == 0
