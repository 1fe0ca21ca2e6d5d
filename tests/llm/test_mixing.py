import re
from collections import Counter, defaultdict

import pytest

from promptsieve.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Sources' targets, resharing what full sources leave until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        waiting = [s for s in names if s not in full]
        total = sum(weight[s] for s in waiting)
        over = [s for s in waiting if weight[s] * left / total > most * sizes[s]]
        if not over:
            return {s: full[s] if s in full else weight[s] * left / total for s in names}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def check(rows, got, longest):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    want = targets(sizes) if rows else {}
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        rate = want[r.source] / sizes[r.source] if sizes[r.source] and r.size else 0
        assert int(rate + 1e-9) <= r.copies <= -int(-rate - 1 + 1e-9) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= max(2 * longest[s], 0.02 * goal)


def longest(rows):
    most = defaultdict(int)
    for _, text, source in rows:
        most[source] = max(most[source], len(WORDS.findall(text or "")))
    return most


@pytest.mark.parametrize("block", [mixing.BLOCK, 5])
def test_targets_and_copies(documents, block):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    got = mixing.copies(documents, block=block).collect()
    check(rows, got, longest(rows))
    again = mixing.copies(documents.repartition(5, "n_chars"), block=block).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_full_sources_pass_on_their_share(spark):
    rows = [(i, "a b c d e f g h i j", "big" if i < 900 else "tiny" if i < 905 else None if i < 915 else "é") for i in range(1000)]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    check(rows, got, longest(rows))
    assert {r.target for r in got if r.source == "tiny"} == {100.0}
    assert {r.copies for r in got if r.source == "tiny"} == {2}


def test_the_mix_repeats_rows(odd, odd_rows):
    got = mixing.mixed(odd)
    assert got.columns == odd.columns
    taken = Counter((r.doc_id, r.text) for r in got.collect())
    want = Counter()
    for r in mixing.copies(odd).collect():
        if r.copies:
            want[r.doc_id] += r.copies
    assert Counter({k: sum(c for (i, _), c in taken.items() if i == k) for k in want}) == want


def test_odd_rows(odd, none, odd_rows):
    rows = [(r[0], r[1], r[3]) for r in odd_rows]
    got = mixing.copies(odd).collect()
    check(rows, got, longest(rows))
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.copies(none).count() == 0 and mixing.mixed(none).count() == 0
    blank = odd.filter("doc_id in (1, 2, 3)")
    assert {(r.source_size, r.target, r.taken) for r in mixing.copies(blank).collect()} == {(0, 0.0, 0)}
