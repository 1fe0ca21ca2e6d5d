import hashlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from promptsieve.llm import pii
from promptsieve.llm.common import utf8

ODD = ["a@b@c.com x@y.z@q.r", "1.2.3.4.5.6.7.8 0001.2.3.4 300.1.1.1", "+1 (555) 123-4567 4111 1111 1111 1111",
       "é@é.com é.a@b-c.d..e", "", "@@@ a@b.c@d.e", "+12+3456789012", "9" * 3000, "a" * 3000 + "@", "1." * 2000]


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_patterns_equal_the_plain_ones(texts):
    for t in [*texts.values(), *ODD]:
        assert pii.base_spans(t) == brute.personal(t)


def test_pieces_give_the_viterbi_path(field, texts):
    rows = [*list(texts.values())[:60], *(t for t, _ in pii.labelled(2, 77)), *ODD[:7]]
    data, offsets = utf8(pa.array(rows))
    tokens = pii.features(data, offsets)
    full = [np.zeros(len(tokens.begin), np.int64) for _ in pii.WIDTHS]
    for family, own in zip(full, tokens.numbers):
        family[tokens.at] = own
    scores, label = pii._scores(field, full), np.zeros(len(tokens.begin), np.int64)
    label[tokens.at] = pii.decode(field, pii._scores(field, tokens.numbers), tokens)
    for i in range(len(rows)):
        at = np.flatnonzero(tokens.owner == i)
        if len(at):
            value, back = scores[at[0]], []
            for t in at[1:]:
                ways = value[:, None] + field.moves
                back.append(ways.argmax(axis=0))
                value = ways.max(axis=0) + scores[t]
            path = [int(value.argmax())]
            for b in back[::-1]:
                path.append(int(b[path[-1]]))
            assert path[::-1] == label[at].tolist()


def test_held_out_rows_of_the_table(field):
    rows = pii.labelled(4, 1234)
    texts = [t for t, _ in rows]
    base = [pii.base_spans(t) for t in texts]
    extra = pii.extra_spans(field, texts, base)
    wanted = sum(len(s) for _, s in rows)
    found = sum(any(k == kind and x <= a and b <= y for k, x, y in got + more)
                for (_, spans), got, more in zip(rows, base, extra) for kind, a, b in spans)
    wrong = [e for (_, spans), more in zip(rows, extra) for e in more if not any(e[1] < b and a < e[2] for _, a, b in spans)]
    assert found >= 0.97 * wanted and len(wrong) <= 0.02 * wanted
    assert sum(map(len, extra)) > 0.2 * wanted  # looser forms, which the patterns miss


def test_query_rows(documents, texts, field):
    for r in pii.detected(documents, field).collect():
        base = brute.personal(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in base) for k in pii.KINDS]
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | {""}


def test_masking_leaves_none(documents, field):
    for r in pii.masked(documents, field).collect():
        assert not brute.personal(r.text)


def test_odd_rows(odd, none, odd_rows, field):
    got = pii.detected(odd, field).collect()
    assert len(got) == len(odd_rows) and {r.spans for r in got if r.doc_id in (1, 2, 3)} == {""}
    masked = pii.masked(odd, field)
    assert masked.columns == odd.columns
    assert sorted(map(str, [r.text for r in masked.collect()])) == sorted(map(str, [r[1] for r in odd_rows]))
    assert pii.detected(none, field).count() == 0 and pii.masked(none, field).count() == 0
