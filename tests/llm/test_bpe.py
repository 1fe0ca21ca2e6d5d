import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from promptsieve.llm import bpe
from promptsieve.llm.words import EXACT, split

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", "  a  b\n\n c's ½²x_y __ ǆ中文字 \x1c\x1d é I'LL'll 12³ <|endoftext|>  x", "x" * 50_000, "abc 中" * 500,
       "aaaaaaaaaaaaaaaaaaaaaaa", "é ‍🙂🙂", " \x85 \x1c", "_" * 300, "ab" * 70 + " " + "=" * 127 + " " + "=" * 129]


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.codec(PATH).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library_and_round_trips(texts, encoding):
    rows = [*texts.values(), *ODD]
    own = bpe.codec(PATH)
    encoded = own.encode(rows)
    assert [np.frombuffer(e, "<u4").tolist() for e in encoded] == encoding.encode_ordinary_batch(rows)
    assert own.decode(encoded) == [t.encode() for t in rows]


def test_both_contractions_agree_on_random_words(encoding):
    random, own = np.random.default_rng(2), bpe.codec(PATH)
    words = {"".join(random.choice(list("abestin"), random.integers(2, 120))) for _ in range(300)}
    own.known = {}
    own._learn(sorted(words))
    assert all(own.known[w] == own._long(w.encode()) for w in words if w.encode() not in own.ranks)


def test_fast_split_equals_the_pattern(texts):
    assert all(split(t) == EXACT.findall(t) for t in [*texts.values(), *ODD])


def test_pieces_hold_the_words_of_the_text(texts):
    mixed = "".join([*texts.values(), *ODD])
    for whole in (mixed, "。".join(["中文字" * 9] * 300), "it's!'s_a.b" * 500, "no border" + "x" * 5000, ""):
        for most in (1, 7, 1000):
            parts = list(bpe.pieces(whole, most))
            assert "".join(parts) == whole and [w for p in parts for w in EXACT.findall(p)] == EXACT.findall(whole)


def test_very_long_texts(encoding):
    own = bpe.codec(PATH)
    line = "Many words, 12 numbers; and odd½ ones: 中文字。é🙂 don't\n"
    rows = [line * (20_000_000 // len(line.encode())), "short", "", "x" * 2_000_000, "ab " * 700_000]
    encoded = own.encode(rows)
    for got, text in zip(encoded, rows):
        assert np.array_equal(np.frombuffer(got, "<u4"), encoding.encode_to_numpy(text, disallowed_special=()))
    assert own.decode(encoded) == [t.encode() for t in rows]


def test_cache_is_bounded(texts, monkeypatch):
    own = bpe.codec(PATH)
    before = own.encode(list(texts.values()))
    monkeypatch.setattr(bpe, "CACHE", 50)
    assert own.encode(list(texts.values())) == before


def test_odd_rows(odd, none, odd_rows, encoding):
    got = bpe.digests(odd, PATH).collect()
    assert len(got) == len(odd_rows)
    want = sorted((len(i := encoding.encode_ordinary(t or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for _, t, *_ in odd_rows)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    trip = bpe.round_trip(odd, PATH).collect()
    assert sorted(bytes(r.decoded).decode() for r in trip) == sorted(t or "" for _, t, *_ in odd_rows)
    assert bpe.digests(none, PATH).count() == 0
