"""Personal data: exact patterns, and a linear-chain conditional random field for looser forms.

The patterns find e-mail addresses, IP addresses, payment cards and telephone numbers of fixed form.
The field labels the tokens of a text (runs without white space) with a kind or none, from features of
their shape: the run-length-free shape itself, digit count, signs, a few cue words, and the neighbours'.
It is trained on the small labelled table below by gradient ascent of the exact likelihood and finds
what the patterns miss: telephone numbers without a plus, spelt-out addresses. All features of a batch of texts
are computed at once on its bytes. A token whose score for "none" beats every other label by more than
that label's two transitions can gain is "none" on every best path, so the chain falls apart there; Viterbi runs
on the remaining short pieces, all of a batch together.

Spans of the field that touch a pattern's span or fail their kind's check are left out; the
patterns' spans always stay.

Defined results: null and empty texts have no spans; positions are code points, the end exclusive;
every row is searched, repeated ones too.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import extended, slices, utf8

KINDS = ("email", "ip", "card", "phone")
SLICE = 4 << 20

LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind changes no match: from inside a run of digits a failed match fails again.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        if at > last and (domain := DOMAIN.match(text, at + 1)):
            begin = at
            while begin > last and (text[begin - 1].isascii() and text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
                begin -= 1
            if begin < at:
                yield "email", begin, domain.end()
                last = domain.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans, by start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# The labelled table. Slots are filled by rule; a slot's name up to the digit is its kind.
TABLE = (
    "please write to {email1} for the details",
    "Contact: {email1}, or call {phone1}.",
    "my address is {email2} and nothing else",
    "reach {email3} before Monday",
    "mail {email2} or {email1} today",
    "call me at {phone2} after five",
    "tel {phone3} fax {phone3}",
    "Phone: {phone4}, room 12",
    "her mobile is {phone5}; ask for Kim",
    "dial {phone1} or {phone2}",
    "the server {ip1} did not answer",
    "ping {ip1} and {ip1} again",
    "from {ip1} port 8080",
    "card {card1} was charged 20.50",
    "visa {card2} expires 11/27",
    "pay with {card1}, please",
    "the number {card2} and then {phone1}",
    "on {date} we met at {time} in room {small}",
    "version {version} was released in {year}",
    "it costs {price} or {small} coins",
    "order {long} has {small} items",
    "chapter {small} of {small}, page {small}",
    "at the end of the day the dot was red",
    "look at the house, at noon, dot the line",
    "the (first) answer and the (second) one",
    "invoice {long} from {date}, total {price}",
    "scores were {small}-{small} and {small}-{small} in {year}",
    "section {version} (see {small}) on {date}",
    "{year} {year} {small} {small} {price}",
    "no numbers in this line at all",
    "Them and the others went home. Nothing else, really!",
    "### the$$$ sign%%% words&&& are*** here",
    "ID {long} {long} and key {hex}",
    "password={hex} token {hex}",
)
CUES = ("(at)", "[at]", "(dot)", "[dot]")


def _digits(random, n: int) -> str:
    return "".join(str(random.integers(10)) for _ in range(n))


def _word(random) -> str:
    return "".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), random.integers(3, 9)))


def _filled(slot: str, random) -> str:
    d = lambda n: _digits(random, n)
    user, host = _word(random), _word(random)
    number = d(15)
    check = next(c for c in "0123456789" if luhn(number + c))
    number += check
    small = str(random.integers(1, 400))
    return {
        "email1": f"{user}.{d(2)}@{host}.example.com", "email2": f"{user} [at] {host} [dot] com",
        "email3": f"{user} (at) {host} (dot) org", "phone1": f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}",
        "phone2": f"({d(3)}) {d(3)}-{d(4)}", "phone3": f"{d(3)}-{d(3)}-{d(4)}", "phone4": f"{d(3)}.{d(3)}.{d(4)}",
        "phone5": f"0{d(4)} {d(6)}", "ip1": ".".join(str(random.integers(256)) for _ in range(4)), "card1": number,
        "card2": " ".join(number[i:i + 4] for i in range(0, 16, 4)), "date": f"20{d(2)}-{d(2)}-{d(2)}",
        "time": f"1{d(1)}:{d(2)}", "small": small, "version": f"{d(1)}.{d(1)}.{d(2)}", "year": f"19{d(2)}",
        "price": f"{d(2)}.{d(2)}", "long": d(int(random.integers(5, 21))), "hex": f"a{d(3)}e{d(4)}f{d(2)}",
    }[slot]


def labelled(copies: int = 12, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The table's rows with their slots filled: (text, spans)."""
    random, rows = np.random.default_rng(seed), []
    for _ in range(copies):
        for template in TABLE:
            text, spans = "", []
            for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
                if i % 2:
                    value = _filled(part, random)
                    if (kind := part.rstrip("12345")) in KINDS:
                        spans.append((kind, len(text), len(text) + len(value)))
                    part = value
                text += part
            rows.append((text, spans))
    return rows


# Byte classes: 0 white space, 1 lower case or beyond ASCII, 2 upper case, 3 digit, then one per sign of interest.
SIGNS = b"@.-()+[]:/=%,"
CLASS = np.full(256, 4 + len(SIGNS), np.uint8)
CLASS[[32, *range(9, 14)]] = 0
CLASS[97:123] = 1
CLASS[128:] = 1
CLASS[65:91] = 2
CLASS[48:58] = 3
for _i, _b in enumerate(SIGNS):
    CLASS[_b] = 4 + _i
SPACE = CLASS == 0
MARKED = (CLASS == 3) | np.isin(np.arange(256), list(b"@+([{"))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
POWERS = np.cumprod(np.full(24, 0x9E3779B97F4A7C15, np.uint64))
BUCKETS = 4096


def _hash(values: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Polynomial hash of the first 24 values of each run."""
    terms = np.where(place < 24, (values.astype(np.uint64) + 1) * POWERS[np.minimum(place, 23)], 0)
    return np.add.reduceat(terms, starts) if len(starts) else np.zeros(0, np.uint64)


def _cue_hashes() -> np.ndarray:
    found = []
    for cue in CUES:
        raw = np.frombuffer(cue.encode(), np.uint8)
        found.append(_hash(raw, np.zeros(1, np.int64), np.arange(len(raw)))[0])
    return np.array(found, np.uint64)


CUE_HASHES = _cue_hashes()
WIDTHS = (BUCKETS, 16 * 32, len(CUES) + 1, 16 * 32, 16 * 32, len(CUES) + 1, len(CUES) + 1)


@dataclass
class Tokens:
    """All tokens of a batch of texts; features only of those that stand out and their neighbours."""

    begin: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    at: np.ndarray                # numbers of the tokens with features, ascending
    numbers: list[np.ndarray]     # per feature family, of those tokens


def features(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """A plain token, without digit, at sign, plus or bracket, has feature 0 in every family of its own."""
    filled = SPACE[data]
    np.logical_not(filled, out=filled)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = filled.copy(), filled.copy()
    opens[1:] &= ~filled[:-1] | edge[1:len(data)]
    closes[:-1] &= ~filled[1:] | edge[1:len(data)]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    owner = np.searchsorted(offsets, begin, side="right") - 1
    odd = np.unique(np.searchsorted(begin, np.flatnonzero(MARKED[data]), side="right") - 1)
    n = len(begin)
    if not len(odd):
        return Tokens(begin, end, owner, odd, [odd] * len(WIDTHS))
    size = end[odd] - begin[odd]
    token = np.repeat(np.arange(len(odd)), size)
    starts = np.cumsum(size) - size
    inside = np.arange(len(token)) - starts[token]
    at = begin[odd][token] + inside
    own = CLASS[data[at]]
    turn = np.ones(len(own), bool)
    turn[1:] = (own[1:] != own[:-1]) | (token[1:] != token[:-1])
    runs = np.flatnonzero(turn)
    run_starts = np.searchsorted(token[runs], np.arange(len(odd)))
    shape = _hash(own[runs], run_starts, np.arange(len(runs)) - run_starts[token[runs]])
    digits = np.add.reduceat((own == 3).astype(np.int32), starts)
    amount = np.searchsorted([1, 2, 3, 4, 5, 6, 7, 9, 10, 12, 16, 17, 20], digits, side="right")
    flag = lambda c: np.bitwise_or.reduceat((own == c).astype(np.int32), starts)
    signs = (flag(4 + SIGNS.index(b"@")) | flag(4 + SIGNS.index(b".")) << 1 | (flag(1) | flag(2)) << 2
             | (own[starts] == 4 + SIGNS.index(b"+")).astype(np.int32) << 3
             | (own[starts] == 4 + SIGNS.index(b"(")).astype(np.int32) << 4)
    word = _hash(LOWER[data[at]], starts, inside)
    coarse, cue, form = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    coarse[odd] = amount * 32 + signs
    form[odd] = 1 + (shape % np.uint64(BUCKETS - 1)).astype(np.int64)
    for i, code in enumerate(CUE_HASHES):
        cue[odd[word == code]] = i + 1
    near = np.unique(np.concatenate([odd - 1, odd, odd + 1]))
    near = near[(near >= 0) & (near < n)]
    before = np.where((near > 0) & (owner[near - 1] == owner[near]), near - 1, n)
    after = np.where(owner[np.minimum(near + 1, n - 1)] == owner[near], near + 1, n)
    return Tokens(begin, end, owner, near, [form[near], coarse[near], cue[near], coarse[before], coarse[after],
                                            cue[before], cue[after]])


@dataclass
class Field:
    emissions: list[np.ndarray]  # per family: feature -> label scores
    moves: np.ndarray            # from label -> to label


def _scores(field: Field, numbers: list[np.ndarray]) -> np.ndarray:
    total = np.zeros((len(numbers[0]), len(KINDS) + 1))
    for table, own in zip(field.emissions, numbers):
        total += table[own]
    return total


def _reach(field: Field) -> np.ndarray:
    """Per label other than none, the most that it can gain over none on its two transitions."""
    gain_in = (field.moves - field.moves[:, :1]).max(axis=0)
    gain_out = (field.moves - field.moves[:1]).max(axis=1)
    return np.maximum(gain_in, 0)[1:] + np.maximum(gain_out, 0)[1:]


def plain_is_none(field: Field) -> bool:
    """Whether a plain token among plain ones is none on every best path."""
    plain = _scores(field, [np.zeros(1, np.int64)] * len(WIDTHS))[0]
    return bool((plain[0] - plain[1:] > _reach(field)).all())


def train(rows=None, rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Adam on the regularised log-likelihood, with forward and backward sums over all rows at once."""
    rows = labelled() if rows is None else rows
    labels = len(KINDS) + 1
    data, offsets = utf8(pa.array([t for t, _ in rows]))
    tokens = features(data, offsets)
    begin, end, owner = tokens.begin, tokens.end, tokens.owner
    numbers = [np.zeros(len(begin), np.int64) for _ in WIDTHS]
    for family, own in zip(numbers, tokens.numbers):
        family[tokens.at] = own
    truth = np.zeros(len(begin), np.int64)
    for i, (_, spans) in enumerate(rows):  # the table is ASCII: bytes are code points
        for kind, a, b in spans:
            inside = (owner == i) & (begin < offsets[i] + b) & (end > offsets[i] + a)
            truth[inside] = KINDS.index(kind) + 1
    count = np.bincount(owner, minlength=len(rows))
    first, longest = np.cumsum(count) - count, int(count.max())
    place = np.arange(len(begin)) - first[owner]
    field = Field([np.zeros((w, labels)) for w in WIDTHS], np.zeros((labels, labels)))
    weights = [*field.emissions, field.moves]
    mean, spread = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        grid = np.zeros((len(rows), longest, labels))
        grid[owner, place] = _scores(field, numbers)
        there = np.arange(longest)[None, :] < count[:, None]
        forward, backward = np.zeros_like(grid), np.zeros_like(grid)
        forward[:, 0] = grid[:, 0]
        for t in range(1, longest):
            value = np.logaddexp.reduce(forward[:, t - 1, :, None] + field.moves, axis=1) + grid[:, t]
            forward[:, t] = np.where(there[:, t, None], value, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            value = np.logaddexp.reduce(field.moves + (grid[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(there[:, t + 1, None], value, 0)
        norm = np.logaddexp.reduce(forward[:, -1], axis=1)
        chance = np.exp(forward + backward - norm[:, None, None])[owner, place]
        error = np.eye(labels)[truth] - chance
        slopes = []
        for table, own in zip(field.emissions, numbers):
            slope = np.zeros_like(table)
            np.add.at(slope, own, error)
            slopes.append(slope)
        pairs = np.zeros_like(field.moves)
        for t in range(1, longest):
            both = np.exp(forward[:, t - 1, :, None] + field.moves + (grid[:, t] + backward[:, t])[:, None, :]
                          - norm[:, None, None])
            pairs -= both[there[:, t]].sum(axis=0)
        follows = np.flatnonzero(place > 0)
        np.add.at(pairs, (truth[follows - 1], truth[follows]), 1)
        slopes.append(pairs)
        for w, slope, m, v in zip(weights, slopes, mean, spread):
            slope = slope / len(rows) - decay * w
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            w += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    if not plain_is_none(field):
        raise ValueError("the labelled table does not make plain tokens none")
    return field


def decode(field: Field, scores: np.ndarray, tokens: Tokens) -> np.ndarray:
    """The best label of every token with features; exact, on the pieces between tokens that are none on
    any best path."""
    number, owner = tokens.at, tokens.owner[tokens.at]
    best = np.zeros(len(scores), np.int64)
    at = np.flatnonzero((scores[:, :1] - scores[:, 1:] <= _reach(field)).any(axis=1))
    if not len(at):
        return best
    starts = np.ones(len(at), bool)
    starts[1:] = (number[at[1:]] != number[at[:-1]] + 1) | (owner[at[1:]] != owner[at[:-1]])
    piece = np.cumsum(starts) - 1
    first = at[starts]
    size = np.bincount(piece)
    last = first + size - 1
    ends = len(tokens.begin) - 1  # a piece's neighbours in its text, where there are any, are none
    before = (number[first] > 0) & (tokens.owner[np.maximum(number[first] - 1, 0)] == owner[first])
    after = (number[last] < ends) & (tokens.owner[np.minimum(number[last] + 1, ends)] == owner[last])
    order = np.argsort(-size, kind="stable")
    for group in np.array_split(order, max(1, len(order) // 20_000)):
        n, longest = len(group), int(size[group].max())
        begin, length = first[group], size[group]
        value = scores[begin] + np.where(before[group, None], field.moves[0], 0)
        back = np.zeros((longest, n, value.shape[1]), np.int8)
        for t in range(1, longest):
            alive = length > t
            ways = value[alive, :, None] + field.moves
            back[t, alive] = ways.argmax(axis=1)
            value[alive] = ways.max(axis=1) + scores[begin[alive] + t]
        value += np.where(after[group, None], field.moves[:, 0], 0)
        label = value.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            alive = length > t
            best[begin[alive] + t] = label[alive]
            if t:
                label[alive] = back[t, alive, label[alive]]
    return best


def _passes(kind: str, value: str) -> bool:
    digits = "".join(re.findall("[0-9]", value))
    if kind == "phone":
        return 9 <= len(digits) <= 15 and not re.search("[A-Za-z]", value)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = value.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts)
    return re.search(r"@|[(\[]at[)\]]", value, re.I) is not None and re.search(r"\.|[(\[]dot[)\]]", value, re.I) is not None


def extra_spans(field: Field, texts: list[str], base: list[list]) -> list[list[tuple[str, int, int]]]:
    """The field's spans of each text that touch none of its base spans."""
    data, offsets = utf8(pa.array(texts, pa.string()))
    tokens = features(data, offsets)
    begin, end, owner = tokens.begin, tokens.end, tokens.owner
    label = np.zeros(len(begin), np.int64)
    label[tokens.at] = decode(field, _scores(field, tokens.numbers), tokens)
    found: list[list] = [[] for _ in texts]
    at = np.flatnonzero(label)
    if not len(at):
        return found
    starts = np.ones(len(at), bool)
    starts[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]) | (label[at[1:]] != label[at[:-1]])
    firsts = at[starts]
    lasts = np.append(at[np.flatnonzero(starts)[1:] - 1], at[-1])
    for a, b in zip(firsts.tolist(), lasts.tolist()):
        i, kind = int(owner[a]), KINDS[label[a] - 1]
        raw = data[begin[a]:end[b]].tobytes().decode()
        value = raw.strip(".,;:!?\"'")
        if not _passes(kind, value):
            continue
        start = len(data[offsets[i]:begin[a]].tobytes().decode()) + raw.index(value)
        stop = start + len(value)
        if all(stop <= s or start >= e for _, s, e in base[i]):
            found[i].append((kind, start, stop))
    return found


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _found(shared):
    def apply(batches):
        field = shared.value
        for batch in slices(batches, most=SLICE):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            extra = extra_spans(field, texts, base)
            every = [sorted(b + e, key=lambda s: (s[1], KINDS.index(s[0]))) for b, e in zip(base, extra)]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *counts, pa.array([joined(b) for b in base], pa.string()),
                 pa.array([joined(s) for s in every], pa.string())],
                names=[*batch.schema.names, *(f"_n_{k}" for k in KINDS), "_base", "_spans"])

    return apply


def _rows(docs: DataFrame, field: Field, key: str, text: str, rest: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"),
                       *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_rest")] if rest else []))
    return rows.mapInArrow(_found(shared), extended(rows, **{f"_n_{k}": "long" for k in KINDS}, _base="string", _spans="string"))


def detected(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, base counts, ``base_sha256`` and ``spans`` of every row; only key and text are read."""
    return _rows(docs, field, key, text, []).select(
        F.col("_key").alias(key), *(F.col(f"_n_{k}").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.col("_base").cast("binary"), 256).alias("base_sha256"), F.col("_spans").alias("spans"))


def _masked(batches):
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if spans:
                parts, at = [], 0
                for kind, a, b in (s.split(":") for s in spans.split(",")):
                    if int(a) >= at:  # of overlapping spans the first names the mask, the union is masked
                        parts += [text[at:int(a)], f"[{kind.upper()}]"]
                    at = max(at, int(b))
                text = "".join(parts) + text[at:]
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_rest", "_text"])


def masked(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with every span replaced by its kind in brackets, with the columns of ``docs``."""
    rest = [c for c in docs.columns if c != text]
    rows = _rows(docs, field, key, text, rest).select("_rest", "_text", "_spans")
    done = rows.mapInArrow(_masked, extended(rows.select("_rest", "_text")))
    return done.select(*(F.col("_text").alias(c) if c == text else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns))
