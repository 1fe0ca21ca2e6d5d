"""Language identification by prediction by partial matching under frozen statistics.

Each language has a variable-order tree of byte contexts with counts from a bounded sample of
labelled texts.  A byte costs -log2 of its frequency in the longest known context, or that
context's escape and the cost in the next shorter one, down to a uniform byte; escapes follow the
number of distinct successors (method C).  Contexts seen twice in some language are known, all of them.

The trees of up to ``GROUP`` languages are merged into one automaton whose state is the longest known
context that occurs in the group.  A state keeps a bitmap of the bytes that follow it in the sample, the place of
its first edge, its escapes and its next shorter context; an edge keeps the exact cost in each language of the
group, escapes included, and the next state.  A byte without an edge costs the escapes and is looked up in the shorter
context; the empty one has all bytes.  So a model's size follows its sample, whatever the number of languages or
byte values, and a code length does not depend on the grouping.  Texts are cut into chunks that are advanced
together, byte by byte, in numpy; a chunk is warmed up with the bytes before it, so cutting changes no code length.

Defined results: ``und`` and score 0 for a null text or one without a letter (number signs such
as a half or a circled one are none); without any labelled text
every document is ``und``; the score is the posterior of the cheapest language, ties go to the
language first in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.llm.common import extended, slices, utf8

SAMPLE_DOCS = 400
SAMPLE_BYTES = 600_000      # of a language
TOTAL_BYTES = 24_000_000    # of all languages, which share it evenly once they are more than 40
DEPTH = 5
GROUP = 8
CHUNK = 256
MOST_BITS = 10.0     # a byte, in the best language; a uniform byte costs 8, one unknown to a language more
LETTER = regex.compile(r"\p{L}")


@dataclass
class Trees:
    """The merged context trees of a few languages; state 0 is the empty context."""
    languages: slice     # the columns of these languages
    follows: np.ndarray  # 4 * state + byte // 64 -> bitmap of the bytes that have an edge
    first: np.ndarray    # the same index -> edge of the least of them
    shorter: np.ndarray  # state -> state
    escape: np.ndarray   # state -> bits of each language
    cost: np.ndarray     # edge -> bits of each language
    after: np.ndarray    # edge -> state


@dataclass
class Model:
    languages: list[str]
    groups: list[Trees]
    depth: int


def sample(docs: DataFrame, allowed: Column, text: str = "text", lang: str = "lang", key: str = "doc_id",
           per_language: int = SAMPLE_DOCS, max_bytes: int = SAMPLE_BYTES,
           total_bytes: int = TOTAL_BYTES) -> list[tuple[str, bytes]]:
    """Labelled texts of every language: at most ``per_language`` rows of each, and about ``max_bytes`` or an even
    share of ``total_bytes``, whichever is less. Each language gives its first text, however long.

    Rows are thinned where they are read, by a hash of the id at a rate from the language's row count,
    so the shuffle and the ranking that enforces the bound see a few times the bound, whatever one
    language's share.
    """
    rows = docs.filter(allowed & F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"),
        F.xxhash64(F.col(key).cast("string"), F.length(text)).alias("code"))
    # One row per language, as the model has.
    counts = F.broadcast(rows.groupBy("lang").count().withColumn("languages", F.count("*").over(Window.partitionBy())))
    chance = F.pmod("code", F.lit(1 << 20)) < F.lit(float(4 * per_language << 20)) / F.col("count") + 64
    order = Window.partitionBy("lang").orderBy("code", "text")
    picked = (rows.join(counts, "lang").filter(chance)
              .withColumn("rank", F.row_number().over(order))
              .filter(F.col("rank") <= per_language)
              .withColumn("before", F.sum(F.octet_length("text")).over(order) - F.octet_length("text"))
              .filter(F.col("before") < F.least(F.lit(max_bytes), F.lit(total_bytes) / F.col("languages"))).select("lang", "text", "rank"))
    found = sorted(picked.toArrow().to_pylist(), key=lambda r: (r["lang"], r["rank"]))
    return [(r["lang"], r["text"].encode()) for r in found]


def _codes(data: np.ndarray, length: int) -> np.ndarray:
    """Each window of ``length`` bytes as one number, length included."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.int64)
    code = np.zeros(n, np.int64)
    for i in range(length):
        code = code << 8 | data[i:i + n]
    return code


def _grams(data: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct byte sequences of each length up to ``depth + 1`` in order, and their counts."""
    return [np.unique(_codes(data, k), return_counts=True) for k in range(depth + 2)]


def _at(ordered: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Place of each code in the ordered ones; -1 where there is none."""
    if not len(ordered):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(ordered, codes), len(ordered) - 1)
    return np.where(ordered[at] == codes, at, -1)


def _trees(grams: list, known: list[np.ndarray], depth: int, languages: slice) -> Trees:
    """The merged trees of the languages with these ``grams``; ``known`` contexts by length."""
    empty = np.zeros(1, np.int64)
    levels = [empty] + [np.intersect1d(known[k], np.unique(np.concatenate([g[k][0] for g in grams])), assume_unique=True)
                        for k in range(1, depth + 1)]
    start = np.cumsum([0, *map(len, levels)])
    shorter, escape, cost, after = [], [], [], []
    follows = np.zeros(4 * start[-1], np.uint64)
    codes_before = empty
    for length, own in enumerate(levels):
        found = np.unique(np.concatenate([g[length + 1][0] for g in grams])) if length else np.arange(256)
        parent = _at(own, found >> 8)
        codes, parent = found[parent >= 0], parent[parent >= 0]
        mask = (1 << 8 * length) - 1
        if length:
            shorter.append(start[length - 1] + _at(levels[length - 1], own & (mask >> 8)))
            lower = _at(codes_before, codes & mask)
            cheap, state = cost[-1][lower], after[-1][lower]
        else:
            shorter.append(empty)
            cheap, state = np.full((256, len(grams)), 8.0, np.float32), np.zeros(256, np.int64)
        if length < depth:
            longer = _at(levels[length + 1], codes)
            state = np.where(longer >= 0, start[length + 1] + longer, state)
        leave, bits = np.zeros((len(own), len(grams)), np.float32), np.empty((len(codes), len(grams)), np.float32)
        for l, g in enumerate(grams):
            edge = _at(codes, g[length + 1][0])
            seen = np.zeros(len(codes))
            seen[edge[edge >= 0]] = g[length + 1][1][edge >= 0]
            total = np.bincount(parent, seen, len(own))
            kinds = np.bincount(parent, seen > 0, len(own))
            leave[:, l] = np.log2((total + kinds) / np.maximum(kinds, 1), where=kinds > 0, out=np.zeros(len(own)))
            bits[:, l] = leave[parent, l] + cheap[:, l]
            hit = seen > 0
            bits[hit, l] = np.log2((total + kinds)[parent[hit]] / seen[hit])
        byte = codes & 255
        np.bitwise_or.at(follows, 4 * (start[length] + parent) + (byte >> 6), np.uint64(1) << (byte & 63).astype(np.uint64))
        escape.append(leave)
        cost.append(bits)
        after.append(state)
        codes_before = codes
    sizes = np.bitwise_count(follows).astype(np.int64)
    return Trees(languages, follows, np.cumsum(sizes) - sizes, np.concatenate(shorter), np.concatenate(escape),
                 np.concatenate(cost), np.concatenate(after))


def train(texts: list[tuple[str, bytes]], depth: int = DEPTH, group: int = GROUP) -> Model | None:
    if not texts:
        return None
    languages = sorted({lang for lang, _ in texts})
    data = {l: np.frombuffer(b"\n".join(t for lang, t in texts if lang == l) + b"\n", np.uint8) for l in languages}
    known = [np.zeros(0, np.int64)] * (depth + 1)
    for l in languages:
        for k, (codes, counts) in enumerate(_grams(data[l], depth - 1)):
            known[k] = np.union1d(known[k], codes[counts >= 2])
    groups = []
    for at in range(0, len(languages), group):
        names = languages[at:at + group]
        groups.append(_trees([_grams(data[l], depth) for l in names], known, depth, slice(at, at + len(names))))
    return Model(languages, groups, depth)


def _advanced(trees: Trees, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each language, next state) of one byte in each state."""
    word, bit = 4 * state + (byte >> 6), (byte & 63).astype(np.uint64)
    bits = trees.follows[word] >> bit
    missing = np.flatnonzero((bits & np.uint64(1)) == 0)
    above = None
    if len(missing):
        high, at, wanted = word.copy(), state[missing], byte[missing]
        above, left = [], missing
        while len(left):
            above.append((left, trees.escape[at]))
            at = trees.shorter[at]
            there = 4 * at + (wanted >> 6)
            high[left] = there
            lacks = np.flatnonzero((trees.follows[there] >> bit[left] & np.uint64(1)) == 0)
            left, at, wanted = left[lacks], at[lacks], wanted[lacks]
        word = high
    below = trees.follows[word] & ((np.uint64(1) << bit) - np.uint64(1))
    edge = trees.first[word] + np.bitwise_count(below)
    row = trees.cost[edge]
    for rows, escapes in above or ():
        row[rows] += escapes
    return row, trees.after[edge]


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Bits of each text (row) in each language (column)."""
    total = np.zeros((len(offsets) - 1, len(model.languages)))
    begins, ends = offsets[:-1], offsets[1:]
    pieces = -(-(ends - begins) // chunk)
    owner = np.repeat(np.arange(len(begins)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = begins[owner] + number * chunk
    last = np.minimum(first + chunk, ends[owner])
    warm = np.minimum(model.depth, first - begins[owner])
    order = np.argsort(first - last - warm, kind="stable")
    for part in np.array_split(order, max(1, len(order) // 8192)):
        origin, length, skip = (first - warm)[part], (last - first + warm)[part], warm[part]
        alive = np.searchsorted(-length, -np.arange(int(length.max())), side="left") if len(part) else []
        for trees in model.groups:
            state = np.zeros(len(part), np.int64)
            bits = np.zeros((len(part), trees.cost.shape[1]), np.float64)
            for t, n in enumerate(alive):
                row, state[:n] = _advanced(trees, state[:n], data[origin[:n] + t].astype(np.int64))
                if t < model.depth:
                    row = row * (skip[:n] <= t)[:, None]
                bits[:n] += row
            for l in range(bits.shape[1]):
                total[:, trees.languages.start + l] += np.bincount(owner[part], bits[:, l], len(total))
    return total


def _measured(model: Model | None, texts: pa.Array):
    """(predicted language, score, bits per byte) of each text."""
    letters = np.array([bool(t) and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    data, offsets = utf8(texts)
    bits = code_lengths(model, data, offsets)
    best, least = bits.argmin(axis=1), bits.min(axis=1)
    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -60)).sum(axis=1)
    rate = least / np.maximum(np.diff(offsets), 1)
    return ([model.languages[b] if ok else "und" for b, ok in zip(best, letters)],
            np.where(letters, score, 0.0), np.where(letters, rate, 0.0))


def predictions(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``lang_pred``, ``score`` and ``bits_per_byte`` of every row; only key and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))

    def apply(batches):
        for batch in slices(batches):
            lang, score, rate = _measured(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)],
                names=["_key", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(apply, extended(rows.select("_key"), lang_pred="string", score="double",
                                           bits_per_byte="double")).withColumnRenamed("_key", key)


def accepted(docs: DataFrame, model: Model | None, text: str = "text", most_bits: float = MOST_BITS) -> DataFrame:
    """The rows, with the columns of ``docs``, whose text is in a language: it has a letter, and the best
    language codes it in at most ``most_bits`` a byte. Without a model only the letter counts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_rest"), F.col(f"`{text}`").alias("_text"))

    def apply(batches):
        for batch in slices(batches):
            if shared.value is None:
                keep = [bool(t) and LETTER.search(t) is not None for t in batch.column(1).to_pylist()]
            else:
                lang, _, rate = _measured(shared.value, batch.column(1))
                keep = [code != "und" and bits <= most_bits for code, bits in zip(lang, rate)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    kept = rows.mapInArrow(apply, extended(rows))
    return kept.select(*(F.col("_text").alias(c) if c == text else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns))
