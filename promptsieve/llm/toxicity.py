"""Toxicity by compression distance to two zstandard dictionaries.

Both dictionaries are trained on a bounded sample of labelled texts. The ordinary one comes from
zstandard's own trainer over windows of ordinary texts. That trainer rewards frequency alone and, given
toxic texts, keeps the syllables that all texts share; the toxic dictionary is therefore the ordinary
content followed by the beginnings of words whose share of toxic texts exceeds chance most. A window of
a few words that compresses shorter with the toxic dictionary than with the ordinary one speaks for
toxicity by the bytes saved. A text's windows, counted by saving, go into a logistic model fitted on the
sample, and the score is shifted so that 0.5 is the threshold of best F1 there.

Defined results: empty, null and white-space texts have no window and get the model's score of none;
without labels of both classes every score is 0; repeated rows get equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.llm.common import extended, slices

SAMPLE = {1: 2000, 0: 4000}  # texts of each label at most
SAMPLE_BYTES = 12_000_000    # of each label, about
WORDS, STRIDE = 8, 4
ORDINARY_BYTES, TOXIC_BYTES = 4096, 32768
TOP = 9                      # savings from here on are counted together
SLICE = 4 << 20


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def sample(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text",
           label: str = "toxic", most: dict = SAMPLE, max_bytes: int = SAMPLE_BYTES) -> list[tuple[int, bytes]]:
    """Labelled texts, at most ``most`` of each label, picked by a hash of the id.

    Only ids, labels and sizes are counted and ranked; the picked ids are few enough to send to the texts,
    and of each label those are read whose predecessors have fewer than ``max_bytes`` in all.
    """
    known = labels.filter(allowed & F.col(label).isin(0, 1)).select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"),
        F.xxhash64(F.col(key).cast("string"), F.lit(3)).alias("_code"))
    counts = known.groupBy("_label").count()
    limit = F.when(F.col("_label") == 1, most[1]).otherwise(most[0])
    chance = F.pmod("_code", F.lit(1 << 20)) < limit * float(3 << 20) / F.col("count") + 64
    order = Window.partitionBy("_label").orderBy("_code", "_key")
    picked = (known.join(F.broadcast(counts), "_label").filter(chance)
              .withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit)
              .select("_key", "_label", "_rank"))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.length("_text") > 0)
    sizes = (rows.select("_key", F.octet_length("_text").cast("bigint").alias("_size")).join(F.broadcast(picked), "_key")
             .groupBy("_key", "_label", "_rank").agg(F.sum("_size").alias("_size")))
    before = F.sum("_size").over(Window.partitionBy("_label").orderBy("_rank")) - F.col("_size")
    fitting = sizes.withColumn("_before", before).filter(F.col("_before") < max_bytes).select("_key", "_label", "_rank")
    texts = rows.join(F.broadcast(fitting), "_key").select("_label", "_rank", "_text")
    found, size = [], Counter()
    for row in sorted(texts.toArrow().to_pylist(), key=lambda r: (r["_rank"], r["_label"], r["_text"])):
        raw = row["_text"].encode()
        if size[row["_label"]] < max_bytes:
            found.append((row["_label"], raw))
            size[row["_label"]] += len(raw)
    return found


def windows(texts: list[bytes], words: int = WORDS, stride: int = STRIDE):
    """(buffer, begin, end, text number) of each run of ``words`` words, spaces around it included."""
    buffer = b"".join(b" " + t + b" " for t in texts)
    data = np.frombuffer(buffer, np.uint8)
    ends = np.cumsum([len(t) + 2 for t in texts])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
    owner = np.searchsorted(ends, begin, side="right")
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    place = np.arange(len(begin)) - first[owner]
    picked = np.flatnonzero((place % stride == 0) & ((place == 0) | (place + words - stride < count[owner])))
    last = np.minimum(picked + words, first[owner[picked]] + count[owner[picked]]) - 1
    return buffer, begin[picked] - 1, stop[last] + 1, owner[picked]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(
        3, strategy=zstandard.STRATEGY_BTOPT, min_match=4,
        write_checksum=False, write_content_size=False, write_dict_id=False)
    kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=kept, compression_params=settings)


def lengths(tool: zstandard.ZstdCompressor, buffer: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros(0, np.int64)
    segments = np.stack([begin, end - begin], axis=1).astype("<u8").tobytes()
    packed = tool.multi_compress_to_buffer(zstandard.BufferWithSegments(buffer, segments), threads=1)
    return np.fromiter(map(len, packed), np.int64, len(begin))


def counted(texts: list[bytes], ordinary, toxic) -> np.ndarray:
    """Per text the logarithm of how many windows save 1, 2, ... bytes, and of how many there are."""
    buffer, begin, end, owner = windows(texts)
    saved = lengths(ordinary, buffer, begin, end) - lengths(toxic, buffer, begin, end)
    n = len(texts)
    columns = [np.bincount(owner[saved == g], minlength=n) for g in range(1, TOP)]
    columns += [np.bincount(owner[saved >= TOP], minlength=n), np.bincount(owner, minlength=n)]
    return np.log1p(np.stack(columns, axis=1))


def _beginnings(text: bytes) -> set[bytes]:
    found = set()
    for word in set(text.split()):
        spaced = b" " + word[:12] + b" "
        found.update(spaced[:n] for n in range(5, len(spaced) + 1))
    return found


def telling(toxic: list[bytes], ordinary: list[bytes], room: int = TOXIC_BYTES) -> bytes:
    """Beginnings of words most over-represented in toxic texts, the strongest last."""
    mine = Counter()
    for text in toxic:
        mine.update(_beginnings(text))
    mine = {g: n for g, n in mine.items() if n >= 3}  # the own words of one text and a copy are not enough
    theirs = Counter()
    for text in ordinary:
        theirs.update(g for g in _beginnings(text) if g in mine)
    share = len(toxic) / (len(toxic) + len(ordinary))

    def excess(g):
        expected = (mine[g] + theirs[g]) * share
        return (mine[g] - expected) / math.sqrt(expected * (1 - share) + 1)

    least = max(3.0, math.sqrt(2 * math.log(len(mine) + 2)))  # beyond the largest chance excess of so many
    content, kept, begun = b"", set(), set()
    ranked = sorted(((excess(g), len(g), g) for g in mine), reverse=True)
    for score, _, g in ranked:
        if score < least or len(content) + len(g) > room:
            break
        heads = {g[:n] for n in range(5, len(g) + 1)}
        if g not in begun and not heads & kept:  # neither continues the other
            kept.add(g)
            begun |= heads
            content = g + content
    return content


def train(texts: list[tuple[int, bytes]]) -> Model | None:
    toxic, ordinary = [t for y, t in texts if y == 1], [t for y, t in texts if y == 0]
    if not toxic or not ordinary:
        return None
    buffer, begin, end, _ = windows(ordinary, 3, 3)
    some = np.random.default_rng(7).permutation(len(begin))[:30_000]
    samples = [buffer[begin[i]:end[i]] for i in some]
    try:
        content = zstandard.train_dictionary(2 * ORDINARY_BYTES, samples, k=32, d=6).as_bytes()[-ORDINARY_BYTES:]
    except zstandard.ZstdError:  # too few samples for the trainer
        content = b"".join(samples)[-ORDINARY_BYTES:]
    own = content + telling(toxic, ordinary)
    counts = counted([t for _, t in texts], compressor(content), compressor(own))
    y = np.array([label for label, _ in texts], float)
    mean, scale = counts.mean(axis=0), counts.std(axis=0) + 1e-9
    x = np.column_stack([(counts - mean) / scale, np.ones(len(y))])
    weights = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-x @ weights))
        curvature = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(weights))
        weights += np.linalg.solve(curvature, x.T @ (y - p) - weights)
    margin = x @ weights
    order = np.argsort(-margin, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(f1.argmax())
    below = margin[order[min(at + 1, len(y) - 1)]]
    weights[-1] -= (margin[order[at]] + below) / 2
    return Model(content, own, mean, scale, weights)


TOOLS: dict[bytes, tuple] = {}


def _scored(shared):
    def apply(batches):
        model = shared.value
        if model is not None and model.toxic not in TOOLS:  # once per worker
            TOOLS[model.toxic] = compressor(model.ordinary), compressor(model.toxic)
        for batch in slices(batches, most=SLICE):
            score = np.zeros(len(batch))
            if model is not None:
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                counts = (counted(texts, *TOOLS[model.toxic]) - model.mean) / model.scale
                score = 1 / (1 + np.exp(-np.clip(counts @ model.weights[:-1] + model.weights[-1], -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["_key", "score"])

    return apply


def scores(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``score`` and ``predicted`` of every row; only key and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(_scored(shared), extended(rows.select("_key"), score="double")).select(
        F.col("_key").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
