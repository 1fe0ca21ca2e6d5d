"""Exact deduplication by Grace hashing with complete content comparison.

Every input partition is combined first: an open-addressing table that compares whole texts
replaces the rows of one content by a local representative.  Only representatives are shuffled,
by a hash of their content.  A receiving task fills the same kind of table; when the contents
exceed its memory it partitions everything to spill files by a freshly seeded hash and treats each
file alike, recursively, until a bucket fits.  The spill files are scratch space of one task.

Defined results: a null text counts as empty; equal texts form one group whatever the other
columns hold; the row with the largest key stays, a null key being the smallest, and of rows that
repeat the key too the first read; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import extended, slices, written

TABLE_BYTES = 16 << 20
FAN_OUT = 16


class ContentTable:
    """Open addressing with linear probing; a slot holds a number into the list of contents."""

    def __init__(self, seed: int = 0):
        self.seed, self.slots, self.mask = seed, [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find(self, content: bytes) -> int:
        """The number of an equal content, which is added if there is none."""
        code = xxhash.xxh3_64_intdigest(content, seed=self.seed)
        at = code & self.mask
        while (number := self.slots[at]) >= 0:
            if self.hashes[number] == code and self.contents[number] == content:
                return number
            at = (at + 1) & self.mask
        number = len(self.contents)
        self.slots[at] = number
        self.hashes.append(code)
        self.contents.append(content)
        self.bytes += len(content) + 160
        if 2 * number > self.mask:
            self._grow()
        return number

    def _grow(self) -> None:
        self.mask = 4 * self.mask + 3
        self.slots = [-1] * (self.mask + 1)
        for number, code in enumerate(self.hashes):
            at = code & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = number


def _rank(key, row):
    """Larger stays: a present key before none, the larger key, then the earlier row."""
    return (key is not None, key if key is not None else 0, -row)


def _combine(limit: int):
    """Rows (row, key, text, rest...) to the same with a local representative; see ``grouped``."""

    def flush(held, table, best, sizes, digests):
        top = [b[1] for b in best]
        for batch, numbers in held:
            rows = batch.column(0).to_numpy()
            rep = np.array([top[n] for n in numbers], dtype=np.int64)
            is_rep = rep == rows
            text = pa.array([table.contents[n] if r else None for n, r in zip(numbers, is_rep)], pa.binary())
            count = np.where(is_rep, np.array([sizes[n] for n in numbers], dtype=np.int64), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), text.cast(pa.string()), *batch.columns[3:], pa.array(rep), pa.array(count),
                 pa.array([digests[n] for n in numbers], pa.binary())],
                names=[*batch.schema.names, "_rep", "_count", "_digest"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table, best, sizes, digests = [], ContentTable(), [], [], []
        for batch in slices(batches, 2):
            numbers = []
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for row, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                content = text or b""
                number = table.find(content)
                mine = (_rank(key, row), row)
                if number == len(best):
                    best.append(mine)
                    sizes.append(1)
                    digests.append(hashlib.sha256(content).digest())
                else:
                    sizes[number] += 1
                    if mine[0] > best[number][0]:
                        best[number] = mine
                numbers.append(number)
            held.append((batch, numbers))
            if table.bytes > limit:
                yield from flush(held, table, best, sizes, digests)
                held, table, best, sizes, digests = [], ContentTable(), [], [], []
        yield from flush(held, table, best, sizes, digests)

    return combine


SPILL = pa.schema([("row", pa.int64()), ("key_there", pa.bool_()), ("key", pa.int64()),
                   ("text", pa.large_binary()), ("n", pa.int64())])


def _buckets(records, level: int, folder: str):
    """Write records to ``FAN_OUT`` spill files by a hash seeded with the level; returns the paths."""
    paths = [os.path.join(folder, f"{level}-{i}-{os.urandom(6).hex()}") for i in range(FAN_OUT)]
    writers = [pa.ipc.new_stream(p, SPILL) for p in paths]
    held: list[list] = [[] for _ in range(FAN_OUT)]
    size = [0] * FAN_OUT

    def put(i):
        if held[i]:
            columns = list(zip(*held[i]))
            writers[i].write_batch(pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, SPILL)], schema=SPILL))
            held[i], size[i] = [], 0

    for record in records:
        i = xxhash.xxh3_64_intdigest(record[3], seed=1_000_003 * (level + 1)) % FAN_OUT
        held[i].append(record)
        size[i] += len(record[3])
        if size[i] > 1 << 20:
            put(i)
    for i, writer in enumerate(writers):
        put(i)
        writer.close()
    return paths


def _spilled(path: str):
    with pa.ipc.open_stream(path) as reader:
        for batch in reader:
            yield from zip(*(c.to_pylist() for c in batch.columns))


def _resolve(records, limit: int, level: int, folder):
    """(row, kept row, kept key, group size) of each record; recursion on buckets that do not fit."""
    records = iter(records)
    table, best, sizes, members = ContentTable(level), [], [], []
    for record in records:
        row, there, key, text, n = record
        number = table.find(text)
        mine = (_rank(key if there else None, row), row, key if there else None)
        if number == len(best):
            best.append(mine)
            sizes.append(n)
        else:
            sizes[number] += n
            if mine[0] > best[number][0]:
                best[number] = mine
        members.append((row, there, key, number, n))
        if table.bytes > limit and len(best) > 1:
            def everything():
                for row, there, key, number, n in members:
                    yield row, there, key, table.contents[number], n
                yield from records

            paths = _buckets(everything(), level, folder())
            del table, best, sizes, members
            for path in paths:
                yield from _resolve(_spilled(path), limit, level + 1, folder)
                os.remove(path)
            return
    for row, _, _, number, _ in members:
        yield row, best[number][1], best[number][2], sizes[number]


def _grace(limit: int):
    def grace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[str] = []

        def folder():
            if not made:
                made.append(tempfile.mkdtemp(prefix="grace-"))
            return made[0]

        def records():
            for batch in slices(batches, 2):
                texts = batch.column(2).cast(pa.binary()).to_pylist()
                for row, key, text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts,
                                             batch.column(3).to_pylist()):
                    yield row, key is not None, key or 0, text or b"", n

        try:
            out = []
            for result in _resolve(records(), limit, 0, folder):
                out.append(result)
                if len(out) == 50_000:
                    yield _result(out)
                    out = []
            if out:
                yield _result(out)
        finally:
            if made:
                shutil.rmtree(made[0], ignore_errors=True)

    return grace


def _result(rows):
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                      names=["_rep", "_keep_row", "_keep_key", "_group_size"])


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TABLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): ``rows`` holds every input row as ``_row``, ``_key``, ``_text`` (null unless the
    row represents its partition's copies), ``_null``, the other columns as ``_rest``, ``_rep`` and
    ``_digest``; ``groups`` maps each ``_rep`` to the row and key that stay and the group's size.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    keyed = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(key).cast("bigint").alias("_key"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(text).isNull().alias("_null"),
        F.struct(*rest).alias("_rest"),
    )
    schema = extended(keyed, _rep="long", _count="long", _digest="binary")
    rows = written(keyed.mapInArrow(_combine(limit), schema), "grace-rows")
    representatives = rows.filter("_row = _rep").select("_row", "_key", "_text", "_count")
    groups = representatives.repartition(F.xxhash64("_text")).mapInArrow(
        _grace(limit), "_rep bigint, _keep_row bigint, _keep_key bigint, _group_size bigint")
    return rows, groups


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. Keys are whole numbers."""
    rows, groups = grouped(docs, key, text, limit)
    return rows.select("_row", "_key", "_rep", "_digest").join(groups, "_rep").select(
        F.col("_key").alias(key), F.col("_keep_key").alias("keep_id"), F.col("_group_size").alias("group_size"),
        (F.col("_row") == F.col("_keep_row")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    rows, groups = grouped(docs, key, text, limit)
    kept = groups.filter("_rep = _keep_row").select(F.col("_rep").alias("_row"))
    back = [F.when(~F.col("_null"), F.col("_text")).alias(c) if c == text else F.col(f"_rest.`{c}`").alias(c)
            for c in docs.columns]
    return rows.join(kept, "_row", "left_semi").select(*back)


ORACLE = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))"""
