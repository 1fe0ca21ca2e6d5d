"""Byte-level BPE encoding and decoding by DuckDB recursive queries, partition by partition.

A partition's texts are split into words by the vocabulary's pattern; words not met before become
token-position rows, one per byte. A recursive query joins neighbouring rows with the merge
table, takes in each word the pair of least rank (the leftmost of equal ones) and contracts it, until no
word has a pair left. Documents are then concatenations of their words' ids. Decoding turns a
document's ids back into rows, joins them with the vocabulary and aggregates the bytes in order.

The merge table is a consequence of the ranks: every split of a token into two tokens. A word that is a
token as a whole gets that id at once, as the public library does.

Defined results: a null or empty text has no ids and decodes to the empty string; every row is
encoded, repeated ones too. Memory is bounded by the slice of texts in hand and a cache of
``CACHE`` words per worker, which is emptied when full. A text of more than ``PIECE`` characters is
encoded in pieces, cut where no word can lie across, and ids are decoded ``IDS`` at a time, so DuckDB's
tables do not grow with one text. The recursion keeps the rows of every round,
so its cost grows with the square of a word's length; words of over ``LONG`` bytes (unbroken runs of
one kind of character, such as rulers or encoded data) are contracted in the same order from a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import extended, slices
from promptsieve.llm.words import split

CACHE = 1_200_000
SLICE = 4 << 20
LONG = 128
BLOCK = 1 << 19
PIECE = 1 << 20
IDS = 1 << 18
# No word of the pattern lies across: before white space, and between punctuation other than an apostrophe and
# a letter or number.
BORDER = re.compile(r"\S(?=[ \n])|[!-&(-/:-@[-^{-~、。，！？](?=[^\W_])")

# A row's ``best`` is its word's next contraction, rank and position in one number; null at the fixpoint.
STEP = """
with recursive state(word, pos, tok, best) as (
    select word, pos, tok, min(m.merged::bigint << 20 | pos) over (partition by word) from
      (select word, pos, tok, lead(tok) over (partition by word order by pos) as after from bytes_of) s
      left join merges m on m.lft = s.tok and m.rgt = s.after
  union all
    (with contracted as (
        select word, pos,
               case when pos = spot then merged else tok end as tok,
               case when pos = spot then second when next = spot then merged else first end as after
        from (select word, pos, tok, best & 1048575 as spot, (best >> 20)::int as merged,
                     lag(pos) over w as prior, lead(pos) over w as next,
                     lead(tok) over w as first, lead(tok, 2) over w as second
              from state where best is not null window w as (partition by word order by pos))
        where prior is distinct from spot),
     paired as (select c.word, c.pos, c.tok, m.merged::bigint << 20 | c.pos as pair
                from contracted c left join merges m on m.lft = c.tok and m.rgt = c.after),
     least as (select word, min(pair) as best from paired group by word)
     select p.word, p.pos, p.tok, l.best from paired p join least l using (word)))
select word, list(tok order by pos) from state where best is null group by word"""

DECODE = """
select doc, string_agg(hex, '' order by pos) from encoded join vocabulary using (id) group by doc"""


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in pieces of a little over ``most`` characters, whose words together are the text's words."""
    start = 0
    while len(text) - start > most and (border := BORDER.search(text, start + most)):
        yield text[start:border.end()]
        start = border.end()
    yield text[start:]


class Codec:
    """One worker's DuckDB connection with the vocabulary, the merges and the words met so far."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items()
                  for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        lft, rgt, merged = (pa.array(c, pa.int32()) for c in zip(*merges))
        self._table("merges", pa.table({"lft": lft, "rgt": rgt, "merged": merged}))
        self._table("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()),
                                            "hex": pa.array([t.hex() for t in self.ranks])}))
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("rows_in", rows)
        self.con.execute(f"create or replace table {name} as select * from rows_in")
        self.con.unregister("rows_in")

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, by the recursive query in blocks of bounded size."""
        block, size = [], 0
        for word in words:
            raw = word.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.known[word] = whole.to_bytes(4, "little")
                continue
            if len(raw) > LONG:
                self.known[word] = self._long(raw)
                continue
            block.append((word, raw))
            size += len(raw)
            if size > BLOCK:
                self._contract(block)
                block, size = [], 0
        if block:
            self._contract(block)

    def _contract(self, block) -> None:
        lengths = np.array([len(raw) for _, raw in block])
        number = np.repeat(np.arange(len(block)), lengths)
        pos = np.arange(len(number)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        tok = self.byte[np.frombuffer(b"".join(raw for _, raw in block), np.uint8)]
        self.con.register("bytes_of", pa.table({"word": pa.array(number, pa.int32()), "pos": pa.array(pos, pa.int32()),
                                                "tok": pa.array(tok)}))
        result = self.con.sql(STEP).to_arrow_table()
        self.con.unregister("bytes_of")
        ids = result.column(1).combine_chunks()
        flat = np.asarray(ids.flatten(), dtype="<u4").tobytes()
        ends = np.cumsum(np.asarray(pa.compute.list_value_length(ids))) * 4
        start = 0
        for n, end in zip(result.column(0).to_pylist(), ends.tolist()):
            self.known[block[n][0]] = flat[start:end]
            start = end

    def _long(self, raw: bytes) -> bytes:
        """A long word's ids: least rank first, leftmost of equal ranks, neighbours in a linked list."""
        ends = array("i", range(1, len(raw) + 1))      # of the token that starts here
        before = array("i", range(-1, len(raw) - 1))   # start of the token on the left

        def rank(i):
            return self.ranks.get(raw[i:ends[ends[i]]]) if ends[i] < len(raw) else None

        # Rank, start and end of a pair in one number.
        heap = [r << 64 | i << 32 | i + 2 for i in range(len(raw) - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            least = heapq.heappop(heap)
            i, end = least >> 32 & 0xFFFFFFFF, least & 0xFFFFFFFF
            if ends[i] < 0 or ends[i] == len(raw) or ends[ends[i]] != end:
                continue  # one of the two has been contracted since
            gone = ends[i]
            ends[i], ends[gone] = end, -1
            if end < len(raw):
                before[end] = i
            for j in (before[i], i):
                if j >= 0 and (r := rank(j)) is not None:
                    heapq.heappush(heap, r << 64 | j << 32 | ends[ends[j]])
        ids, i = array("i"), 0
        while i < len(raw):
            ids.append(self.ranks[raw[i:ends[i]]])
            i = ends[i]
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        short = iter(self._encode([t for t in texts if len(t) <= PIECE]))
        return [next(short) if len(t) <= PIECE else b"".join(self._encode([p])[0] for p in pieces(t)) for t in texts]

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts = [split(t) for t in texts]
        fresh = {w for p in parts for w in p if w not in self.known}
        if len(self.known) + len(fresh) > CACHE:
            self.known = {}
            fresh = {w for p in parts for w in p}
        self._learn(list(fresh))
        known = self.known.__getitem__
        return [b"".join(map(known, p)) for p in parts]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """Bytes of each text's ids."""
        ids = np.frombuffer(b"".join(encoded), "<u4").view("<i4")
        ends = np.cumsum([len(e) // 4 for e in encoded], dtype=np.int64)
        decoded: list[list[bytes]] = [[] for _ in encoded]
        for start in range(0, len(ids), IDS):
            pos = np.arange(start, min(start + IDS, len(ids)))
            doc = np.searchsorted(ends, pos, side="right")
            self.con.register("encoded", pa.table({"doc": pa.array(doc, pa.int32()), "pos": pa.array(pos, pa.int32()),
                                                   "id": ids[start:start + IDS]}))
            for n, text in self.con.execute(DECODE).fetchall():
                decoded[n].append(bytes.fromhex(text))
            self.con.unregister("encoded")
        return [b"".join(d) for d in decoded]


CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This process's codec; built once per worker."""
    if path not in CODECS:
        CODECS[path] = Codec(path)
    return CODECS[path]


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` bytes of every row."""
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))

    def apply(batches):
        own = codec(path)
        for batch in slices(batches, most=SLICE):
            encoded = own.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(encoded, pa.binary()), pa.array(own.decode(encoded), pa.binary())],
                names=["_key", "ids", "decoded"])

    return rows.mapInArrow(apply, extended(rows.select("_key"), ids="binary", decoded="binary")) \
        .withColumnRenamed("_key", key)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The round trip's digests, taken in the same task so that ids and bytes need not leave it."""
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))

    def apply(batches):
        own = codec(path)
        for batch in slices(batches, most=SLICE):
            encoded = own.encode(batch.column(1).to_pylist())
            decoded = own.decode(encoded)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(e) // 4 for e in encoded], pa.int64()),
                 pa.array([hashlib.sha256(e).hexdigest() for e in encoded]),
                 pa.array([hashlib.sha256(d).hexdigest() for d in decoded])],
                names=["_key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(apply, extended(rows.select("_key"), n_tokens="long", ids_sha256="string",
                                           decoded_sha256="string")).withColumnRenamed("_key", key)
