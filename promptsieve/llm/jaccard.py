"""Similarity join of documents on the Jaccard index of their word n-gram sets.

Prefix filtering: with a document's n-grams in one global order, rare first, two documents of
the wanted similarity share an n-gram of their prefixes. The order is the corpus frequency of the
n-gram's bucket in a count sketch of fixed size over all documents, then the n-gram's hash; any order is
exact, a rare-first one makes postings short. Postings meet in a join on prefix n-grams, filtered by
length, position and, per pair, by a bound on the overlap from the sets' histograms over the hash range
(the suffix filter's idea of bounding the rest by the sizes of its parts). Each surviving pair
is verified once, by intersecting the whole sets.

What is wanted are the connected documents, not all pairs: a posting of k near copies has k(k-1)/2 of
them. So first every member of a posting is tested against two members (all pairs of a posting of two):
the one whose prefix has fewest n-grams of its own, of a family the least edited, and one drawn by hash.
Both are the same in all postings of a family. The verified links are contracted to components, members
outside the largest component of a posting are tested against two more, and components are formed
anew. Then, exactly, the pairs of a posting that are still in different components are tested, except
that the members of its largest component need not be paired among themselves. No link between
different components is left untested, and a group of copies costs its size, not its square.

N-grams are hashed to 64 bits; sets and intersections are of hashes.

Defined results: words are runs of other than ASCII white space, A-Z in lower case; a document of fewer
words than n has its whole sequence as its only n-gram; a null, empty or white-space text has none and
is linked with nothing; rows with equal word sequences are linked; rows are told apart by their place in
the input, so ids may be null or repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import bit_of, bitmap, extended, flags, folded, passed, rereadable, slices, written
from promptsieve.llm.graph import components

CELLS, BLOCK = 1 << 22, 4096
PARTS = 64
GRAM_BITS = 1 << 26
KNOWN = 150_000
SLICE = 4 << 20


# Postings of which not every pair meets in the first round; of three members two different ones meet all.
OPEN = "members > 3 or members = 3 and one.row = two.row"


# The classes of operator 2 in SQL: equal sets collapse to their least id, links are counted over shared shingles, and the least id
# spreads along them. Shingles are separated by a character that is no word's.
ORACLE = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) end as grams from worded),
owned as (
  select doc_id, len(grams) as n, case when len(grams) = 0 then doc_id else min(doc_id) over (partition by grams) end as rep, grams from sets),
reps as (select rep, n, grams from owned where rep = doc_id and n > 0),
listed as (select rep, n, unnest(grams) as gram from reps),
links as (
  select a.rep as a, b.rep as b from listed a join listed b on a.gram = b.gram and a.rep <> b.rep
  and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (
  select rep, rep as other from reps union select r.rep, l.b from reach r join links l on l.a = r.other)
select o.doc_id, cast(o.n as bigint) as n_shingles, coalesce(c.least, o.doc_id) as component_id
from owned o left join (select rep, min(other) as least from reach group by rep) c on o.rep = c.rep
"""


class Hashes(dict):
    """64-bit hash of each word met; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


HASHES = Hashes()
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def grams(words: list[bytes], n: int) -> np.ndarray:
    """Hashes of the n-grams in text order; the whole sequence's if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    size = min(n, len(codes))
    mixed = np.full(len(codes) - size + 1, size, np.uint64)
    for i in range(size):
        mixed += codes[i:len(codes) - size + 1 + i] * ODD[i]
    mixed ^= mixed >> np.uint64(29)
    mixed *= ODD[7]
    return mixed ^ (mixed >> np.uint64(32))


def gram_set(text: bytes, n: int) -> np.ndarray:
    return np.unique(grams(words_of(text), n))


def _cells(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(42)).astype(np.int64)


def frequencies(rows: DataFrame, n: int) -> np.ndarray:
    """Per sketch cell in how many documents' sets its n-grams are; rows are (row, key, text)."""
    def blocks(batches):
        held = np.zeros(CELLS, np.uint32)
        for batch in slices(batches, 2, SLICE):
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                np.add.at(held, _cells(gram_set(text, n)), 1)
        for at in range(0, CELLS, BLOCK):
            if held[at:at + BLOCK].any():
                yield at // BLOCK, held[at:at + BLOCK]

    return folded(rows, blocks, CELLS, BLOCK)


def _prefixes(shared, n: int, num: int, den: int):
    """(row, key, text) to one row each: local representative, set size, digest, histogram, prefix."""
    def flush(rows, keys, reps, sizes, digests, parts, prefixes):
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), keys, pa.array(reps, pa.int64()), pa.array(sizes, pa.int64()),
             pa.array(digests, pa.binary()), pa.array(parts, pa.list_(pa.int8())), pa.array(prefixes, pa.list_(pa.int64()))],
            names=["_row", "_key", "_rep", "_size", "_digest", "_parts", "_prefix"])

    def apply(batches):
        order = shared.value
        seen: dict[bytes, int] = {}
        for batch in slices(batches, 2, SLICE):
            reps, sizes, digests, parts, prefixes = [], [], [], [], []
            rows = batch.column(0).to_pylist()
            for row, text in zip(rows, batch.column(2).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                rep = seen.setdefault(digest, row)
                if len(seen) > KNOWN:
                    seen.clear()
                codes = np.unique(grams(words, n))
                reps.append(rep)
                sizes.append(len(codes))
                if rep != row or not len(codes):
                    digests.append(None)
                    parts.append(None)
                    prefixes.append(None)
                    continue
                size = len(codes)
                length = size - -(-num * size // den) + 1
                ranked = codes[np.lexsort((codes, order[_cells(codes)]))[:length]]
                digests.append(digest)
                part = np.bincount((codes >> np.uint64(58)).astype(np.int64), minlength=PARTS)
                parts.append(part.astype(np.int8) if part.max() < 128 else None)  # none: nothing is ruled out
                prefixes.append(ranked.view(np.int64))
            yield flush(rows, batch.column(1), reps, sizes, digests, parts, prefixes)

    return apply


def _sets(shared, n: int):
    def apply(batches):
        bits = shared.value
        for batch in batches:
            keep = passed(bits, batch.column(3))
            if not keep.any():
                continue
            batch = batch.filter(pa.array(keep))
            for part in slices(iter([batch]), 2, SLICE):
                codes = [gram_set(t, n).view(np.int64) for t in part.column(2).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.list_(pa.int64()))],
                                                 names=["_row", "_set"])

    return apply


def _marked(shared):
    """(row, n, pos, seen, own, gram, centre) of the prefix n-grams whose bit is set: all shared ones and few others.

    ``seen`` is how many of them come before in the prefix; the document's own n-grams there are in no
    other prefix that reaches as far, so only these can be common; ``own`` is how many those are. ``centre`` ranks documents as representatives: least the one whose prefix has fewest n-grams of its
    own, which of a family of near copies is the least edited one.
    """
    def apply(batches):
        bits = shared.value
        for batch in batches:
            prefixes = batch.column(2)
            lengths = np.asarray(pa.compute.list_value_length(prefixes), dtype=np.int64)
            grams_ = prefixes.flatten()
            owner = np.repeat(np.arange(len(lengths)), lengths)
            pos = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            codes = np.asarray(grams_)
            kept = np.flatnonzero(passed(bits, pa.array(codes & (GRAM_BITS - 1))))
            rows = np.asarray(batch.column(0))
            own = lengths - np.bincount(owner[kept], minlength=len(lengths))
            drawn = (rows.astype(np.uint64) * ODD[0] >> np.uint64(32)).astype(np.int64)
            centre = (own << 32) + drawn
            at = owner[kept]
            count = np.bincount(at, minlength=len(lengths))
            seen = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[at]), pa.array(np.asarray(batch.column(1))[at]), pa.array(pos[kept].astype(np.int32)),
                 pa.array(seen.astype(np.int32)), pa.array(own[at].astype(np.int32)), pa.array(codes[kept]),
                 pa.array(centre[at])], names=["row", "n", "pos", "seen", "own", "gram", "centre"])

    return apply


def _drawn(code):
    """The member of least code that is not null."""
    return F.struct(*(F.min_by(c, code).alias(c) for c in ("row", "n", "pos", "seen", "own")))


class Join:
    """The steps of one join; ``num / den`` is the least similarity."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int, key: str, text: str):
        self.n, self.num, self.den = n, num, den
        self.spark = docs.sparkSession
        self.rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{key}`").alias("_key"),
                                F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
        # Before a shared n-gram at most the shared ones of either are common, after it what either has left.
        # And of the two, the document whose prefix ends first in the order has its own n-grams there alone.
        self.enough = f"{num + den} * {{overlap}} >= {num} * (n_a + n_b)"
        self.allowed = f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b) and " + self.enough.format(
            overlap="(least(seen_a, seen_b) + 1 + least(n_a - pos_a - 1, n_b - pos_b - 1))") + " and " + self.enough.format(
            overlap="greatest(n_a - own_a, n_b - own_b)")

    def prepared(self) -> DataFrame:
        order = self.spark.sparkContext.broadcast(frequencies(self.rows, self.n))
        schema = extended(self.rows.select("_row", "_key"), _rep="long", _size="long", _digest="binary",
                          _parts="array<tinyint>", _prefix="array<bigint>")
        prepared = written(self.rows.mapInArrow(_prefixes(order, self.n, self.num, self.den), schema), "join-prefixes")
        order.destroy()
        return prepared

    def postings(self, prepared: DataFrame) -> DataFrame:
        """Members of prefix n-grams that two documents or more have, with two members that represent them."""
        num, den = self.num, self.den
        listed = prepared.filter("_prefix is not null")
        shared = listed.select(F.explode("_prefix").alias("gram")).groupBy("gram").count().filter("count > 1")
        bits = self.spark.sparkContext.broadcast(flags(
            shared.select(F.col("gram").bitwiseAND(F.lit(GRAM_BITS - 1)).cast("int").alias("bit")), GRAM_BITS))
        members = listed.select("_row", "_size", "_prefix").mapInArrow(
            _marked(bits), "row long, n long, pos int, seen int, own int, gram long, centre long")
        # The smaller document of a linked pair has a shared n-gram in this shorter prefix.
        short = f"pos <= n - cast(ceil({2 * num} * n / {num + den}) as bigint)"
        members = written(members.select("gram", "row", "n", "pos", "seen", "own", "centre", F.expr(short).alias("short")), "join-members")
        bits.destroy()
        hubs = members.groupBy("gram").agg(
            F.count("*").alias("members"), _drawn(F.col("centre")).alias("one"),
            _drawn(F.xxhash64("row")).alias("two")).filter("members > 1")
        return written(members.join(hubs, "gram"), "join-postings")

    def _filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, n_a, pos_a, seen_a, b, ...) that length and position allow, each once."""
        return pairs.filter(self.allowed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verified(self, pairs: DataFrame, prepared: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar enough."""
        known = prepared.filter("_prefix is not null").select("_row", "_size", "_digest", "_parts")

        def side(frame, name, columns):
            return frame.select(F.col("_row").alias(name), *(F.col(c).alias(f"{c[1:]}_{name}") for c in columns))

        both = (pairs.join(side(known, "a", ["_size", "_digest", "_parts"]), "a")
                .join(side(known, "b", ["_size", "_digest", "_parts"]), "b")
                .withColumnsRenamed({"size_a": "n_a", "size_b": "n_b"}))
        bound = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x.cast("int"))
        left = written(both.withColumn("bound", F.coalesce(bound, F.least("n_a", "n_b"))).withColumn("equal", F.expr("digest_a = digest_b"))
                       .filter("equal or " + self.enough.format(overlap="bound"))
                       .select("a", "b", "n_a", "n_b", "equal"), "join-candidates")
        rest = left.filter("not equal")
        bits = self.spark.sparkContext.broadcast(
            bitmap(rest.select(F.explode(F.array("a", "b")).alias("row")), "row"))
        sets = written(self.rows.withColumn("_bit", bit_of(F.col("_row"))).mapInArrow(
            _sets(bits, self.n), "_row long, _set array<bigint>"), "join-sets")
        bits.destroy()
        overlap = F.size(F.array_intersect("set_a", "set_b"))
        checked = (rest.join(side(sets, "a", ["_set"]), "a").join(side(sets, "b", ["_set"]), "b")
                   .withColumn("overlap", overlap).filter(self.enough.format(overlap="overlap")))
        return left.filter("equal").select("a", "b").union(checked.select("a", "b"))

    def links(self, prepared: DataFrame) -> DataFrame:
        """(node, component) of linked representatives."""
        postings = self.postings(prepared)
        pairs = written(self._filtered(self._against(postings, F.array("one", "two"))), "join-pairs")
        found = written(self.verified(pairs, prepared), "join-links")
        groups = components(found)
        # Once more for members still apart from the largest component of their posting.
        named = self._named(postings.filter(OPEN), groups)
        apart = named.filter("part <> largest")
        hubs = named.groupBy("gram").agg(
            _drawn(F.when(F.col("part") == F.col("largest"), F.col("centre"))).alias("three"),
            _drawn(F.when(F.col("part") != F.col("largest"), F.col("centre"))).alias("four"))
        more = written(self._filtered(self._against(apart.join(hubs, "gram"), F.array("three", "four")))
                       .join(pairs, ["a", "b"], "left_anti"), "join-pairs")
        again = written(self.verified(more, prepared), "join-links")
        if not again.isEmpty():
            found = found.union(again)
            groups = components(found)
            named = self._named(postings.filter(OPEN), groups)
        rest = self._across(named).join(pairs.union(more), ["a", "b"], "left_anti")
        last = written(self.verified(rest, prepared), "join-links")
        return groups if last.isEmpty() else components(found.union(last))

    @staticmethod
    def _against(members: DataFrame, hubs) -> DataFrame:
        """Every member with the documents that represent its posting."""
        names = ("row", "n", "pos", "seen", "own")
        return members.select(*names, F.explode(hubs).alias("hub")).select(
            *(F.col(c).alias(f"{c}_a" if c != "row" else "a") for c in names),
            *(F.col(f"hub.{c}").alias(f"{c}_b" if c != "row" else "b") for c in names)).filter("a <> b")

    @staticmethod
    def _named(postings: DataFrame, groups: DataFrame) -> DataFrame:
        """Postings that hold several components, their members with their own and the largest one."""
        members = postings.select("gram", "row", "n", "pos", "seen", "own", "centre", "short").join(
            groups.withColumnRenamed("node", "row"), "row", "left").withColumn("part", F.coalesce("component", "row"))
        members = written(members.drop("component"), "join-named")
        largest = (members.groupBy("gram", "part").agg(F.count("*").alias("many"))
                   .groupBy("gram").agg(F.max_by("part", "many").alias("largest"), F.count("*").alias("parts"))
                   .filter("parts > 1").drop("parts"))
        return written(members.join(largest, "gram"), "join-named")

    def _across(self, named: DataFrame) -> DataFrame:
        """The pairs of a posting that are in different components."""
        def side(frame, name):
            return frame.select("gram", F.col("row").alias(name), *(
                F.col(c).alias(f"{c}_{name}") for c in ("n", "pos", "seen", "own", "short", "part")), "largest")

        a, b = side(named.filter("part <> largest"), "a").drop("largest"), side(named, "b")
        pairs = a.join(b, "gram").filter(
            "part_a <> part_b and (part_b = largest or a < b) and "
            f"case when n_a < n_b then short_a when n_b < n_a then short_b else short_a or short_b end and {self.allowed}")
        return self._filtered(pairs)


def classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, ``n_shingles``, ``component_id``, the smallest key that links reach
    (null if none has a key), the row's place ``_row`` and its component's name ``part``."""
    join = Join(rereadable(docs), n, num, den, key, text)
    prepared = join.prepared()
    groups = join.links(prepared)
    members = prepared.select("_row", "_key", "_size", F.when(F.col("_size") > 0, F.col("_rep")).otherwise(F.col("_row")).alias("node"))
    named = members.join(groups, "node", "left").withColumn("part", F.coalesce("component", "node"))
    named = written(named.select("_row", "_key", "_size", "part"), "join-members")
    least = named.groupBy("part").agg(F.min("_key").alias("least"))
    return named.join(least, "part").select(
        F.col("_key").alias(key), F.col("_size").alias("n_shingles"), F.col("least").alias("component_id"),
        "_row", "part")


def deduplicated(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked rows, that of the smallest key (then first read), with the columns
    of ``docs``.

    Rows to drop are named by their place. A row whose bit is unset surely stays and is passed on
    where it is read; only the others meet the exact list.
    """
    docs = rereadable(docs)
    found = classes(docs, n, num, den, key, text).select("_row", F.col(key).alias("_key"), "part")
    best = found.groupBy("part").agg(F.min(F.struct(F.col("_key").isNull(), "_key", "_row")).alias("best"))
    dropped = written(found.join(best, "part").filter("_row <> best._row").select("_row"), "join-dropped")
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(dropped, "_row"))
    marked = numbered.withColumn("_bit", bit_of(F.col("_row")))

    def chosen(wanted: bool):
        def apply(batches):
            for batch in batches:
                keep = passed(bits.value, batch.column(2)) == wanted
                if keep.any():
                    yield batch.filter(pa.array(keep))
        return marked.mapInArrow(apply, extended(marked))

    sure = chosen(False).select("_doc")
    rest = chosen(True).join(dropped, "_row", "left_anti").select("_doc")
    return sure.union(rest).select("_doc.*")

