"""Prefix trie of conversations, by collapsing whole sequences.

Conversations are rebuilt from the opening turns of another and their own remaining ones. Identical rebuilt conversations
are grouped into one weighted sequence with the list of its ids. Sequences that are proper prefixes of others are
dropped by an anti-join, which leaves the trie's leaves. Then each distinct sequence's prefixes are added up with its
weight: members, leaves below and words below are sums over sequences, the smallest member is a minimum.

A node is the pair of its depth and a 124-bit polynomial hash of its turns. No conversation is collected: turns are
range-sorted by conversation and place, which splits a long one over tasks, each task keeps running sums from 0, and
the tasks' last rows, one per task, give what earlier tasks have to add. Only narrow rows (ids, hashes, word counts) move.
End lists are joined in sorted pieces where they lie, and only the pieces meet to be hashed, one after the other.

Every node's last text is counted once below its ancestors: a node belongs to the sequence of its smallest member, which
owns an unbroken run of nodes at its end, so one number per sequence tells which of its words are its own.

Defined results: null roles and texts are empty; turns of equal number are ordered by a hash of role and text, a null turn
comes first; rows without a conversation id are left out; ids must be integers; a conversation rebuilt without turns
ends at the root; repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.llm.common import rereadable, written

WORD = r"[^\x20\x09-\x0D]+"
FAMILY, OPENINGS = 20, 4  # conversations that share openings; an opening has fewer turns than OPENINGS
# The four largest primes below 2**31, and a base for each.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.int64)
BASES = np.array([1103515269, 739391381, 1640531513, 362436077], np.int64)
PIECE = 1 << 20
NODE = ("depth", "a", "b")


def _powers(lane: int, exponents: np.ndarray) -> np.ndarray:
    """BASES ** exponents modulo the lane's prime."""
    prime, square = int(PRIMES[lane]), int(BASES[lane])
    result, left = np.ones(len(exponents), np.int64), exponents.copy()
    while left.any():
        result = np.where(left & 1, result * square % prime, result)
        square, left = square * square % prime, left >> 1
    return result


def _lanes(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Four 31-bit numbers from two 64-bit ones."""
    mask = (1 << 31) - 1
    return np.stack([high & mask, (high >> 31) & mask, low & mask, (low >> 31) & mask])


def _joined(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return lanes[0] | lanes[1] << 31, lanes[2] | lanes[3] << 31


def _running(batches):
    """Rows (conv, h1, h2, words) in order, with the task's running depth, hash and words of each conversation, from 0."""
    part, at = TaskContext.get().partitionId(), 0
    first = last = None
    depth, state, words_before = 0, np.zeros(4, np.int64), 0  # of the conversation under way
    for batch in batches:
        if not len(batch):
            continue
        conv, high, low, words = (np.asarray(c, dtype=np.int64) for c in batch.columns)
        n = len(conv)
        starts = np.concatenate([[conv[0] != last or last is None], conv[1:] != conv[:-1]])
        if starts[0]:
            depth, state, words_before = 0, np.zeros(4, np.int64), 0
        begin = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        going = np.cumsum(starts) == 0  # rows of a conversation that an earlier batch began
        ranks = np.arange(n) - begin + 1 + np.where(going, depth, 0)
        terms = _lanes(high, low)
        after = np.empty_like(terms)
        before = np.empty_like(terms)
        for lane in range(4):
            prime = PRIMES[lane]
            term = terms[lane] % prime * _powers(lane, ranks) % prime
            total = np.cumsum(term)
            base = total[begin] - term[begin]
            after[lane] = (total - base + np.where(going, state[lane], 0)) % prime
            before[lane] = (after[lane] - term) % prime
        counted = np.cumsum(words)
        upto = counted - (counted[begin] - words[begin]) + np.where(going, words_before, 0)
        first = conv[0] if first is None else first
        a, b = _joined(after)
        pa_, pb = _joined(before)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, np.int32)), pa.array(at + np.arange(n)), pa.array(conv), pa.array(conv == first),
             pa.array(ranks), pa.array(a), pa.array(b), pa.array(pa_), pa.array(pb), pa.array(words), pa.array(upto - words)],
            names=["part", "place", "conv", "opens", "depth", "a", "b", "pa", "pb", "words", "before"])
        at, last = at + n, conv[-1]
        depth, state, words_before = int(ranks[-1]), after[:, -1].copy(), int(upto[-1])


RUN = "part int, place long, conv long, opens boolean, depth long, a long, b long, pa long, pb long, words long, before long"
PATH = "conv long, depth long, a long, b long, pa long, pb long, words long, before long"


def _split(a: int, b: int) -> list[int]:
    mask = (1 << 31) - 1
    return [a & mask, a >> 31, b & mask, b >> 31]


def _carried(run: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """What the tasks before add to the conversation that a task goes on with: one row per task reaches the driver."""
    ends = run.groupBy("part").agg(F.min(F.struct("place", "conv")).alias("start"), F.max(
        F.struct("place", "conv", "depth", "a", "b", (F.col("before") + F.col("words")).alias("words"))).alias("end")).collect()
    offsets, conv, carry = {}, None, (0, [0] * 4, 0)
    for r in sorted(ends, key=lambda r: r.part):
        own = (r.end.depth, _split(r.end.a, r.end.b), r.end.words)
        if r.start.conv == conv:
            offsets[r.part] = carry
            if r.end.conv == conv:
                own = (carry[0] + own[0],
                       [(c + pow(int(g), carry[0], int(p)) * o) % int(p) for c, o, g, p in zip(carry[1], own[1], BASES, PRIMES)],
                       carry[2] + own[2])
        conv, carry = r.end.conv, own
    return offsets


def _continued(offsets: dict[int, tuple[int, list[int], int]]):
    def apply(batches):
        for batch in batches:
            part, opens = np.asarray(batch.column("part")), np.asarray(batch.column("opens"))
            columns = {c: np.asarray(batch.column(c)).copy() for c in ("conv", "depth", "a", "b", "pa", "pb", "words", "before")}
            for p in np.unique(part[opens]).tolist():
                if p not in offsets:
                    continue
                depth, state, words = offsets[p]
                mine = opens & (part == p)
                for high, low in (("a", "b"), ("pa", "pb")):
                    lanes = _lanes(columns[high][mine], columns[low][mine])
                    for lane in range(4):
                        prime = int(PRIMES[lane])
                        lanes[lane] = (state[lane] + pow(int(BASES[lane]), depth, prime) * lanes[lane]) % prime
                    columns[high][mine], columns[low][mine] = _joined(lanes)
                columns["depth"][mine] += depth
                columns["before"][mine] += words
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))

    return apply


def turns(frame: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Narrow turns: row, conversation, turn, two hashes of role and text, words of the text."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    return frame.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.xxhash64(*said).alias("h1"), F.xxhash64(F.lit(1), *said).alias("h2"),
        F.regexp_count(said[1], F.lit(WORD)).cast("long").alias("words"))


def rebuilt(said: DataFrame, family: int = FAMILY, openings: int = OPENINGS) -> tuple[DataFrame, DataFrame]:
    """(conversations, prefixes): every id, and a row of ``PATH`` for every turn of every rebuilt conversation."""
    own_h = F.crc32(F.col("conv").cast("string").cast("binary")) % openings
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2", "row")
    # Few rows per conversation: those of higher rank are dropped before the shuffle as well.
    openers = written(said.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") < openings), "trie-openers")
    convs = openers.filter("rank = 1").select("conv", own_h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    heads = openers.filter(F.col("conv") % family == 0).select(F.col("conv").alias("base"), "rank", "h1", "h2", "words")
    begun = convs.filter("h > 0").join(heads, "base").filter("rank <= h").select(
        "conv", F.lit(0).alias("own"), F.lit(None).cast(said.schema["turn"].dataType).alias("turn"), "rank", "h1", "h2", "words")
    dropped = openers.filter(F.col("rank") <= own_h).select("row")
    rest = said.join(dropped, "row", "left_anti").select(
        "conv", F.lit(1).alias("own"), "turn", F.lit(0).alias("rank"), "h1", "h2", "words")
    key = ("conv", "own", "rank", "turn", "h1", "h2")
    ordered = begun.union(rest).repartitionByRange(*key).sortWithinPartitions(*key).select("conv", "h1", "h2", "words")
    run = written(ordered.mapInArrow(_running, RUN), "trie-turns")
    return convs.select("conv"), run.mapInArrow(_continued(_carried(run)), PATH)


def _pieces(batches):
    """Sorted (depth, a, b, conv) to joined ids: (depth, a, b, first, ids) of at most about ``PIECE`` characters."""
    node, first, held, size = None, None, [], 0

    def piece():
        return pa.RecordBatch.from_arrays(
            [*(pa.array([v], pa.int64()) for v in (*node, first)), pa.array([",".join(held)])], names=[*NODE, "first", "ids"])

    for batch in batches:
        for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (key != node or size > PIECE):
                yield piece()
                held, size = [], 0
            if not held:
                node, first = key, conv
            held.append(str(conv))
            size += len(held[-1]) + 1
    if held:
        yield piece()


def _digested(batches):
    """Sorted pieces to the SHA-256 of each node's whole list."""
    node, digest = None, None
    for batch in batches:
        for *key, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key != node:
                if node is not None:
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in node), pa.array([digest.hexdigest()])],
                                                     names=[*NODE, "ends_sha256"])
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if node is not None:
        yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in node), pa.array([digest.hexdigest()])],
                                         names=[*NODE, "ends_sha256"])


def end_lists(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes at which conversations (depth, a, b, conv) end."""
    key = ("conv",)
    pieces = ends.select(*NODE, *key).repartitionByRange(*NODE, *key).sortWithinPartitions(*NODE, *key).mapInArrow(
        _pieces, "depth long, a long, b long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids").mapInArrow(
        _digested, "depth long, a long, b long, ends_sha256 string")


def trie(frame: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *,
         family: int = FAMILY, openings: int = OPENINGS) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    said = turns(rereadable(frame), conv, turn, role, text)
    convs, turned = rebuilt(said, family, openings)
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"),
                         zero.alias("words"), zero.alias("before"))
    path = turned.union(roots)

    # Whole sequences with their weights and end lists.
    ends = written(path.groupBy("conv").agg(F.max(F.struct(*NODE, (F.col("before") + F.col("words")).alias("total"))).alias("end"))
                   .select("conv", "end.*"), "trie-ends")
    sequences = ends.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv").alias("conv"), F.first("total").alias("total"))
    # The prefixes of one conversation of each sequence.
    chosen = sequences.select("conv", "weight", "total", F.col("depth").alias("length"))
    steps = written(path.join(chosen, "conv"), "trie-steps")
    inner = steps.filter("depth < length").select(*NODE).distinct()
    leaves = sequences.join(inner, list(NODE), "left_anti").select("conv", F.lit(1).alias("leaf"))
    below = F.col("weight") * (F.col("total") - F.col("before"))
    nodes = written(steps.join(leaves, "conv", "left").groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.sum("weight").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(below).alias("gross"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("before").alias("before")),
        "trie-nodes")

    # Each node's words once, in the sequence that owns it.
    owners = nodes.groupBy("conv").agg(F.min("before").alias("others"))
    once = steps.join(owners, "conv").groupBy(*NODE).agg(
        F.sum(F.col("total") - F.greatest("before", "others")).alias("once"))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count("*").alias("n_children"))
    # All nodes of depth 1 have one parent, whose smallest member is one number; a popular node below is met by a join
    # that adaptive execution splits.
    least = nodes.filter("depth = 0").select("conv").first()
    shallow = nodes.filter("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least[0] if least else None).cast("long")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"),
                           F.col("conv").alias("parent_conv_id"))
    deep = nodes.filter("depth > 1").join(parents, ["depth", "pa", "pb"])
    columns = (*NODE, "conv", "n_convs", "n_leaves", "gross", "parent_conv_id")
    whole = (shallow.select(*columns).union(deep.select(*columns)).join(once, list(NODE)).join(children, list(NODE), "left")
             .join(end_lists(ends), list(NODE), "left"))
    return whole.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves", (F.col("gross") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


ORACLE = r"""
with told as (
    select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
           row_number() over (partition by conv_id order by turn nulls first) as n
    from conversations where conv_id is not null),
ids as (
    -- crc32 of the decimal id, bit by bit: a code is mixed in, -1 shifts by one bit.
    select c, c - c % 20 as base,
           xor(list_reduce(flatten(list_transform(string_split(c::varchar, ''),
                   lambda d: [ord(d)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
               lambda crc, o: case when o >= 0 then xor(crc, o) else xor(crc >> 1, (crc & 1) * 3988292384) end,
               4294967295::bigint), 4294967295::bigint) % 4 as h
    from (select distinct c from told)),
placed as (
    select i.c, 0 as own, t.n, t.role, t.text from ids i join told t on t.c = i.base and t.n <= i.h
    union all
    select i.c, 1, t.n, t.role, t.text from ids i join told t on t.c = i.c and t.n > i.h),
numbered as (
    select c, row_number() over (partition by c order by own, n) as d, role, text from placed),
whole as (
    select i.c, coalesce(list({'role': role, 'text': text} order by d) filter (d is not null), []) as turns
    from ids i left join numbered using (c) group by i.c),
prefixes as (
    select c, d, len(turns) as length, list_slice(turns, 1, d) as node,
           case when d = 0 then 0 else len(regexp_extract_all(turns[d].text, '[^\x20\x09-\x0D]+')) end as words
    from whole, range(0, 1000) r(d) where d <= len(turns)),
nodes as (
    select d as depth, node, min(c) as conv_id, count(*) as n_convs, any_value(words) as words,
           sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (d = length), '')) as ends_sha256
    from prefixes group by d, node),
linked as (
    select n.*, p.conv_id as parent_conv_id, p.node as parent_node
    from nodes n left join nodes p on p.depth = n.depth - 1 and p.node = list_slice(n.node, 1, n.depth - 1)),
children as (
    select parent_node as node, count(*) as n_children from linked where depth > 0 group by all),
counted as (
    select l.*, coalesce(n_children, 0) as n_children from linked l left join children using (node)),
below as (
    select p.node, sum((u.n_convs - 1) * u.words) as saved, count(*) filter (u.n_children = 0) as leaves
    from counted u join prefixes p on p.c = u.conv_id and p.d <= u.depth group by p.node)
select conv_id, depth::bigint as depth, parent_conv_id, n_convs::bigint as n_convs, n_children::bigint as n_children,
       leaves::bigint as n_leaves, saved::bigint as saved_tokens, ends_sha256
from counted join below using (node)
"""
