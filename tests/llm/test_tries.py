import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from promptsieve.llm import tries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """Nodes of the trie of (conv, turn, role, text) rows whose turns do not tie, as a set of result rows."""
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(v)] for c, v in said.items()}
    whole = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(said.get(c - c % 20, [])[:h] + said[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, ids in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(ids) - 1) * (len(WORDS.findall(node[-1][1])) if node else 0)
            leaves[node[:d]] += not children[node]
    return sorted((min(ids), len(node), min(members[node[:-1]]) if node else -1, len(ids), children[node], leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, ids in members.items())


def found(frame):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in frame.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_the_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/conversations.parquet")
    assert found(tries.trie(frame)) == plain([(r.conv_id, r.turn, r.role, r.text) for r in frame.collect()])


def test_shared_openings_repeats_and_prefixes(spark, monkeypatch):
    monkeypatch.setattr(tries, "PIECE", 40)  # end lists of several pieces
    rng = np.random.default_rng(3)
    rows = []
    for c in range(400):
        kind = rng.integers(4)
        length = rng.integers(0, 6) if kind else 4
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"a b {0 if kind < 2 else rng.integers(3)} {t}") for t in range(length)]
    rows.append((1000, 5, None, None))
    assert found(tries.trie(table(spark, rows))) == plain(rows)


@pytest.mark.parametrize("batch", [None, "7"])
def test_a_conversation_over_many_tasks(spark, batch):
    """Most turns in two conversations, one the other's opening part, over range partitions and small batches."""
    rows = [(c, t, "user", f"turn {t} of many") for c in (20, 41, 60) for t in range(700 if c < 60 else 650)]
    rows += [(c, t, "user", "short") for c in range(5, 12) for t in range(2)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions",
                                           "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        if batch:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert found(tries.trie(table(spark, rows))) == plain(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, "second"), (1, -3, "user", None), (2, 0, "user", ""), (None, 0, "user", "lost"),
            (-7, 0, "user", "négatif 🙂"), (20, 0, "user", "x " * 50_000), (20, 1, "user", "y"), (21, 0, "user", "z"), (22, 0, "a", "q")]
    assert found(tries.trie(table(spark, rows))) == plain(rows)
    extra = table(spark, rows).selectExpr("*", "1 as depth", "'k' as conv", "2 as row", "3 as a", "4 as h1")
    assert found(tries.trie(extra)) == plain(rows)
    assert tries.trie(table(spark, [])).count() == 0
    # Turns of equal number and repeated rows: each is a turn, in the same order wherever they occur.
    tied = [(40, 1, "user", "b"), (40, 1, "user", "a"), (40, 1, "user", "a"), (40, 1, "user", "c"), (40, 1, "user", "d")]
    nodes = tries.trie(table(spark, tied)).collect()
    assert sorted(r.depth for r in nodes) == [0, 1, 2, 3, 4, 5] and {r.n_leaves for r in nodes} == {1}
    assert found(tries.trie(table(spark, tied[::-1]))) == found(tries.trie(table(spark, tied)))
