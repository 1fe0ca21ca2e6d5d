"""Deterministic pseudo-randomness from row ids, the same on every run and engine."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SPAN = 1 << 32
BUCKETS = 4096


def unit_hash(key: Column, seed: int = 42) -> Column:
    """An integer in [0, 2**32) from the md5 of key and seed."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def mixed(key: Column, i: Column, seed: int = 42) -> Column:
    """A small integer mixed from a key and a position, by plain arithmetic."""
    base = (key % 100003) * 7919 + i.cast("bigint") * 104729 + seed * 15485863
    return F.pmod(base, F.lit(1000003))


def stratified_rank(ids: DataFrame, strata: Sequence[str], key: str = "prompt_id", seed: int = 42) -> DataFrame:
    """Adds ``rank`` (1-based, in hash order within the stratum) and ``stratum_size``.

    A stratum may hold a third of the table, so it is never one window partition: rows
    are ranked inside (stratum, hash bucket), and a table of at most 4,096 rows per stratum
    supplies the offsets; it is joined as its size allows.  A null is a stratum of its own.
    Pass ids and strata only, not texts.
    """
    hashed = ids.withColumn("_h", unit_hash(F.col(key), seed)).withColumn(
        "_b", F.floor(F.col("_h") / (SPAN // BUCKETS)).cast("int")
    )
    counts = hashed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    per_stratum = W.partitionBy(*strata)
    offsets = counts.select(
        *strata, "_b",
        (F.sum("_n").over(per_stratum.orderBy("_b")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(per_stratum).alias("stratum_size"),
    )
    local = W.partitionBy(*strata, "_b").orderBy("_h", key)
    ranked = hashed.withColumn("_rn", F.row_number().over(local))
    other = {c: f"_o{i}" for i, c in enumerate([*strata, "_b"])}
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(o)) for c, o in other.items()])
    return ranked.join(offsets.withColumnsRenamed(other), same).withColumn(
        "rank", F.col("_before") + F.col("_rn")
    ).drop("_h", "_b", "_rn", "_before", *other.values())
