"""Data preparation: profiling, guards, sampling, splits, duplicates, external sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve import lexicon as L
from promptsieve.functions.hashing import SPAN, stratified_rank, unit_hash


def infer_columns(frame: DataFrame, exact: bool = False) -> tuple[str, str]:
    """(label column, text column): by well-known name, else from one profiling pass.

    Without a known name the label is the column with the fewest distinct values and
    the text the string column with the longest mean length; first column wins ties.
    """
    label = next((c for c in L.LABEL_CANDIDATES if c in frame.columns), None)
    text = next((c for c in L.TEXT_CANDIDATES if c in frame.columns), None)
    distinct = F.count_distinct if exact else F.approx_count_distinct
    strings = [c for c, t in frame.dtypes if t == "string"]
    wanted = []
    if label is None:
        wanted += [distinct(F.col(c)).alias(f"d_{c}") for c in frame.columns]
    if text is None:
        if not strings:
            raise ValueError("no text column")
        wanted += [F.avg(F.length(c)).alias(f"l_{c}") for c in strings]
    profile = frame.agg(*wanted).first() if wanted else None
    if label is None:
        label = min(frame.columns, key=lambda c: profile[f"d_{c}"])
    if text is None:
        text = max(strings, key=lambda c: profile[f"l_{c}"] or 0.0)
    return label, text


def class_distribution(frame: DataFrame, label: str = "is_malicious") -> DataFrame:
    return frame.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def require_two_classes(frame: DataFrame, label: str = "is_malicious") -> DataFrame:
    """Counts of every class; raises if the table is empty or has fewer than two classes."""
    counts = class_distribution(frame, label)
    found = counts.agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows")).first()
    if not found["classes"]:
        raise ValueError("no rows")
    if found["classes"] < 2:
        raise ValueError(f"only one class in {found['rows']} rows")
    return counts


def stratified_sample(ids: DataFrame, n: int, strata: Sequence[str] = ("is_malicious",), seed: int = 42) -> DataFrame:
    """floor(n * class share) rows of each class, the first in hash order."""
    total = ids.count()
    quota = F.floor(F.lit(n) * F.col("stratum_size") / F.lit(total))
    ranked = stratified_rank(ids, strata, seed=seed)
    return ranked.where(F.lit(n >= total) | (F.col("rank") <= quota)).drop("rank", "stratum_size")


def hash_split(frame: DataFrame, fractions: Mapping[str, float], key: str = "prompt_id", seed: int = 42) -> DataFrame:
    """Adds ``split`` by hash bands: no shuffle, shares hold in expectation per stratum."""
    point = unit_hash(F.col(key), seed) / F.lit(float(SPAN))
    names, edge, split = list(fractions), 0.0, None
    for name in names[:-1]:
        edge += fractions[name]
        split = F.when(point < edge, name) if split is None else split.when(point < edge, name)
    return frame.withColumn("split", F.lit(names[-1]) if split is None else split.otherwise(names[-1]))


def stratified_split(
    ids: DataFrame, fractions: Mapping[str, float], strata: Sequence[str] = ("is_malicious",), seed: int = 42,
) -> DataFrame:
    """Adds ``split`` with exact shares inside every stratum, by hash rank."""
    point = (F.col("rank") - 0.5) / F.col("stratum_size")
    names, edge, split = list(fractions), 0.0, None
    for name in names[:-1]:
        edge += fractions[name]
        split = F.when(point < edge, name) if split is None else split.when(point < edge, name)
    split = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    return stratified_rank(ids, strata, seed=seed).withColumn("split", split).drop("rank", "stratum_size")


def stratified_folds(ids: DataFrame, k: int = 5, strata: Sequence[str] = ("is_malicious",), seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0..k-1, balanced inside every stratum."""
    ranked = stratified_rank(ids, strata, seed=seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "stratum_size")


def text_key(text: str = "prompt_text") -> list[Column]:
    return [F.md5(F.col(text).cast("binary")).alias("text_hash"), F.length(text).alias("text_length")]


def drop_duplicates(texts: DataFrame) -> DataFrame:
    """(prompt_id, copies): the smallest id of each distinct text.

    Only digests are shuffled, and copies collapse map-side, so one text making up a
    third of the table costs one row per task.
    """
    return texts.groupBy(*text_key()).agg(
        F.min("prompt_id").alias("prompt_id"), F.count(F.lit(1)).alias("copies")
    ).select("prompt_id", "copies")


def reconcile_labels(prompts: DataFrame, label: str = "is_malicious") -> DataFrame:
    """(prompt_id, label, reconciled): identical texts get the majority label, ties malicious.

    Only texts with conflicting labels take part in the join.
    """
    keyed = prompts.select("prompt_id", label, *text_key())
    conflicts = keyed.groupBy("text_hash", "text_length").agg(F.avg(F.col(label).cast("double")).alias("share")).where(
        (F.col("share") > 0) & (F.col("share") < 1)
    ).select("text_hash", "text_length", (F.col("share") >= 0.5).cast("int").alias("majority"))
    return keyed.join(conflicts, ["text_hash", "text_length"], "left").select(
        "prompt_id", label, F.coalesce("majority", label).alias("reconciled")
    )


def length_filter(texts: DataFrame, shortest: int = 5, longest: int = 20_000, text: str = "prompt_text") -> DataFrame:
    return texts.where(F.length(text).between(shortest, longest))


def downsample_category(frame: DataFrame, category: str, keep: float, column: str = "attack_category", seed: int = 42) -> DataFrame:
    """Keeps the share ``keep`` of one category by hash, and all other rows, those without category too."""
    return frame.where(
        ~F.col(column).eqNullSafe(F.lit(category)) | (unit_hash(F.col("prompt_id"), seed) < F.lit(int(keep * SPAN)))
    )


@dataclass(frozen=True)
class ExternalSet:
    """How one source table becomes (item_id, prompt_text, is_malicious)."""

    name: str
    frame: DataFrame
    item_id: str
    text: str
    label: Column


def normalise_external(sets: Sequence[ExternalSet]) -> DataFrame:
    """All sources as (dataset, item_id, prompt_text, is_malicious)."""
    return reduce(DataFrame.unionByName, [
        s.frame.select(
            F.lit(s.name).alias("dataset"), F.col(s.item_id).cast("bigint").alias("item_id"),
            F.coalesce(F.col(s.text), F.lit("")).alias("prompt_text"), s.label.cast("int").alias("is_malicious"),
        ) for s in sets
    ])


def cap_datasets(ids: DataFrame, caps: Mapping[str, int] | int, seed: int = 42) -> DataFrame:
    """At most the cap of each dataset, the first in hash order; datasets without a cap stay whole."""
    if isinstance(caps, int):
        cap = F.lit(caps)
    else:
        cap = F.coalesce(*[F.when(F.col("dataset") == n, F.lit(c)) for n, c in caps.items()], F.col("stratum_size"))
    ranked = stratified_rank(ids, ["dataset"], key="item_id", seed=seed)
    return ranked.where(F.col("rank") <= cap).drop("rank", "stratum_size")


def shared_caps(sizes: Mapping[str, int], total: int = 10_000, small: int = 2_000) -> dict[str, int]:
    """Small sets keep their size; the rest of ``total`` is shared by the large ones."""
    kept = sum(n for n in sizes.values() if n <= small)
    large = [k for k, n in sizes.items() if n > small]
    share = (total - kept) // len(large) if large else 0
    return {k: n if n <= small else share for k, n in sizes.items()}
