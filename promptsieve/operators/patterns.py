"""Scored attack patterns: best score, gate, and the individual hits.

All patterns are evaluated as generated column expressions.  Matching is
case-insensitive, done once by folding the text, and a native substring test on a
literal every match must contain rules out most texts before a regex runs.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve import lexicon as L
from promptsieve.functions import text as X

# Literals of which every match of the pattern contains at least one.
ANCHORS = {
    p: a for p, a in zip(L.PATTERN_SCORES, (
        ("ignore",), ("forget",), ("disregard",), ("override",), ("now",), ("now",), ("instruction",),
        ("mode",), ("anything",), ("restrictions", "rules", "limits", "boundaries", "guidelines"),
        ("dan",), ("safety", "content", "security", "moderation"), ("prompt", "instructions"),
        ("prompt", "instructions"), ("pretend", "imagine", "simulate"), ("hypothetical", "theory"),
        ("act",), ("without",), ("unrestricted", "uncensored", "unfiltered"),
        ("comply", "obey", "follow"), ("refuse", "decline", "say"), ("ethical", "moral", "safety"),
        ("```",), ("[inst]", "<<sys>>", "<|im_start|>"), (":",),
        ("filters", "restrictions", "guardrails"), ("admin", "root", "sudo"),
        ("admin", "root", "sudo"), ("base64",), ("obfuscate",), ("without",),
        ("developer", "hacker", "unrestricted"), ("role", "character"),
        ("scenario", "situation", "case"), ("mention", "acknowledge", "reference"),
        ("without", "bypassing"), ("polic", "filter"), ("refuse", "decline", "say"),
        ("safety", "content", "nsfw"), ("mode",), ("mode", "filter", "jailbreak"),
        ("without", "bypassing"), ("anything", "rules", "limits"), ("instructions", "prompt"),
        ("have", "are"), ("inject",), ("programming", "training", "instructions"),
    ), strict=True)
}


def fold(text: Column) -> Column:
    """Lower case, with the four letters that only match a-z when case is ignored."""
    return F.lower(F.translate(text, "ſıKİ", "siki"))


def usable(pattern: str) -> str:
    """The pattern, or its literal text if it does not compile."""
    try:
        re.compile(pattern)
        return pattern
    except re.error:
        return re.escape(pattern)


def _matches(folded: Column, pattern: str) -> Column:
    source = usable(pattern)
    if re.search(r"\\[A-Z]|\(\?", re.sub(r"\(\?:", "", source)):
        return X.found(folded, source, "iu", needs=ANCHORS.get(pattern, ()))
    return X.found(folded, source.lower(), needs=ANCHORS.get(pattern, ()))


def score_folded(folded: Column, patterns: Mapping[str, float] = L.PATTERN_SCORES) -> Column:
    """Highest score of a matching pattern, 0 without one; ``folded`` must be a plain column.

    Patterns are tried from the highest score down, so evaluation stops at the answer.
    """
    chain = None
    for score in sorted(set(patterns.values()), reverse=True):
        hit = None
        for pattern, value in patterns.items():
            if value == score:
                found = _matches(folded, pattern)
                hit = found if hit is None else hit | found
        chain = F.when(hit, F.lit(score)) if chain is None else chain.when(hit, F.lit(score))
    return F.lit(0.0) if chain is None else chain.otherwise(F.lit(0.0))


def with_score(frame: DataFrame, name: str = "pattern_score", text: str = "prompt_text",
               patterns: Mapping[str, float] = L.PATTERN_SCORES) -> DataFrame:
    """Adds the best pattern score; the text is folded once in a projection of its own."""
    folded = frame.withColumn("_folded", fold(F.col(text)))
    return folded.withColumn(name, score_folded(F.col("_folded"), patterns)).drop("_folded")


def flag_by_gate(frame: DataFrame, name: str = "pred", gate: float = L.PATTERN_GATE) -> DataFrame:
    """Adds 1 where the best pattern score of prompt_text reaches the gate."""
    scored = with_score(frame, "_score")
    return scored.withColumn(name, (F.col("_score") >= gate).cast("int")).drop("_score")


def pattern_scores(texts: DataFrame, patterns: Mapping[str, float] = L.PATTERN_SCORES, gate: float = L.PATTERN_GATE) -> DataFrame:
    """(prompt_id, pattern_score, pattern_gated): the gate zeroes scores below it."""
    scored = with_score(texts.select("prompt_id", "prompt_text"), patterns=patterns).drop("prompt_text")
    return scored.withColumn(
        "pattern_gated", F.when(F.col("pattern_score") >= gate, F.col("pattern_score")).otherwise(F.lit(0.0))
    )


def pattern_hits(texts: DataFrame, patterns: Mapping[str, float] = L.PATTERN_SCORES) -> DataFrame:
    """(prompt_id, pattern, score, offset) for the first match of every matching pattern."""
    folded = texts.select("prompt_id", fold(F.col("prompt_text")).alias("folded"))
    text = F.col("folded")
    entries = []
    for pattern, score in patterns.items():
        position = F.regexp_instr(text, F.lit(X.java_regex(usable(pattern), "iu")))
        entries.append(F.struct(
            F.lit(pattern).alias("pattern"), F.lit(score).alias("score"),
            F.when(_matches(text, pattern), position - 1).alias("offset"),
        ))
    found = folded.select("prompt_id", F.array(*entries).alias("hits"))
    present = F.filter("hits", lambda h: h["offset"].isNotNull())
    return X.exploded(found, present, "h", "prompt_id").select("prompt_id", "h.pattern", "h.score", "h.offset")
