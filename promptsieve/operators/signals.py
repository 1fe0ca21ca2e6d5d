"""Seven weak signals, their weighted composite, and reports over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve import lexicon as L
from promptsieve.functions import text as X
from promptsieve.functions.grams import gram_masses, word_measures

TEXT_SIGNALS = tuple(s for s in L.SIGNALS if s != "centroid")


@dataclass(frozen=True)
class CorpusStats:
    """One row of corpus statistics; its size is the keyword list, never the corpus."""

    documents: int
    mean_length: float
    keyword_idf: Mapping[str, float] = field(default_factory=dict)

    @property
    def fallback_idf(self) -> float:
        import math

        return math.log(self.documents / 2.0) if self.documents else 0.0


def corpus_stats(texts: DataFrame, keywords: Sequence[str] = L.SPARSE_KEYWORDS) -> DataFrame:
    """One pass: (keyword, documents, mean_length, df, idf), one row per keyword.

    idf is ln(N / df); a keyword that never occurs gets ln(N / 2).
    """
    low = texts.select(
        F.length("prompt_text").alias("n"), F.lower("prompt_text").alias("t")
    )
    wide = low.agg(
        F.count(F.lit(1)).alias("documents"),
        F.avg("n").alias("mean_length"),
        F.array(
            *[F.count_if(F.contains("t", F.lit(k))) for k in keywords]
        ).alias("dfs"),
    )
    keyed = wide.select(
        "documents", "mean_length",
        F.explode(F.arrays_zip(
            F.array(*map(F.lit, keywords)).alias("keyword"), F.col("dfs").alias("df")
        )).alias("k"),
    )
    n = F.col("documents").cast("double")
    return keyed.select(
        F.col("k.keyword").alias("keyword"), "documents", "mean_length", F.col("k.df").alias("df"),
        F.when(F.col("k.df") > 0, F.ln(n / F.col("k.df"))).otherwise(F.ln(n / 2)).alias("idf"),
    )


def collect_stats(texts: DataFrame, keywords: Sequence[str] = L.SPARSE_KEYWORDS) -> CorpusStats:
    """The statistics as a driver value: one row per keyword, so bounded by the list."""
    rows = corpus_stats(texts, keywords).collect()
    return CorpusStats(
        documents=rows[0]["documents"], mean_length=rows[0]["mean_length"] or 0.0,
        keyword_idf={r["keyword"]: r["idf"] for r in rows},
    )


def sparse_idf(low: Column, stats: CorpusStats, keywords: Sequence[str] = L.SPARSE_KEYWORDS) -> Column:
    """Idf mass of the keywords found in the text over the idf mass of all of them."""
    idf = {k: stats.keyword_idf.get(k, stats.fallback_idf) for k in keywords}
    whole = sum(stats.keyword_idf.values()) if stats.keyword_idf else float(len(keywords))
    if whole <= 0:
        return F.lit(0.0)
    found = X.total(
        F.when(F.contains(low, F.lit(k)), F.lit(v)).otherwise(F.lit(0.0)) for k, v in idf.items()
    )
    return found / F.lit(whole)


def signals(
    texts: DataFrame, stats: CorpusStats, centroid_scores: DataFrame | None = None,
    keywords: Sequence[str] = L.SPARSE_KEYWORDS,
) -> DataFrame:
    """(prompt_id, seven signals).  Texts are reduced to narrow rows before any join.

    ``centroid_scores`` is (prompt_id, centroid); prompts without an embedding score 0.
    """
    base = texts.select(
        "prompt_id", F.lower("prompt_text").alias("low"), F.length("prompt_text").alias("nc"),
        F.array_join(X.words(F.col("prompt_text")), " ").alias("joined"),
    )
    arrays = base.select(
        "prompt_id", "low", "nc", F.length("low").alias("nl"), "joined", X.joined_size(F.col("joined")).alias("nw"),
        gram_masses(F.col("low"), (1,)).alias("grams"),
        word_measures(F.col("joined"), members=(L.COMMON_WORDS, L.ATTACK_WORDS), phrases=L.ATTACK_PHRASES).alias("m"),
    )
    low, measure = F.col("low"), lambda k: F.get("m", F.lit(k))
    measured = arrays.select(
        "prompt_id", "low", "nc", "nl", "nw", F.get("grams", F.lit(2)).alias("char_mass"),
        F.when(F.col("nw") > 0, (F.length("joined") - F.col("nw") + 1) / F.col("nw")).otherwise(F.lit(0.0)).alias("word_len"),
        measure(0).alias("distinct_words"), measure(2).alias("word_mass"),
        measure(5).alias("bigram_hits"), measure(6).alias("trigram_hits"), measure(7).alias("common"), measure(8).alias("attack"),
    )
    nw = F.col("nw").cast("double")
    staged = measured.select(
        "prompt_id", "low", "nc", "nw", "word_len", "common", "attack", "bigram_hits", "trigram_hits",
        X.entropy_of_mass(F.col("char_mass"), F.col("nl"), F.col("nc")).alias("char_bits"),
        X.entropy_of_mass(F.col("word_mass"), F.col("nw")).alias("word_bits"), "distinct_words",
    )
    distinct = F.col("distinct_words")
    perplexity = X.clamp01(
        0.4 * (F.col("char_bits") / 8.0) + 0.3 * (distinct / nw)
        + 0.3 * F.least(F.lit(1.0), F.col("word_len") / 10.0)
    )
    entropy = X.clamp01(
        0.6 * (F.col("char_bits") / 6.5)
        + 0.4 * (F.col("word_bits") / F.log2(F.greatest(distinct, F.lit(2.0))))
    )
    rarity = X.clamp01(
        0.5 * (1.0 - F.col("common") / nw) + 0.5 * F.least(F.lit(1.0), F.col("attack") / nw * 3.0)
    )
    grams = 2.0 * nw - 3.0
    overlap = X.clamp01(
        0.5 * ((F.col("bigram_hits") + 1.5 * F.col("trigram_hits")) / grams)
        + 0.5 * F.least(F.lit(1.0), 0.2 * X.count_phrases(low, L.ATTACK_PHRASES))
    )
    only_if = lambda cond, value: F.when(cond, value).otherwise(F.lit(0.0))
    out = staged.select(
        "prompt_id",
        sparse_idf(low, stats, keywords).alias("sparse_idf"),
        only_if(nw >= 2, perplexity).alias("perplexity"),
        only_if(nw >= 1, entropy).alias("entropy"),
        only_if(nw >= 1, rarity).alias("token_frequency"),
        only_if(nw >= 2, overlap).alias("ngram_overlap"),
        (F.log1p("nc") / F.log1p(F.lit(stats.mean_length))).alias("length_norm"),
    )
    if centroid_scores is None:
        out = out.withColumn("centroid", F.lit(0.0))
    else:
        out = out.join(centroid_scores.select("prompt_id", "centroid"), "prompt_id", "left")
        out = out.withColumn("centroid", F.coalesce("centroid", F.lit(0.0)))
    return out.select("prompt_id", *L.SIGNALS)


def composite(frame: DataFrame, weights: Mapping[str, float] = L.SIGNAL_WEIGHTS) -> DataFrame:
    """Adds ``score``, the weighted sum of the signals present in ``weights``."""
    return frame.withColumn("score", X.total(F.col(s) * F.lit(w) for s, w in weights.items()))


def discrimination(frame: DataFrame, label: str = "is_malicious", names: Sequence[str] = L.SIGNALS) -> DataFrame:
    """Per signal: class means, their distance and how strongly it separates."""
    long = frame.unpivot([label], list(names), "signal", "value")
    means = long.groupBy("signal").agg(
        F.avg(F.when(F.col(label) == 0, F.col("value"))).alias("benign_mean"),
        F.avg(F.when(F.col(label) == 1, F.col("value"))).alias("malicious_mean"),
    )
    delta = F.abs(F.col("malicious_mean") - F.col("benign_mean"))
    return means.withColumn("delta", delta).withColumn(
        "status",
        F.when(F.col("delta") > 0.1, "STRONG").when(F.col("delta") > 0.05, "MODERATE").otherwise("WEAK"),
    )


def statistics(frame: DataFrame, names: Sequence[str] = L.SIGNALS) -> DataFrame:
    """Mean and population standard deviation of each column."""
    long = frame.unpivot(["prompt_id"], list(names), "signal", "value")
    return long.groupBy("signal").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def by_category(
    frame: DataFrame, threshold: float = 0.5, label: str = "is_malicious", category: str = "attack_category",
) -> DataFrame:
    """Accuracy and class counts per attack category at one threshold."""
    pred = (F.col("score") >= threshold).cast("int")
    return frame.groupBy(category).agg(
        F.avg((pred == F.col(label)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col(label) == 1).alias("n_malicious"),
        F.count_if(F.col(label) == 0).alias("n_benign"),
    )
