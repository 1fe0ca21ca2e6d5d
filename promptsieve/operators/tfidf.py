"""Word and character TF-IDF, the malicious centroid and quantised similarity.

Fitting needs one shuffle, of partially aggregated term counts.  A fitted model is at
most ``max_features`` terms with their idf, so it is held on the driver and sent with
the tasks; transforming and scoring are then per-row expressions without any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve.functions import text as X
from promptsieve.functions import vectors as V
from promptsieve.functions.grams import term_hashes, term_totals, totals_of_hashes, word_bound_counts
from promptsieve.lexicon import WORD
from promptsieve.operators.keywords import sigmoid
from promptsieve.streaming.feedback import shared_folder


CHAR_SIZES = (3, 4, 5)
HASHES = 1 << 20  # of words and pairs, that may be sent with the tasks
SENT = 1 << 16  # hashes of words and pairs that a task sends, eight times the terms at least


def word_tokens(text: Column) -> Column:
    """Tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "{2,}"), F.lit(0))


def word_terms(texts: DataFrame, text: str = "prompt_text") -> DataFrame:
    """Adds ``terms``: one- and two-word grams over tokens of two or more word characters."""
    staged = texts.withColumn("_tokens", word_tokens(F.col(text)))
    return staged.withColumn(
        "terms", F.concat("_tokens", X.word_ngrams(F.col("_tokens"), 2))
    ).drop("_tokens")


def counted_terms(texts: DataFrame, analyzer: str, text: str = "prompt_text") -> DataFrame:
    """Adds ``counted``: array<struct<term, tf>> of the distinct terms of each text."""
    if analyzer == "char":
        return texts.withColumn("counted", word_bound_counts(F.col(text), CHAR_SIZES))
    return word_terms(texts, text).withColumn("counted", X.term_counts(F.col("terms"))).drop("terms")


def term_statistics(texts: DataFrame, analyzer: str = "word") -> DataFrame:
    """(term, tf, df) over the corpus; the terms of a task's texts are added up where they are counted."""
    if analyzer == "char":
        parts = term_totals(texts.select("prompt_text"), CHAR_SIZES)
    else:
        parts = term_totals(_joined_tokens(texts))
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _joined_tokens(texts: DataFrame) -> DataFrame:
    return texts.select(F.array_join(word_tokens(F.col("prompt_text")), " "))  # tokens hold no blanks


def frequent_terms(texts: DataFrame, k: int, most: int = HASHES) -> DataFrame:
    """(term, tf, df) of words and pairs, among them the k most frequent; the smaller term wins ties.

    Most pairs occur once, so occurrences are counted by hashes first, from below and at most ``missed`` short. Terms that
    by this may be among the k are then counted as such, exactly. Hashes shared by terms only let more pass: if the k-th
    exact count shows that something else might be among them, the second count is made again from there. If more than
    ``most`` hashes may matter, all terms are counted.
    """
    joined, spark = _joined_tokens(texts), texts.sparkSession
    target = shared_folder(spark, "term-hashes")
    term_hashes(joined, sent=max(SENT, 8 * k)).groupBy("hash").agg(F.sum("n").alias("n")).write.parquet(target)
    counts = spark.read.parquet(target)
    missed = counts.where("hash is null").agg(F.sum("n")).first()[0] or 0
    counts = counts.where("hash is not null")
    kth = lambda rows, name: min((r[0] for r in rows), default=0) if len(rows := rows.orderBy(F.desc(name)).select(name).limit(k).collect()) == k else 0
    least = kth(counts, "n")  # no less often than this, if hashes are not shared, does the k-th occur
    while True:
        likely = counts.where(F.col("n") >= least - missed)
        if least <= missed and missed or likely.count() > most:
            return term_statistics(texts)
        hashes = [r["hash"] for r in likely.select("hash").collect()]
        if not hashes:
            return term_statistics(texts)
        folder = shared_folder(spark, "terms")
        totals_of_hashes(joined, hashes).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).write.parquet(folder)
        exact = spark.read.parquet(folder)
        found = kth(exact, "tf")
        if found >= least:
            return exact
        least = found


def vocabulary(texts: DataFrame, max_features: int, analyzer: str = "word", documents: int | None = None) -> DataFrame:
    """(term, tf, df, idf) of the most frequent terms; the smaller term wins ties.

    idf = ln((1 + n) / (1 + df)) + 1.
    """
    n = texts.count() if documents is None else documents
    every = frequent_terms(texts, max_features) if analyzer == "word" else term_statistics(texts, analyzer)
    top = every.orderBy(F.col("tf").desc(), "term").limit(max_features)
    return top.withColumn("idf", F.ln(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1.0)


@dataclass(frozen=True)
class TfidfModel:
    """Terms in ascending order with their idf; at most ``max_features`` of them."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    analyzer: str = "word"

    @classmethod
    def fit(cls, texts: DataFrame, max_features: int = 5000, analyzer: str = "word") -> TfidfModel:
        rows = sorted(vocabulary(texts, max_features, analyzer).collect(), key=lambda r: r["term"])
        return cls(tuple(r["term"] for r in rows), tuple(r["idf"] for r in rows), analyzer)

    def with_weights(self, frame: DataFrame) -> DataFrame:
        """Adds ``term_ids`` and ``weights``: (1 + ln tf) * idf, scaled to length one."""
        if not self.terms:
            raise ValueError("the vocabulary is empty")
        keep = frame.columns
        if self.analyzer == "char":
            counted = frame.withColumn("_n", word_bound_counts(F.col("prompt_text"), CHAR_SIZES, self.terms))
            counted = counted.select(*keep, F.struct(
                F.col("_n.term").alias("indices"), F.col("_n.tf").cast("array<double>").alias("values")
            ).alias("_c"))
        else:
            counter = CountVectorizerModel.from_vocabulary(list(self.terms), inputCol="terms", outputCol="_counts")
            counted = counter.transform(word_terms(frame)).select(*keep, F.unwrap_udt("_counts").alias("_c"))
        idf = V.literal(self.idf)
        raw = counted.select(
            *keep, F.col("_c.indices").alias("term_ids"),
            F.zip_with("_c.indices", "_c.values", lambda i, n: (1.0 + F.ln(n)) * F.get(idf, i)).alias("_raw"),
        )
        return raw.select(
            *keep, "term_ids", V.divide(F.col("_raw"), V.norm(F.col("_raw"))).alias("weights")
        )

    def transform(self, texts: DataFrame) -> DataFrame:
        """(prompt_id, term_ids, weights)."""
        return self.with_weights(texts.select("prompt_id", "prompt_text")).drop("prompt_text")

    def long(self, texts: DataFrame) -> DataFrame:
        """(prompt_id, term, weight), one row per term of a text that is in the vocabulary."""
        names = V.literal(self.terms, "string")
        pairs = X.exploded(self.transform(texts), F.arrays_zip("term_ids", "weights"), "p", "prompt_id")
        return pairs.select(
            "prompt_id", F.get(names, F.col("p.term_ids")).alias("term"), F.col("p.weights").alias("weight")
        )


def malicious_centroid(prompts: DataFrame, model: TfidfModel) -> DataFrame:
    """(term_id, weight, quantised): unit mean of the malicious rows, times 127, truncated.

    One partial aggregation of at most |vocabulary| groups.
    """
    malicious = prompts.where(F.col("is_malicious") == 1)
    pairs = X.exploded(model.transform(malicious), F.arrays_zip("term_ids", "weights"), "p")
    sums = pairs.groupBy(F.col("p.term_ids").alias("term_id")).agg(F.sum("p.weights").alias("s"))
    # At most one entry per vocabulary term.  The count of malicious rows cancels when
    # the mean is scaled to length one.
    packed = sums.agg(F.collect_list(F.struct("term_id", "s")).alias("all")).select(
        "all", F.sqrt(F.aggregate("all", F.lit(0.0), lambda a, x: a + x["s"] * x["s"])).alias("size")
    )
    unit = packed.select("size", F.explode("all").alias("x")).select(
        F.col("x.term_id").alias("term_id"), (F.col("x.s") / F.col("size")).alias("weight")
    )
    return unit.withColumn("quantised", (F.col("weight") * 127.0).cast("tinyint"))


@dataclass(frozen=True)
class Similarity:
    """A vocabulary and its quantised malicious centroid, one int8 per term."""

    model: TfidfModel
    centroid: tuple[int, ...]

    @classmethod
    def fit(cls, prompts: DataFrame, max_features: int, analyzer: str) -> Similarity:
        model = TfidfModel.fit(prompts, max_features, analyzer)
        dense = np.zeros(len(model.terms), dtype=int)
        for row in malicious_centroid(prompts, model).collect():
            dense[row["term_id"]] = row["quantised"]
        return cls(model, tuple(int(v) for v in dense))

    def with_similarity(self, frame: DataFrame, name: str) -> DataFrame:
        """Adds sigmoid(5 * (cos - 0.3)) of the quantised vectors.

        Products are summed as integers and scaled by 127 squared; a text without any
        vocabulary term scores 0.
        """
        centroid = V.literal(self.centroid, "int")
        product = F.aggregate(
            F.zip_with("term_ids", "weights", lambda i, w: (w * 127.0).cast("int") * F.get(centroid, i)),
            F.lit(0).cast("bigint"), lambda acc, v: acc + v,
        )
        score = sigmoid(5.0 * (product / F.lit(127.0 * 127.0) - 0.3))
        return self.model.with_weights(frame).withColumn(
            name, F.when(F.size("term_ids") > 0, score).otherwise(F.lit(0.0))
        ).drop("term_ids", "weights")

    def score(self, texts: DataFrame) -> DataFrame:
        """(prompt_id, similarity)."""
        return self.with_similarity(texts.select("prompt_id", "prompt_text"), "similarity").drop("prompt_text")


def with_blended_similarity(frame: DataFrame, word: Similarity, char: Similarity) -> DataFrame:
    """Adds ``similarity``: the larger of the word view and the character view."""
    views = char.with_similarity(word.with_similarity(frame, "_word"), "_char")
    return views.withColumn("similarity", F.greatest("_word", "_char")).drop("_word", "_char")


def blended_similarity(texts: DataFrame, word: Similarity, char: Similarity) -> DataFrame:
    """(prompt_id, similarity): the larger of the word view and the character view."""
    return with_blended_similarity(texts.select("prompt_id", "prompt_text"), word, char).drop("prompt_text")
