"""I-Match fingerprints under randomised lexicons, and their likeness to edited and neighbouring texts.

A text's terms are its lower-cased runs of letters and digits, as 64-bit hashes. The lexicon keeps
the terms whose document frequency is within a band, that is, an inverse-document-frequency band. A text's distinct
lexicon terms are sorted and hashed, all and once per randomised sub-lexicon. Sub-lexicons keep a quarter, an
eighth, ... of the lexicon, several of each size, so for any length of text some of them hold one or
two of its terms; the share of equal hashes, among sub-lexicons that hold a term of either
text, is the likeness. A text without lexicon terms is hashed over all its terms.

Everything is DataFrame expressions. Terms meet the lexicon in a broadcast semi-join: a band that starts
at a share ``low`` of the documents cannot hold more terms than the mean number of distinct terms
divided by ``low``, however large the corpus. A document's successor by descending id is the next row of
a window over id ranges of equal size; each range also gets the first document of the following
range, so no range is sorted whole and no text is collected.

Defined results: a null text counts as empty; a null id comes after all others; rows of equal id
follow each other as read; a text without any term has the fingerprint of the empty list, and two of
those are alike; the only row of a table is its own successor.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.llm.common import rereadable, written

LOW, HIGH = 0.004, 0.02
LEVELS, REPEATS = range(2, 9), 6  # sub-lexicons of 1 / 2**level of the lexicon, so many of each
RANGE_ROWS, RANGES = 512, 10_000


def term_codes(text: Column) -> Column:
    """Distinct terms as hashes whose two lowest bits are 0."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-4))))


def lexicon(docs: DataFrame, rows: int, low: float = LOW, high: float = HIGH, text: str = "text") -> DataFrame:
    """(code) of the terms in the band; 0 is added as every document's own."""
    counts = (docs.select(F.explode(term_codes(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("code"))
              .groupBy("code").count())
    band = counts.filter(F.col("count").between(max(2, low * rows), high * rows)).select("code")
    return band.union(docs.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("code")))


def _ranged(numbered: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows with their id range ``range``: ranges of about ``RANGE_ROWS`` rows, ``RANGES`` at most."""
    place = F.coalesce(F.col(key).cast("double"), F.lit(-1.7e308))
    count = min(RANGES, rows // RANGE_ROWS)
    if count > 1:
        shares = [i / count for i in range(1, count)]
        found = numbered.select(F.percentile_approx(place, shares, 20 * count)).first()[0]
        cuts = sorted(set(found or []))
        if cuts:
            bucketizer = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_place", outputCol="_range",
                                    handleInvalid="keep")
            return bucketizer.transform(numbered.withColumn("_place", place)).withColumn(
                "range", F.col("_range").cast("int")).drop("_place", "_range")
    return numbered.withColumn("range", F.lit(0))


def _followed(docs: DataFrame, rows: int, key: str, text: str) -> DataFrame:
    """Every row with the text and place of its successor by descending id."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"),
                           F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ranged = _ranged(numbered, "key", rows)
    firsts = ranged.groupBy("range").agg(F.max(F.struct("key", (-F.col("row")).alias("back"))).alias("first")).select(
        "range", (-F.col("first.back")).alias("row"))
    up = Window.orderBy("range")  # one row per range
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    guests = firsts.select(F.col("range").alias("host"), F.coalesce(F.lag("row").over(up), F.last("row").over(whole)).alias("row"))
    guest_rows = numbered.join(F.broadcast(guests), "row").select(
        "row", "key", "text", F.col("host").alias("range"), F.lit(1).alias("guest"))
    down = Window.partitionBy("range").orderBy("guest", F.desc("key"), "row")
    both = ranged.select("row", "key", "text", "range", F.lit(0).alias("guest")).union(guest_rows)
    return (both.withColumn("next_text", F.lead("text").over(down)).withColumn("next_row", F.lead("row").over(down))
            .filter("guest = 0").drop("guest", "range"))


def signatures(terms: Column) -> Column:
    """A 32-bit hash of all and per sub-lexicon, a sorted array of codes; 0 where it holds none."""
    def kept(mask: int) -> Column:
        return F.filter(terms, lambda c: c.bitwiseAND(F.lit(mask)) == 0)

    masks = [0] + [((1 << level) - 1) << (8 * repeat + 2) for repeat in range(REPEATS) for level in LEVELS]
    empty = F.hash(F.array().cast("array<bigint>"))
    return F.transform(F.array(*(F.hash(kept(m)) for m in masks)), lambda h: F.when(h != empty, h).otherwise(F.lit(0)))


def _likeness(a: str, b: str) -> Column:
    equal = F.size(F.filter(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), lambda p: (p["x"] == p["y"]) & (p["x"] != 0)))
    any_ = F.size(F.filter(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), lambda p: (p["x"] != 0) | (p["y"] != 0)))
    return F.coalesce(F.try_divide(equal, any_), F.lit(0.0))


def _text(signature: str) -> Column:
    return F.concat_ws("-", F.transform(F.col(signature), lambda c: F.lower(F.hex(c))))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per input row: key, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``."""
    docs = rereadable(docs)
    rows = docs.count()
    known = lexicon(docs, rows, low, high, text)
    followed = _followed(docs, rows, key, text).withColumn("n_chars", F.length("text").cast("bigint"))
    half = "cast(n_chars div 2 as int)"
    edited = followed.withColumn(
        "edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {half}), substring(next_text, 1, {half}))"))
    coded = edited.select(
        "row", "key", "n_chars", "next_row", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        term_codes(F.col("text")).alias("own"), term_codes(F.col("edited")).alias("other"))
    # One term list for both texts; the two lowest bits say whose a term is.
    tagged = F.concat(
        F.array(F.lit(0).cast("bigint")),
        F.transform(F.array_intersect("own", "other"), lambda c: c + 3),
        F.transform(F.array_except("own", "other"), lambda c: c + 1),
        F.transform(F.array_except("other", "own"), lambda c: c + 2))
    listed = coded.select(
        "row", "key", "n_chars", "next_row", "edited_sha256", F.hash(F.array_sort("own")).alias("all_own"),
        F.hash(F.array_sort("other")).alias("all_other"), tagged.alias("list"))
    exploded = listed.select(*(c for c in listed.columns if c != "list"), F.explode("list").alias("tagged"))
    kept = exploded.withColumn("code", F.col("tagged").bitwiseAND(F.lit(-4))).join(F.broadcast(known), "code", "left_semi")
    carried = ("key", "n_chars", "next_row", "edited_sha256", "all_own", "all_other")
    gathered = kept.groupBy("row").agg(*(F.first(c).alias(c) for c in carried), F.collect_list("tagged").alias("terms"))

    def terms(bit):
        mine = F.filter("terms", lambda t: (t.bitwiseAND(F.lit(bit)) != 0) & (t.bitwiseAND(F.lit(-4)) != 0))
        return F.array_sort(F.transform(mine, lambda t: t.bitwiseAND(F.lit(-4))))

    sorted_ = gathered.select("row", *carried, terms(1).alias("own"), terms(2).alias("other"))

    def signature(own, whole):
        rest = F.when(F.size(own) == 0, F.col(whole)).otherwise(F.lit(0))
        return F.concat(signatures(F.col(own)), F.array(rest))

    signed = written(sorted_.select(
        "row", "key", "n_chars", "next_row", "edited_sha256", signature("own", "all_own").alias("mine"),
        signature("other", "all_other").alias("theirs")), "imatch-signatures")
    following = signed.select(F.col("row").alias("next_row"), F.col("mine").alias("following"))
    return signed.join(following, "next_row").select(
        F.col("key").alias(key), "n_chars", "edited_sha256", _text("mine").alias("fingerprint"),
        _text("theirs").alias("edited_fingerprint"), _likeness("mine", "theirs").alias("near_edited"),
        _likeness("mine", "following").alias("near_next"))
