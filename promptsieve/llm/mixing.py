"""Mixing sources to target weights by systematic sampling.

Sources, ordered by code point with null last, take turns in the weights; their targets share a multiple of
all words in proportion to those, and no target exceeds a multiple of its source's words: the level
at which targets stop is found in one pass over the sources, ordered by the level at which each is full.
Every document of a source expects ``target / source_size`` copies. The expected copies are summed along
the source, one random offset is added, and a document is emitted once for each whole number that its
stretch of the sum reaches or passes; so it is taken as often as expected, rounded down or up, and the sum of
copies of any run of documents is off by less than one.

Documents are summed up in order of their size class (an eighth of a doubling), so that short and long ones are
taken alike. The order is split into blocks of some thousand documents: by class, and by a hash of the
id within a class; a block is ordered by size again. Only counts of blocks are summed along a source; within a block rows are numbered by a window. So
neither a source nor a class that holds most rows is ever sorted in one task. Everything is DataFrame
expressions, texts are read once to count their words, and the order hangs on the rows' values alone, so reruns agree.

Defined results: a null or empty text has no words and is never taken; a null source is a source; a
null id counts as an empty one; repeated rows are drawn each; a source without words has the target 0; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.llm.common import fresh, rereadable, written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def draw(text: Column) -> Column:
    """60 bits that look random but hang on the text alone."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Narrow rows: place, id, source, words, size class, order within the class."""
    words = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")
    counted = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"),
        F.col(f"`{source}`").cast("string").alias("source"), words.alias("size"),
        draw(F.col(f"`{key}`").cast("string")).alias("draw"))
    # The number of binary digits and the first four of them.
    size_class = F.expr("length(bin(size)) * 16 + shiftright(size, greatest(length(bin(size)) - 4, 0))").cast("int")
    return counted.withColumn("class", size_class)


def targets(counted: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target), one row per source."""
    sums = counted.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = sums.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1)
    weighed = numbered.withColumn("weight", weight).withColumn("full", most * F.col("source_size"))
    # If exactly the sources before this one are full, the rest share what they leave; the level is the largest such.
    up = Window.orderBy(F.col("full").cast("double") / F.col("weight"), "place")
    everywhere = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("full").over(before), F.lit(0))
    waiting = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = weighed.withColumn("level", left / waiting)
    level = F.max("level").over(everywhere)
    return levels.select("source", "source_size", F.least(F.col("full").cast("double"), F.col("weight") * level).alias("target"))


def _copies(rate: Column, rank: Column, offset: Column) -> Column:
    """Whole numbers that the stretch from ``rate * (rank - 1)`` to ``rate * rank``, moved by the offset, reaches."""
    whole = F.floor(rate)
    part = rate - whole
    more = F.floor(part * rank + offset) - F.floor(part * (rank - 1) + offset)
    return whole + F.least(more, F.lit(1))


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *,
           weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``row`` (its place in ``docs``, which must read the same twice), key, ``source``,
    ``size``, ``source_size``, ``target``, ``copies`` and ``taken``, the words in these copies."""
    counted = written(sizes(docs, key, text, source), "mix-sizes")
    goals = targets(counted, weights, share, most).select(
        F.col("source").alias("of"), "source_size", "target",
        ((draw(F.col("source")) % (1 << 20)) / float(1 << 20)).alias("offset"))
    # Blocks of each class, by its number of rows.
    kinds = counted.filter("size > 0").groupBy("source", "class").count().select(
        F.col("source").alias("of"), F.col("class").alias("of_class"), F.ceil(F.col("count") / block).alias("blocks"))
    dealt = counted.filter("size > 0").join(kinds, F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class")))
    dealt = dealt.withColumn("block", F.pmod("draw", "blocks")).select("row", "key", "source", "size", "draw", "class", "block")
    along = Window.partitionBy("source").orderBy("class", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("source", "class", "block").count().select(
        "source", "class", "block", F.coalesce(F.sum("count").over(along), F.lit(0)).alias("base"))
    bases = bases.join(goals, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("source").alias("of"), F.col("class").alias("of_class"), F.col("block").alias("of_block"),
        "base", "source_size", "target", "offset")
    inside = Window.partitionBy("source", "class", "block").orderBy("size", "draw", "row")
    ranked = dealt.withColumn("rank", F.row_number().over(inside)).join(
        bases, F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class")) & (F.col("block") == F.col("of_block")))
    rate = F.col("target") / F.col("source_size")
    drawn = ranked.select("row", "key", "source", "size", "source_size", "target",
                          _copies(rate, F.col("base") + F.col("rank"), F.col("offset")).alias("copies"))
    idle = counted.filter("size = 0").join(goals, F.col("source").eqNullSafe(F.col("of"))).select(
        "row", "key", "source", "size", "source_size", "target", F.lit(0).cast("bigint").alias("copies"))
    return drawn.union(idle).withColumn("taken", F.col("copies") * F.col("size")).withColumnRenamed("key", key)


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    docs = rereadable(docs)
    place = fresh(docs, "_row")
    often = copies(docs, key, text, source, **options).filter("copies > 0").select(F.col("row").alias(place), F.col("copies").alias(f"{place}_copies"))
    met = docs.withColumn(place, F.monotonically_increasing_id()).join(often, place)
    return met.withColumn(place, F.explode(F.expr(f"array_repeat(0, cast(`{place}_copies` as int))"))).select(*(f"`{c}`" for c in docs.columns))


ORACLE = r"""
with counted as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
           ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as draw
    from documents),
classed as (
    select *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) as class from counted),
sums as (
    select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place
    from counted group by source),
weighed as (
    select *, [5, 2, 1][(place - 1) % 3 + 1]::bigint as weight, 2 * source_size as full_size from sums),
levels as (
    select *, (1.5::double * (sum(source_size) over ())::double - coalesce((sum(full_size) over up)::double, 0))
              / ((sum(weight) over ()) - coalesce(sum(weight) over up, 0))::double as level
    from weighed
    window up as (order by full_size::double / weight, place rows between unbounded preceding and 1 preceding)),
goals as (
    select source, source_size, least(full_size::double, weight * max(level) over ()) as target,
           (('0x' || substr(md5(coalesce(source, '')), 1, 15))::bigint % 1048576) / 1048576.0::double as offs
    from levels),
blocked as (
    select *, draw % ceil(count(*) over (partition by source, class) / 4096.0)::bigint as block from classed where size > 0),
ranked as (
    select *, row_number() over (partition by source order by class, block, size, draw, doc_id) as rank from blocked),
drawn as (
    select doc_id, size, source_size, target, target / source_size as rate, rank, offs
    from ranked r join goals g on r.source is not distinct from g.source),
taken as (
    select doc_id, size, source_size, target,
           (floor(rate) + least(1, floor((rate - floor(rate)) * rank + offs)
                                   - floor((rate - floor(rate)) * (rank - 1) + offs)))::bigint * size as taken
    from drawn
    union all
    select doc_id, size, source_size, target, 0 from counted c join goals g on c.source is not distinct from g.source
    where size = 0)
select doc_id, size, source_size, target, taken from taken
"""
