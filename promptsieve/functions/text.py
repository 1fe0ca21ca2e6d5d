"""Column expressions over text: tokens, n-grams, histograms, counts, patterns.

Every builder returns a Catalyst expression, so text never leaves the JVM.
Lambdas refer to their own arguments only.  The optimiser may replace a column
reference by the expression behind it (collapsing projections, pushing filters),
and inside a lambda that expression would run once per element.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve.lexicon import WORD, WS


def java_regex(pattern: str, flags: str = "") -> str:
    """Write a Unicode-aware pattern for ``java.util.regex``.

    ``\\s``, ``\\w``, ``\\d`` become explicit Unicode classes, ``\\b`` becomes a
    pair of look-arounds on the same word class, and line ends are ``\\n`` only.
    """
    classes = {"s": WS[1:-1], "w": WORD[1:-1], "d": r"\p{Nd}"}
    edge = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = pattern[i + 1]
            if n in classes:
                out.append(classes[n] if inside else f"[{classes[n]}]")
            elif n == "S":
                out.append(f"[^{classes['s']}]")
            elif n == "b" and not inside:
                out.append(edge)
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        out.append(c)
        i += 1
    return f"(?d{flags})" + "".join(out)


def _any_of(text: Column, literals: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in literals])


def found(text: Column, pattern: str, flags: str = "", needs: Iterable[str] = ()) -> Column:
    """Does the pattern occur?

    ``needs`` lists literals of which every match must contain one; a native
    substring scan then rules most texts out before the regex runs.
    """
    hit = F.rlike(text, F.lit(java_regex(pattern, flags)))
    return (_any_of(text, needs) & hit) if needs else hit


def hits(text: Column, pattern: str, flags: str = "", needs: Iterable[str] = ()) -> Column:
    """Number of non-overlapping matches; ``needs`` as in :func:`found`."""
    count = F.regexp_count(text, F.lit(java_regex(pattern, flags)))
    return F.when(_any_of(text, needs), count).otherwise(F.lit(0)) if needs else count


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def total(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def words(text: Column) -> Column:
    """Whitespace tokens of the lower-cased text, as ``str.lower().split()``."""
    return F.filter(F.split(F.lower(text), WS + "+"), lambda w: w != "")


def joined_size(joined: Column) -> Column:
    """Number of words in a text of words joined by one blank each."""
    blanks = F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit("")))
    return F.when(joined == "", F.lit(0)).otherwise(blanks + 1)


def chars(text: Column) -> Column:
    """Code points of the text; an empty text has none."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def occurrences(text: Column, literal: str) -> Column:
    """Count of a literal, by the length it leaves behind when removed."""
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(literal), F.lit("")))
    return gone / F.lit(len(literal.encode()))


def count_phrases(text: Column, phrases: Iterable[str]) -> Column:
    """How many of the phrases occur in the text as substrings."""
    return total(F.contains(text, F.lit(p)).cast("int") for p in phrases)


def count_members(tokens: Column, members: Iterable[str]) -> Column:
    """How many tokens belong to a fixed set."""
    members = list(members)
    return F.size(F.filter(tokens, lambda w: w.isin(members)))


def word_ngrams(tokens: Column, n: int) -> Column:
    """Adjacent n-token phrases joined by one blank.

    The shifted arrays are arguments of zip_with; nothing outside the row of a lambda
    is referenced in it, so inlining ``tokens`` cannot make this quadratic.
    """
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    shifted = [F.slice(tokens, F.lit(k + 1), count) for k in range(n)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(" "), y)), shifted)


def word_runs(tokens: Column) -> Column:
    """Occurrence count of each distinct token (tokens hold no blanks)."""
    joined = F.concat(F.array_join(F.sort_array(tokens), " "), F.lit(" "))
    spans = F.regexp_extract_all(joined, F.lit(r"([^ ]+ )\1*"), F.lit(0))
    firsts = F.regexp_extract_all(joined, F.lit(r"([^ ]+ )\1*"), F.lit(1))
    return F.when(
        F.size(tokens) > 0,
        F.zip_with(spans, firsts, lambda s, f: F.length(s) / F.length(f)),
    ).otherwise(F.array().cast("array<double>"))


def log_mass(counts: Column) -> Column:
    """Sum of c * log2(c) over a histogram."""
    return F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * F.log2(c))


def entropy_of_mass(mass: Column, size: Column, denominator: Column | None = None) -> Column:
    """Shannon entropy in bits of counts summing to ``size``, given their log mass.

    With a ``denominator`` other than ``size`` the probabilities are c / denominator.
    """
    n = (size if denominator is None else denominator).cast("double")
    s = size.cast("double")
    return F.when(s > 0, (s * F.log2(n) - mass) / n).otherwise(F.lit(0.0))


def entropy(counts: Column, size: Column) -> Column:
    return entropy_of_mass(log_mass(counts), size)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def mean_length(tokens: Column) -> Column:
    """Mean token length; 0 without tokens."""
    n = F.size(tokens)
    return F.when(n > 0, F.length(F.array_join(tokens, "")) / n).otherwise(F.lit(0.0))


SEPARATOR = "\uffff"  # a noncharacter: never part of a term


def term_counts(terms: Column) -> Column:
    """array<struct<term, tf>> of the distinct terms, counted inside the row.

    Sorting brings equal terms together and one back-reference pass measures each
    run, so counting terms per text needs neither an explode nor a shuffle.
    """
    joined = F.concat(F.array_join(F.sort_array(terms), SEPARATOR), F.lit(SEPARATOR))
    pattern = F.lit(f"([^{SEPARATOR}]+{SEPARATOR})\\1*")
    spans = F.regexp_extract_all(joined, pattern, F.lit(0))
    firsts = F.regexp_extract_all(joined, pattern, F.lit(1))
    return F.zip_with(
        spans, firsts,
        lambda s, f: F.struct(
            F.rtrim(f, F.lit(SEPARATOR)).alias("term"),
            (F.length(s) / F.length(f)).cast("bigint").alias("tf"),
        ),
    )


def exploded(frame: DataFrame, array: Column, name: str, *keep: str | Column) -> DataFrame:
    """One row per element, keeping the columns ``keep``; empty arrays give no row.

    A plain explode makes the optimiser add a size filter below the projection, which
    computes the array twice; the outer form with a filter above it does not.
    """
    rows = frame.select(*keep, F.explode_outer(array).alias(name))
    return rows.where(F.col(name).isNotNull())
