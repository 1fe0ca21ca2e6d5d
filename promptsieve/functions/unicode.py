"""Bringing texts to one spelling before they are scored."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Digits and signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


def nfkd(text: Column) -> Column:
    """The compatibility decomposition: composed letters, ligatures, widths and styles taken apart, marks in canonical order.

    Whole Arrow batches are normalised at once; Spark has no such expression.  Characters that the Unicode version
    of the Arrow library assigns and an older one does not are decomposed by the former.
    """
    @F.arrow_udf("string")
    def decomposed(texts):
        import pyarrow.compute as pc

        return pc.utf8_normalize(texts, form="NFKD")

    return decomposed(text)


def without_marks(text: Column) -> Column:
    """The decomposed text without its combining marks, so that an accented letter is its plain letter."""
    return F.regexp_replace(nfkd(text), r"\p{Mn}+", "")


def leet(text: Column) -> Column:
    """The lower-cased text with digits and signs read as the letters they stand for."""
    return F.translate(F.lower(text), "".join(LEET), "".join(LEET.values()))


def one_spelling(text: Column) -> Column:
    """Lower case, no marks, single blanks: equal for variants of a text that differ in nothing else."""
    return F.trim(F.regexp_replace(F.lower(without_marks(text)), r"\s+", " "))
