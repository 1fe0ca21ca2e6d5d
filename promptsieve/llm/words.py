"""Splitting a text by the pattern of the public byte-level vocabularies."""

from __future__ import annotations

import re

import public_tokenizers
import regex

EXACT = regex.compile(public_tokenizers.PATTERN)
# The same pattern in the standard library's classes, which is twice as fast. The classes differ on
# number signs that are not decimal digits, on the separators 1C-1F and on combining marks; a text
# with a character outside ASCII and the Latin letters takes the exact pattern.
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
OTHER = re.compile("[\x1c-\x1f²³¹¼½¾ɐ-\U0010ffff]")


def split(text: str) -> list[str]:
    return EXACT.findall(text) if OTHER.search(text) else LATIN.findall(text)
