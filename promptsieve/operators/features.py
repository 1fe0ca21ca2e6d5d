"""117 handcrafted text features in 17 named groups, as column expressions.

Three projections: token array and n-gram histograms, shared measures, features.
Asking for a group computes only what it needs, because Catalyst prunes the shared
columns nobody refers to.  There is no shuffle anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve import lexicon as L
from promptsieve.functions import text as X
from promptsieve.functions.grams import gram_masses, word_measures


def T() -> Column:
    """The text."""
    return F.col("t")


def LOW() -> Column:
    """The lower-cased text."""
    return F.col("low")


def W() -> Column:
    """Its whitespace tokens."""
    return F.col("w")


def _n(name: str) -> Column:
    return F.col(name).cast("double")


def _at_least_one(column: Column) -> Column:
    return F.greatest(column, F.lit(1.0))


def _per_word(column: Column) -> Column:
    return column / _at_least_one(_n("nw"))


def _per_char(column: Column) -> Column:
    return column / _at_least_one(_n("nc"))


def _count(*literals: str) -> Column:
    return X.total(X.occurrences(T(), c) for c in literals)


def _capped(weight: float, column: Column) -> Column:
    return F.least(F.lit(1.0), column * F.lit(weight))


def _patterns(patterns: Iterable[str], needs: Iterable[Iterable[str]] | None = None) -> Column:
    """How many of the patterns occur in the lower-cased text."""
    patterns = list(patterns)
    needs = list(needs) if needs else [()] * len(patterns)
    return X.total(X.flag(X.found(LOW(), p, needs=n)) for p, n in zip(patterns, needs))


def _members(name: str) -> Column:
    return _n(f"{name}_hits")


def _gram_entropy(offset: int) -> Column:
    """Entropy of a character n-gram histogram over its maximum, 0 for one distinct gram."""
    n, distinct, mass = (F.get("low_grams", F.lit(offset + k)) for k in range(3))
    bits = X.entropy_of_mass(mass, n)
    return F.when(distinct > 1, bits / F.log2(distinct)).otherwise(F.lit(0.0))


def _digit_entropy() -> Column:
    """Normalised entropy of the digits of all word lengths written side by side."""
    digits = F.col("length_digits")
    counts = F.filter(F.array(*[X.occurrences(digits, str(d)) for d in range(10)]), lambda c: c > 0)
    bits = X.entropy(counts, F.length(digits))
    return F.when(F.size(counts) > 1, bits / F.log2(F.size(counts))).otherwise(F.lit(0.0))


def _nesting() -> Column:
    """Deepest bracket nesting; a closing bracket never goes below zero."""
    brackets = F.split(F.regexp_replace(T(), r"[^(\[{)\]}]+", ""), "")
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(s, c):
        depth = (
            F.when(c.isin("(", "[", "{"), s["d"] + 1)
            .when(c != "", F.greatest(s["d"] - 1, F.lit(0)))
            .otherwise(s["d"])
        )
        return F.struct(depth.alias("d"), F.greatest(s["m"], depth).alias("m"))

    return F.aggregate(brackets, start, step, lambda s: s["m"]).cast("double")


def _syllables() -> Column:
    """Vowel groups per word, one less for a final e, at least 1, and 1 for short words.

    Vowel groups are marked in one pass over all words, then counted by removal.
    """
    mark = "\x01"
    marked = F.split(F.regexp_replace("joined", "[aeiouy]+", mark), " ")

    def count(word: Column, m: Column) -> Column:
        groups = F.octet_length(m) - F.octet_length(F.replace(m, F.lit(mark), F.lit("")))
        silent = F.when(word.endswith("e"), 1).otherwise(0)
        return F.when(F.length(word) <= 3, F.lit(1)).otherwise(F.greatest(groups - silent, F.lit(1)))

    return F.when(F.size("w") > 0, F.zip_with("w", marked, count)).otherwise(F.array().cast("array<int>"))


def _sentence_variance() -> Column:
    """Population variance of words per sentence, counted by the single blanks between them."""
    sentences = F.split(F.array_join("pieces", " "), "[.!?]+")
    sizes = F.filter(F.transform(sentences, lambda s: X.joined_size(F.btrim(s)).cast("double")), lambda n: n > 0)
    folded = F.aggregate(
        sizes, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")),
        lambda a: F.when(a["n"] > 1, a["q"] / a["n"] - (a["s"] / a["n"]) * (a["s"] / a["n"])).otherwise(F.lit(0.0)),
    )
    return F.greatest(folded, F.lit(0.0))


def _xml_injection() -> Column:
    """An opening tag with a closing tag somewhere after it, in one forward pass."""
    rest = F.regexp_extract(T(), r"(?s)<[a-zA-Z][^>]*+>(.*)", 1)
    return X.flag(F.contains(T(), F.lit("</")) & F.rlike(rest, F.lit("</[a-zA-Z]+>")))


def _text_statistics() -> dict[str, Column]:
    return {
        "char_count": _n("nc"),
        "word_count": _n("nw"),
        "avg_word_length": _n("mean_length"),
        "max_word_length": F.coalesce(F.array_max("lengths"), F.lit(0)).cast("double"),
        "sentence_count": _n("sentences"),
        "avg_sentence_length": _n("nw") / _n("sentences"),
    }


def _of_class(chars: str) -> Column:
    """How many characters belong to a class, by the length left without them.

    Counting matches would build an array of all of them.
    """
    return _n("nc") - F.length(F.regexp_replace(T(), f"[{chars}]+", ""))


def _char_composition() -> dict[str, Column]:
    return {
        "uppercase_ratio": _per_char(_of_class(r"\p{IsUppercase}")),
        "digit_ratio": _per_char(_of_class(r"\p{Nd}²³¹⁰⁴-⁹₀-₉")),
        "special_char_ratio": _per_char(_of_class(r"^\p{L}\p{N}" + L.WS[1:-1])),
        "space_ratio": _per_char(_n("nc") - F.length(F.array_join("pieces", ""))),
        "newline_ratio": _per_char(_count("\n")),
        "tab_ratio": _per_char(_count("\t")),
    }


def _char_counts() -> dict[str, Column]:
    return {
        "angle_bracket_count": _count("<", ">"),
        "asterisk_count": _count("*"),
        "backtick_count": _count("`"),
        "colon_count": _count(":"),
        "curly_brace_count": _count("{", "}"),
        "double_quote_count": _count('"'),
        "pipe_count": _count("|"),
        "semicolon_count": _count(";"),
        "single_quote_count": _count("'"),
        "square_bracket_count": _count("[", "]"),
        "tilde_count": _count("~"),
        "hyphen_sequence_count": X.hits(T(), "-{3,}", needs=("---",)),
        "underscore_sequence_count": X.hits(T(), "_{3,}", needs=("___",)),
    }


def _entropy_diversity() -> dict[str, Column]:
    nw, distinct = _n("nw"), _n("distinct_words")
    n, _, mass = (F.get("char_grams", F.lit(k)) for k in range(3))
    share = lambda count, total: count / _at_least_one(total)
    bigrams, trigrams = share(_n("distinct_bigrams"), nw - 1), share(_n("distinct_trigrams"), nw - 2)
    from_n = lambda k, value: F.when(nw >= k, value).otherwise(F.lit(0.0))
    return {
        "char_entropy": X.entropy_of_mass(mass, n),
        "word_entropy": X.entropy_of_mass(F.col("word_mass"), F.col("nw")),
        "unique_word_ratio": _per_word(distinct),
        "hapax_ratio": F.coalesce("single_words", F.lit(0.0)) / _at_least_one(distinct),
        "word_repeat_ratio": 1.0 - _per_word(distinct),
        "bigram_repeat_ratio": from_n(3, 1.0 - bigrams),
        "trigram_repeat_ratio": from_n(3, 1.0 - trigrams),
        "char_trigram_entropy": _gram_entropy(0),
        "char_quadgram_entropy": _gram_entropy(3),
        "sliding_ttr_50": F.col("ttr_50"),
        "sliding_ttr_100": F.col("ttr_100"),
        "word_length_entropy": _digit_entropy(),
        "bigram_diversity": from_n(2, bigrams),
        "trigram_diversity": from_n(3, trigrams),
    }


def _keywords() -> dict[str, Column]:
    hits = _n("keyword_hits")
    return {
        "attack_keyword_count": hits,
        "has_attack_keyword": X.flag(hits > 0),
        "keyword_density": _per_word(hits),
    }


def _encoding_patterns() -> dict[str, Column]:
    names = list(L.ENCODING_PATTERNS)
    columns = {f"encoding_{n}": _n(f"enc_{n}") for n in names}
    return {**columns, "total_encoding_hits": X.total(columns.values())}


def _structural_patterns() -> dict[str, Column]:
    columns = {f"structural_{n}": F.col(f"struct_{n}") for n in L.STRUCTURAL_PATTERNS}
    return {**columns, "total_structural_hits": X.total(columns.values())}


def _text_booleans() -> dict[str, Column]:
    return {
        "contains_question": X.flag(F.contains(T(), F.lit("?"))),
        "has_brackets": X.flag(X.found(T(), L.BRACKETS)),
        "has_colon_separated": X.flag(X.found(T(), L.ROLE_COLON, needs=(":",))),
        "has_delimiter": X.flag(X.found(T(), L.DELIMITERS, needs=("```", "---", "[INST]", "<<SYS>>"))),
        "has_ellipsis": X.flag(F.contains(T(), F.lit("..."))),
        "has_em_dash": X.flag(X.found(T(), f"[{L.DASHES}]")),
        "has_parenthetical": X.flag(X.found(T(), L.PARENTHETICAL, needs=("(",))),
        "has_xml_tags": X.flag(X.found(T(), L.XML_TAG, needs=("<",))),
        "triple_repeat": X.flag(X.found(T(), r"(.)\1\1")),
        "has_bullet_list": X.flag(X.found(T(), L.BULLET_LINE, "m", needs=("-", "*", "+"))),
        "has_hyphenated_compound": X.flag(X.found(T(), r"\w-\w", needs=("-",))),
        "has_numbered_list": X.flag(X.found(T(), L.NUMBERED_LINE, "m", needs=(".",))),
        "starts_with_imperative": X.flag(F.coalesce(F.get("w", F.lit(0)).isin(list(L.IMPERATIVE_VERBS)), F.lit(False))),
    }


def _code_markup(corrected: bool) -> dict[str, Column]:
    shouted = F.size(F.filter(
        "pieces",
        lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w),
    ))
    return {
        # Two capitals are looked for first, so the word edges are rarely examined.
        "caps_sequence_count": F.regexp_count(
            T(), F.lit(f"(?=[A-Z]{{2}})(?<!{L.WORD})[A-Z]{{2,}}+(?!{L.WORD})")
        ),
        # The published feature looks at lower-cased words and is always 0.
        "caps_word_count": shouted.cast("double") if corrected else F.lit(0.0),
        "has_inline_code": _capped(0.3, X.hits(T(), L.INLINE_CODE, needs=("`",))),
        "has_html_tags": _capped(0.2, X.hits(T(), L.HTML_TAG, needs=(">",))),
        "has_json_structure": F.least(
            F.lit(1.0),
            F.when(X.found(T(), L.JSON_KEY, needs=("{",)), 0.5).otherwise(0.0)
            + F.when(X.found(T(), L.JSON_ARRAY, needs=("[",)), 0.3).otherwise(0.0),
        ),
        "has_url": _capped(0.3, X.hits(T(), L.URL, needs=("http", "www."))),
    }


def _markers_roles() -> dict[str, Column]:
    # The first letter is looked for first, so the word edges are rarely examined.
    marker = lambda role: X.flag(X.found(T(), rf"(?={role[0]})\b{role}\s*:", "iu", needs=(":",)))
    return {
        "has_assistant_marker": marker("ASSISTANT"),
        "has_system_marker": marker("SYSTEM"),
        "has_user_marker": marker("USER"),
        "role_transition_count": X.hits(T(), L.ROLE_LABEL, "iu", needs=(":",)),
    }


def _nesting_structure() -> dict[str, Column]:
    marks = (
        _count("*", "_", "`", "#") + X.hits(T(), L.MARKDOWN_LINK, needs=("](",))
        + X.hits(T(), L.BULLET_LINE, "m", needs=("-", "*", "+")) + X.hits(T(), L.NUMBERED_LINE, "m", needs=(".",))
    )
    blank = "".join(chr(c) for c in (
        *range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
        0x202F, 0x205F, 0x3000,
    ))
    return {
        "delimiter_depth": F.greatest(
            X.hits(T(), "`{3,}", needs=("```",)), F.contains(T(), F.lit("---")).cast("int")
        ),
        "instruction_nesting_depth": _nesting(),
        "markdown_density": F.least(F.lit(1.0), _per_char(marks)),
        "paragraph_count": X.hits(F.btrim(T(), F.lit(blank)), r"\n\s*\n", needs=("\n",)) + 1,
    }


def _unicode_escape() -> dict[str, Column]:
    odd = F.length(T()) - F.length(F.translate(T(), L.HOMOGLYPHS, ""))
    return {
        "escape_char_density": F.least(F.lit(1.0), _per_word(X.hits(T(), L.ESCAPES, needs=("\\",)))),
        "unicode_anomaly_score": F.least(F.lit(1.0), _per_char(odd)),
    }


def _linguistic() -> dict[str, Column]:
    second, temporal, modal = _per_word(_members("SECOND_PERSON")), _n("temporal_hits"), _members("MODAL_VERBS")
    joined = F.col("joined")
    return {
        "conditional_marker_count": _members("CONDITIONAL_WORDS"),
        "imperative_verb_ratio": _per_word(_members("IMPERATIVE_VERBS")),
        "modal_verb_count": modal,
        "modal_verb_ratio": _per_word(modal),
        "negation_density": _per_word(_members("NEGATION_WORDS")),
        "politeness_marker_count": X.count_phrases(joined, L.POLITENESS_MARKERS),
        "question_density": _per_word(_count("?")),
        "second_person_ratio": second,
        "temporal_marker_count": temporal,
        "third_person_ratio": _per_word(_members("THIRD_PERSON")),
        "urgency_marker_count": X.count_phrases(joined, L.URGENCY_MARKERS),
        "has_second_person": X.flag(second > 0),
        "has_temporal_marker": X.flag(temporal > 0),
    }


def _attack_specific() -> dict[str, Column]:
    refuse = ("refuse", "decline", "say")
    persona = [
        X.found(LOW(), p, needs=n)
        for p, n in zip(L.PERSONA_DEFINITION, (("you",), ("you",), refuse))
    ]
    any_persona = persona[0] | persona[1] | persona[2]
    graded = F.least(
        F.lit(1.0),
        F.lit(0.5) + F.when(persona[1], 0.3).otherwise(0.0) + F.when(persona[2], 0.2).otherwise(0.0),
    )
    payload = _capped(0.4, _patterns(
        L.ENCODED_PAYLOAD, (("decode", "decipher", "interpret", "translate"), ("base64", "rot13", "hex", "url"), ("encode", "decode"))
    ))
    return {
        "has_encoded_payload_hint": payload,
        "encoding_instruction_ratio": payload,
        "has_negative_constraints": _capped(0.5, _patterns(L.NEGATIVE_CONSTRAINTS, (refuse, refuse, ("ethical", "safety", "moral")))),
        "has_output_instruction": _capped(0.4, _patterns(
            L.OUTPUT_INSTRUCTIONS, (("with", "only", "just", "exactly"), ("output", "print", "display"), ("response",))
        )),
        "has_system_override": _capped(0.4, _patterns(
            L.SYSTEM_OVERRIDES, (("ignore", "forget", "disregard", "override"), (":",), ("system",))
        )),
        "persona_keyword_count": X.count_phrases(LOW(), L.PERSONA_PHRASES),
        "unrestricted_keyword_count": X.count_phrases(LOW(), L.UNRESTRICTED_PHRASES),
        "mode_switch_count": X.count_phrases(LOW(), L.MODE_SWITCH_PHRASES),
        "has_persona_definition": F.when((_n("nw") >= 3) & any_persona, graded).otherwise(F.lit(0.0)),
    }


def _injection_detection() -> dict[str, Column]:
    return {
        "has_nested_delimiters": X.flag(X.found(T(), L.FENCED_BLOCK, needs=("```",))),
        "has_xml_injection": _xml_injection(),
        "has_comment_injection": X.flag(X.found(T(), L.HTML_COMMENT, "s", needs=("<!--",))),
        "has_prompt_fragment": X.flag(X.found(T(), L.ROLE_FRAGMENT, "iu", needs=(":",))),
    }


def _readability(corrected: bool) -> dict[str, Column]:
    nw, sentences = _n("nw"), _n("sentences")
    some = lambda value: F.when(nw > 0, value).otherwise(F.lit(0.0))
    syllables = F.aggregate("syllables", F.lit(0), lambda a, s: a + s).cast("double")
    grade = some(0.39 * (nw / sentences) + 11.8 * (syllables / nw) - 15.59)
    index = some(0.0588 * (100.0 * _n("letters") / nw) - 0.296 * (100.0 * sentences / nw) - 15.8)
    squares = F.aggregate("lengths", F.lit(0.0), lambda a, n: a + n * n)
    return {
        "coleman_liau_index": index,
        "flesch_kincaid_grade": grade,
        "readability_composite": (grade + index) / 2.0,
        "avg_syllables": some(syllables / nw),
        "max_syllables": F.coalesce(F.array_max("syllables"), F.lit(0)).cast("double"),
        "word_length_variance": some(F.greatest(squares / nw - _n("mean_length") * _n("mean_length"), F.lit(0.0))),
        # The published feature is the variance of a constant and is always 0.
        "sentence_length_variance": _sentence_variance() if corrected else F.lit(0.0),
    }


def _punctuation_misc() -> dict[str, Column]:
    return {"exclamation_ratio": _per_char(_count("!"))}


def _builders(corrected: bool) -> dict[str, Callable[[], dict[str, Column]]]:
    return {
        "text_statistics": _text_statistics, "char_composition": _char_composition,
        "char_counts": _char_counts, "entropy_diversity": _entropy_diversity, "keywords": _keywords,
        "encoding_patterns": _encoding_patterns, "structural_patterns": _structural_patterns,
        "text_booleans": _text_booleans, "code_markup": lambda: _code_markup(corrected),
        "markers_roles": _markers_roles, "nesting_structure": _nesting_structure,
        "unicode_escape": _unicode_escape, "linguistic": _linguistic,
        "attack_specific": _attack_specific, "injection_detection": _injection_detection,
        "readability": lambda: _readability(corrected), "punctuation_misc": _punctuation_misc,
    }


ENCODING_NEEDS = {
    "base64": (), "hex": ("0x",), "url_encoded": ("%",), "unicode_escape": ("\\u",), "html_entity": ("&",),
}
# Same matches; the possessive form cannot recurse once per repetition, and no match begins inside a run.
ENCODING_FORMS = {
    **L.ENCODING_PATTERNS, "hex": r"(?:0x[0-9a-fA-F]{2}\s*+){4,}+",
    "base64": r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}+={0,2}",
}
STRUCTURAL_NEEDS = {
    "instruction_override": ("ignore", "forget", "disregard", "override"),
    "role_hijack": ("now", "instructions", "act"),
    "system_extraction": ("prompt", "instructions", "rules", "guidelines"),
    "delimiter_injection": ("```", "---", "<|system|>", "<|endoftext|>"),
    "persona_switch": ("pretend", "imagine", "simulate", "hypothetically"),
}


TTR_WINDOWS = (50, 100)
MEMBERS = ("CONDITIONAL_WORDS", "IMPERATIVE_VERBS", "MODAL_VERBS", "NEGATION_WORDS", "SECOND_PERSON", "THIRD_PERSON")


def _staged(texts: DataFrame, kept: Sequence[str]) -> DataFrame:
    base = texts.select(
        *kept, F.col("prompt_text").alias("t"), F.lower("prompt_text").alias("low"),
        F.array_join(X.words(F.col("prompt_text")), " ").alias("joined"),
    )
    # All Arrow functions are in one projection over plain strings, so that texts go to Python once.
    tokens = base.select(
        *kept, "t", "low", "joined",
        F.when(F.col("joined") == "", F.array().cast("array<string>")).otherwise(F.split("joined", " ")).alias("w"),
        gram_masses(T(), (1,)).alias("char_grams"), gram_masses(LOW(), (3, 4)).alias("low_grams"),
        word_measures(F.col("joined"), TTR_WINDOWS, [getattr(L, n) for n in MEMBERS]).alias("measures"),
    )
    places = ("distinct_words", "single_words", "word_mass", "distinct_bigrams", "distinct_trigrams", None, None,
              *[f"ttr_{n}" for n in TTR_WINDOWS], *[f"{n}_hits" for n in MEMBERS])
    return tokens.select(
        *kept, "t", "low", "w", "joined", "char_grams", "low_grams",
        *[F.get("measures", F.lit(k)).alias(n) for k, n in enumerate(places) if n],
        F.length("t").alias("nc"), F.size("w").alias("nw"),
        F.greatest(_count(".", "!", "?"), F.lit(1.0)).alias("sentences"),
        F.split(T(), L.WS + "+").alias("pieces"),
        F.transform("w", F.length).alias("lengths"),
        X.mean_length(W()).alias("mean_length"),
        F.array_join(F.transform("w", lambda x: F.length(x).cast("string")), "").alias("length_digits"),
        _syllables().alias("syllables"),
        F.length(F.regexp_replace(T(), r"[^\p{L}]+", "")).alias("letters"),
        X.count_phrases(LOW(), L.ATTACK_KEYWORDS).alias("keyword_hits"),
        X.count_phrases(F.col("joined"), L.TEMPORAL_MARKERS).alias("temporal_hits"),
        *[X.hits(T(), p, needs=ENCODING_NEEDS[n]).alias(f"enc_{n}") for n, p in ENCODING_FORMS.items()],
        *[X.flag(X.found(LOW(), p, needs=STRUCTURAL_NEEDS[n])).alias(f"struct_{n}") for n, p in L.STRUCTURAL_PATTERNS.items()],
    )


def features(texts: DataFrame, groups: Iterable[str] | None = None, corrected: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """(prompt_id, columns to keep, features of the groups) as doubles, features in name order.

    ``corrected=False`` keeps two published features at their constant 0.
    """
    builders = _builders(corrected)
    columns: dict[str, Column] = {}
    for group in builders if groups is None else groups:
        columns.update(builders[group]())
    kept = ("prompt_id", *keep)
    return _staged(texts, kept).select(
        *kept, *[columns[n].cast("double").alias(n) for n in sorted(columns)]
    )
