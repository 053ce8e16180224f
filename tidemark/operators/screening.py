"""Screening of text columns for injected instructions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.cells import cell, literal_rows
from tidemark.functions.guards import require_column, require_new


@dataclass(frozen=True)
class ScreenPack:
    """Phrase patterns and words whose letters may be scrambled, for one language."""

    patterns: tuple[str, ...]
    words: tuple[str, ...]


# The screening lists.
ENGLISH = ScreenPack(
    patterns=(
        r"ignore\s+(all\s+)?previous\s+instructions?",
        r"you\s+are\s+now\s+(in\s+)?developer\s+mode",
        r"system\s+override",
        r"reveal\s+prompt",
    ),
    words=("ignore", "bypass", "override", "reveal", "delete", "system"),
)
PORTUGUESE = ScreenPack(
    patterns=(
        r"ignore\s+(toda\s+)?instruções\s?anteriores\s+",
        r"você\s+está\s+agora\s+(em\s+)?modo\s+desenvolvedor",
        r"sobrescreva\s+sistema",
        r"revele\s+(o)?(seu)?prompt",
    ),
    words=("ignore", "ultrapasse", "sobrescreva", "revele", "delete", "sistema"),
)
PACKS = {"en": ENGLISH, "pt": PORTUGUESE}

FILTERED = "[FILTERED]"

# A word character is a letter or number of any script, or the underscore.
LETTER = r"[\p{L}\p{N}_]"


def _flagged(pattern: str) -> str:
    """Case-insensitive, with Unicode classes, as the lists hold accented letters."""
    return "(?iuU)" + pattern


# Letters that match `s` or `i` without case although their lower case is another letter.
ODD_LETTERS = "ſıİ"


def _fits_lower_case(pattern: str) -> bool:
    """The pattern, put in lower case, finds in lower-case text what it finds without case.

    Not so with upper-case classes, character sets, inline flags and letters beyond Latin-1.
    """
    plain = not re.search(r"\\[A-Z]|\[|\(\?", pattern)
    return plain and "µ" not in pattern and all(ord(c) < 256 for c in pattern)


def _any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def matches_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """Any of the phrase patterns occurs in the text, whatever the case.

    A search that minds the case skips ahead by whole words, so where that gives the same
    result the patterns are searched in the lower-case text.
    """
    quick = [p for p in patterns if _fits_lower_case(p)]
    slow = [text.rlike(_flagged(p)) for p in patterns if p not in quick]
    lower = F.lower(text)
    found = _any_of([lower.rlike("(?U)" + p.lower()) for p in quick])
    odd = _any_of([F.contains(text, F.lit(c)) for c in ODD_LETTERS])
    return found | (odd & _any_of([text.rlike(_flagged(p)) for p in quick])) | _any_of(slow)


def words_of(text: Column) -> Column:
    """The lower-case words of the text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({LETTER}+)"), F.lit(1))


def _scrambles(word: str) -> str:
    """A pattern for the word with its inner letters in any order.

    After the first letter come as many letters of the inner set as the word has, then its
    last letter and the word's end; and each inner letter occurs as often as in the word.
    """
    first, inner, last = word[0], word[1:-1], word[-1]
    end = f"{last}(?!{LETTER})"
    letters = sorted(set(inner))
    counts = []
    for letter in letters:
        others = "".join(x for x in letters if x != letter)
        skip = f"[{others}]*" if others else ""
        counts.append(f"(?=(?:{skip}{letter}){{{inner.count(letter)}}}[{''.join(letters)}]*{end})")
    return f"{first}(?=[{''.join(letters)}]{{{len(inner)}}}{end}){''.join(counts)}"


def has_scrambled_word(text: Column, words: Sequence[str]) -> Column:
    """Some word equals a listed one up to the order of its inner letters.

    One search of the text, which ends at the first hit.
    """
    # Only letters, numbers and underscores make up a word of the text.
    targets = [w.lower() for w in words if len(w) >= 3 and re.fullmatch(r"\w+", w)]
    if not targets:
        return F.lit(False)
    firsts = "".join(dict.fromkeys(w[0] for w in targets))
    any_word = "|".join(_scrambles(w) for w in targets)
    return F.lower(text).rlike(f"(?=[{firsts}])(?<!{LETTER})(?:{any_word})")


def is_injection(text: Column, pack: ScreenPack) -> Column:
    """A phrase pattern or a (possibly scrambled) listed word occurs. NULL text is clean."""
    hit = matches_pattern(text, pack.patterns) | has_scrambled_word(text, pack.words)
    return F.coalesce(hit, F.lit(False))


def is_injection_in(text: Column, language: Column, packs: Mapping[str, ScreenPack]) -> Column:
    """Screen each row with its language's pack; other languages are not screened."""
    verdict = F.lit(False)
    for name, pack in packs.items():
        verdict = F.when(language == name, is_injection(text, pack)).otherwise(verdict)
    return verdict


def sanitized(text: Column, pack: ScreenPack, max_length: int | None = None) -> Column:
    """White space collapsed, runs of four or more equal characters cut to one, phrases
    replaced by a mark. Only where `max_length` is given the result is cut to so many characters."""
    out = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")
    out = F.regexp_replace(out, r"(?s)(.)\1{3,}", "$1")
    marked = out
    for pattern in pack.patterns:
        marked = F.regexp_replace(marked, _flagged(pattern), FILTERED)
    # Without a match of any pattern none of the replacements does anything.
    clean = F.when(matches_pattern(out, pack.patterns), marked).otherwise(out)
    return clean if max_length is None else F.substring(clean, 1, max_length)


def screen_table(
    df: DataFrame,
    column: str,
    packs: Mapping[str, ScreenPack] | ScreenPack = ENGLISH,
    language: str | None = None,
    flag: str = "injection",
) -> DataFrame:
    """Add a boolean column that marks rows whose text looks like an injected instruction.

    A single pack screens every row; a mapping screens by the `language` column.
    """
    require_column(df, column)
    require_new(df, flag)
    if isinstance(packs, ScreenPack):
        verdict = is_injection(cell(column), packs)
    else:
        if language is None:
            raise ValueError("A mapping of packs needs the column that names the language.")
        require_column(df, language)
        verdict = is_injection_in(cell(column), cell(language), packs)
    return df.withColumn(flag, verdict)


def screen_cells(df: DataFrame, pack: ScreenPack = ENGLISH) -> DataFrame:
    """`column, n_flagged` for every text column of a table, from one scan."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return literal_rows(df.sparkSession, [], "column string, n_flagged long")
    row = df.agg(*[F.count_if(is_injection(cell(c), pack)).alias(c) for c in texts])
    return row.unpivot([], [cell(c) for c in texts], "column", "n_flagged")
