"""Text cleaning and analysis."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of the search analyzer.
ENGLISH_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)

# Latin letters that fold to something other than their base letter.
LETTER_FOLDS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH",
    "ø": "o", "Ø": "O", "ð": "d", "Ð": "D", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L",
    "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ı": "i", "ŋ": "n", "Ŋ": "N",
}

WORD = r"[\p{L}\p{N}]+"


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and the ASCII letters they decompose to."""
    source, target = [], []
    for block in (range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        for code in block:
            letter = chr(code)
            base = unicodedata.normalize("NFKD", letter)[0]
            if letter not in LETTER_FOLDS and base != letter and base.isascii() and base.isalpha():
                source.append(letter)
                target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()
_SINGLE_FOLDS = {k: v for k, v in LETTER_FOLDS.items() if len(v) == 1}
_LONG_FOLDS = {k: v for k, v in LETTER_FOLDS.items() if len(v) > 1}


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once, for expressions using it often."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def is_blank(c: Column) -> Column:
    """True for null, empty or whitespace-only text."""
    return ~F.coalesce(c.rlike(r"\S"), F.lit(False))


def not_blank(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def null_if_blank(c: Column) -> Column:
    return F.when(not_blank(c), c)


def collapse_spaces(c: Column) -> Column:
    """Newlines to spaces, runs of spaces to one."""
    return F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), " +", " ")


def clean_titles(titles: Column) -> Column:
    """Collapsed, non-blank entries of an array of titles."""
    return F.filter(F.transform(titles, collapse_spaces), not_blank)


def simple_clean(c: Column) -> Column:
    """Collapsed and trimmed text without the double quotes around it."""
    trimmed = F.trim(collapse_spaces(c))
    return F.trim(F.regexp_replace(trimmed, '^"+|"+$', ""))


def clean_article_title(c: Column) -> Column:
    """Drop one final dot, then one opening and one closing square bracket."""
    return F.regexp_replace(F.regexp_replace(c, r"\.$", ""), r"^\[|\]$", "")


def clean_reference_string(c: Column) -> Column:
    """Newlines and tabs to spaces, runs of spaces to one, trimmed."""
    return F.trim(F.regexp_replace(c, "[\n\t ]+", " "))


def strip_markup(c: Column) -> Column:
    """Text of an XML fragment kept as a string."""
    text = F.regexp_replace(c, "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_field(c: Column) -> Column:
    """Cut punctuation runs at both ends of a metadata field.

    A final semicolon that closes an HTML entity is kept, one pair of outer
    parentheses and an outer pair of ``&quot;`` are removed.
    """
    text = F.replace(F.replace(c, F.lit(",,"), F.lit(",")), F.lit(", ,"), F.lit(","))
    # the right cut stops at the first character; of a run on the left the last
    # character stays
    text = F.regexp_replace(text, r"(?<=.)(?:[, .\-_/:]|(?<!&..|&...|&....|&.....);)+$", "")
    text = F.trim(F.regexp_replace(text, r"^[, .;\-_:]*(?=[, .;\-_:])", ""))
    text = F.trim(F.regexp_replace(text, r"(?s)^\((.*)\)$", "$1"))
    quoted = F.trim(F.regexp_replace(text, r"(?s)^&quot;(.+)&quot;$", "$1"))
    text = F.when(F.length(text) > 12, quoted).otherwise(text)
    return F.when(F.length(c) > 0, text)


def fold_ascii(c: Column, *, lowered: bool = False) -> Column:
    """Replace accented and special Latin letters by ASCII letters.

    ``lowered`` text has no capitals left, so fewer letters are looked for.
    """
    wanted = lambda letter: not lowered or letter == letter.lower()
    pairs = [*zip(_ACCENTED, _PLAIN), *_SINGLE_FOLDS.items()]
    pairs = [(letter, plain) for letter, plain in pairs if wanted(letter)]
    folded = F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    for letter, letters in _LONG_FOLDS.items():
        if wanted(letter):
            folded = F.replace(folded, F.lit(letter), F.lit(letters))
    return folded


def words(c: Column) -> Column:
    """All runs of letters and digits, in text order."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def folded_words(c: Column) -> Column:
    """All words of a text, lower-cased and folded.  ASCII text has nothing to fold and a plainer pattern."""
    lowered = F.lower(c)
    plain = F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(F.octet_length(c) == F.length(c), plain).otherwise(words(fold_ascii(lowered, lowered=True)))


def analyze(c: Column, analyzer: str) -> Column:
    """Token array of a text column.

    ``keyword``       the whole lower-cased value
    ``keyword_fold``  the whole lower-cased and folded value
    ``words``         folded lower-case words
    ``words_stop``    the same without English stop words
    """
    if analyzer == "keyword":
        tokens = F.array(F.lower(c))
    elif analyzer == "keyword_fold":
        tokens = F.array(fold_ascii(F.lower(c), lowered=True))
    elif analyzer == "words":
        tokens = folded_words(c)
    elif analyzer == "words_stop":
        tokens = F.filter(folded_words(c), lambda t: ~t.isin(*ENGLISH_STOP_WORDS))
    else:
        raise ValueError(f"unknown analyzer {analyzer!r}")
    return F.when(not_blank(c), tokens)
