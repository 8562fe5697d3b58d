"""Text column expressions: tokens, sentences, stop words, punctuation, numbers.

Every function here returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage code generation (no Python in the hot path).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Token: maximal run of letters or digits, after lower-casing.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# Sentence: text up to and including its terminators (. ! ? or a line break).
SENTENCE_PATTERN = r"[^.!?\n]+[.!?\n]*"
# English stop words dropped by the keyword query and the BM25 analyser.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "for",
              "is", "are", "that", "with", "as", "was", "it")
# ASCII punctuation, each replaced by "_" in keys:
PUNCTUATION = """!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""
# (the regex character class below is built from that string, each character escaped)
PUNCT_CLASS = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"
# ----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(col) -> Column:
    """Lower-cased letter/digit runs, in order (ARRAY<STRING>)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_PATTERN), 0)


def stop_array() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def drop_stop_words(tok_array: Column) -> Column:
    """Remove stop words from a token array, keeping order and repeats."""
    return F.filter(tok_array, lambda t: ~t.isin(*STOP_WORDS))


def analysed_tokens(col) -> Column:
    """Tokens with the stop words removed (the BM25 / keyword analyser)."""
    return drop_stop_words(tokens(col))


def sentences(col) -> Column:
    """Sentences of a text, trimmed, blanks dropped (ARRAY<STRING>).

    Position in the array is the sentence number (0-based after posexplode).
    """
    raw = F.regexp_extract_all(_c(col), F.lit(SENTENCE_PATTERN), 0)
    trimmed = F.transform(raw, lambda s: F.trim(s))
    return F.filter(trimmed, lambda s: s != F.lit(""))


def depunct(col) -> Column:
    """Replace every ASCII punctuation character with ``_``."""
    return F.regexp_replace(_c(col), PUNCT_CLASS, "_")


# Decimal numbers, with an exponent or not, and the words for infinity and not-a-number.
NUMBER_PATTERN = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"


def to_number(col) -> Column:
    """Integer if the text is one, else a float, else NULL (as DOUBLE).

    Surrounding blanks are allowed, as Python's ``int``/``float`` allow them.
    Underscore digit groups (``1_000``) and the JVM's own forms (``1d``,
    ``0x1p3``) are not accepted.
    """
    s = F.trim(_c(col))
    s = F.when(s.rlike(NUMBER_PATTERN), s)
    as_int = s.try_cast("bigint")
    as_dbl = s.try_cast("double")
    return F.coalesce(as_int.cast("double"), as_dbl)


def is_integer_text(col) -> Column:
    return F.trim(_c(col)).try_cast("bigint").isNotNull()


def keyword_text(col) -> Column:
    """Keyword form of a query: analysed tokens joined by a space."""
    return F.array_join(analysed_tokens(col), " ")
