"""An English suffix stemmer (Porter 1980, "An algorithm for suffix
stripping") as one column expression, applied to a *vocabulary* table. No
Python runs; every step is bound to a name once, so the expression stays small.

Only words of ASCII letters a-z are stemmed; anything else (other scripts,
digits) is returned unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (suffix rules of the published algorithm) ---------------------
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
         ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
         ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
         "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# ----------------------------------------------------------------------------------


def shape(w: Column) -> Column:
    """Every letter of a word as c (consonant) or v (vowel). A y is a consonant
    at the start or after a vowel: first a y after a plain consonant becomes a
    vowel, then every second y of the runs that remain."""
    plain = F.replace(F.regexp_replace(w, "([^aeiouy])y", "$1i"), F.lit("yy"), F.lit("yi"))
    return F.translate(plain, "abcdefghijklmnopqrstuvwxyz", "vcccvcccvcccccvcccccvccccc")


# The measure m of [C](VC)^m[V] counts changes from vowel to consonant.
def _over_0(s: Column) -> Column:
    return s.contains("vc")


def _over_1(s: Column) -> Column:
    return s.rlike("vc+v+c")


def _double(w: Column, s: Column) -> Column:
    """Ends in a double consonant."""
    return (F.length(w) >= 2) & (F.right(w, F.lit(1)) == F.substring(F.right(w, F.lit(2)), 1, 1)) & s.endswith("c")


def _cvc(w: Column, s: Column) -> Column:
    """Ends consonant, vowel, consonant other than w, x, y."""
    return s.endswith("cvc") & ~w.rlike("[wxy]$")


def _cut(x: Column, n) -> Column:
    """The text without its last n letters."""
    return F.left(x, F.length(x) - n)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _step(w: Column, body) -> Column:
    """``body`` of a word and its shape."""
    return _let(w, lambda x: _let(shape(x), lambda s: body(x, s)))


def _plural(w: Column) -> Column:
    return (F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2))
            .when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w))


def _past(w: Column, s: Column) -> Column:
    """-eed, -ed and -ing; what the last two leave is mended."""
    return (F.when(w.endswith("eed"), F.when(_over_0(_cut(s, 3)), _cut(w, 1)).otherwise(w))
            .when(w.endswith("ed") & _cut(s, 2).contains("v"), _let(_cut(w, 2), lambda t: _mended(t, _cut(s, 2))))
            .when(w.endswith("ing") & _cut(s, 3).contains("v"), _let(_cut(w, 3), lambda t: _mended(t, _cut(s, 3))))
            .otherwise(w))


def _mended(w: Column, s: Column) -> Column:
    return (F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e")))
            .when(_double(w, s) & ~w.rlike("[lsz]$"), _cut(w, 1))
            .when(_over_0(s) & ~_over_1(s) & _cvc(w, s), F.concat(w, F.lit("e"))).otherwise(w))


def _last_y(w: Column, s: Column) -> Column:
    return F.when(w.endswith("y") & _cut(s, 1).contains("v"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _suffixes(suffixes, rewrite):
    """A step: the longest of the suffixes is replaced as ``rewrite(stem, shape
    of the stem, suffix)`` says (null: the word stays)."""
    pattern = "(" + "|".join(suffixes) + ")$"

    def step(w: Column, s: Column) -> Column:
        return _let(F.regexp_extract(w, pattern, 1), lambda f: F.when(
            f != "", F.coalesce(rewrite(_cut(w, F.length(f)), _cut(s, F.length(f)), f), w)).otherwise(w))
    return step


def _replaced(rules):
    """A step: a suffix gives way to another where its stem has a measure."""
    ending = F.create_map(*[F.lit(x) for rule in rules for x in rule])
    return _suffixes([a for a, _ in rules], lambda stem, s, f: F.when(_over_0(s), F.concat(stem, F.element_at(ending, f))))


def _last_e(w: Column, s: Column) -> Column:
    left = _cut(s, 1)
    return F.when(w.endswith("e") & (_over_1(left) | _over_0(left) & ~_cvc(_cut(w, 1), left)), _cut(w, 1)).otherwise(w)


def _last_l(w: Column, s: Column) -> Column:
    return F.when(w.endswith("ll") & _over_1(s), _cut(w, 1)).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a word of more than two letters a-z; other texts as they are."""
    dropped = _suffixes(STEP4, lambda t, s, f: F.when(_over_1(s) & ((f != "ion") | t.rlike("[st]$")), t))
    w = _let(word, _plural)
    for step in (_past, _last_y, _replaced(STEP2), _replaced(STEP3), dropped, _last_e, _last_l):
        w = _step(w, step)
    return F.when((F.length(word) > 2) & word.rlike("^[a-z]+$"), w).otherwise(word)


def stem_vocabulary(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """(term, stem) for the distinct terms that are not null: the stemmer runs
    once per distinct word, not once per occurrence."""
    vocab = terms.select(term_col).distinct().filter(F.col(term_col).isNotNull())
    return vocab.select(term_col, stem(F.col(term_col)).alias("stem"))
