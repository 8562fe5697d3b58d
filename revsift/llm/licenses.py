"""Operator 5: licence scan by an Aho-Corasick automaton over words.

One pass over a text's words finds base phrases, further notice phrases and
identifier tags; the expression behind a tag is read from the original text
and evaluated by a shunting-yard parser (AND, OR, WITH, brackets).
"""

from __future__ import annotations

import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField, StructType)

from .common import id_text, map_batches

# The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notice phrases (words as the scan takes them) and their labels.
NOTICE_PHRASES = {
    "apache software license": "apache-2",
    "licensed under the apache license": "apache-2",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl-1",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4": "cc-by",
    "cc0 1": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
# The tag that introduces an expression.
TAG = "spdx license identifier"
TAG_LABEL = "\x00tag"
# Identifiers (lower case, version suffixes -only and -or-later cut) and their labels.
IDENTIFIERS = {
    "mit": "mit", "apache-2.0": "apache-2", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "isc": "isc",
    "zlib": "zlib", "unlicense": "public-domain", "cc0-1.0": "cc0", "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3",
    "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "agpl-3.0": "agpl", "mpl-2.0": "mpl-2", "epl-2.0": "epl",
    "bsl-1.0": "bsl-1", "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-nd-4.0": "cc-by-nd",
    "0bsd": "bsd", "afl-3.0": "afl", "agpl-1.0": "agpl", "apache-1.0": "apache-1", "apache-1.1": "apache-1", "artistic-1.0": "artistic",
    "artistic-2.0": "artistic", "bsd-1-clause": "bsd", "bsd-3-clause-clear": "bsd", "bsd-4-clause": "bsd", "cc-by-2.0": "cc-by",
    "cc-by-2.5": "cc-by", "cc-by-3.0": "cc-by", "cc-by-nc-3.0": "cc-by-nc", "cc-by-nc-nd-4.0": "cc-by-nc-nd", "cc-by-nc-sa-4.0": "cc-by-nc-sa",
    "cc-by-nd-3.0": "cc-by-nd", "cc-by-sa-2.0": "cc-by-sa", "cc-by-sa-2.5": "cc-by-sa", "cc-by-sa-3.0": "cc-by-sa", "cddl-1.0": "cddl",
    "cddl-1.1": "cddl", "curl": "mit", "ecl-2.0": "ecl", "epl-1.0": "epl", "eupl-1.1": "eupl", "eupl-1.2": "eupl", "fsfap": "fsfap", "gpl-1.0": "gpl",
    "lgpl-2.0": "lgpl", "mit-0": "mit", "mpl-1.1": "mpl", "ms-pl": "ms-pl", "ncsa": "ncsa", "odbl-1.0": "odbl", "ofl-1.1": "ofl", "openssl": "openssl",
    "osl-3.0": "osl", "pddl-1.0": "public-domain", "postgresql": "postgresql", "psf-2.0": "psf", "python-2.0": "psf", "upl-1.0": "upl", "wtfpl": "wtfpl",
    "x11": "mit",
}
# How restrictive a label is: 0 none asked, 1 notice, 2 share alike for files,
# 3 share alike for works, 4 no use in trade or no changes, 5 nothing granted.
STRICTNESS = {
    "public-domain": 0, "cc0": 0, "mit": 1, "apache-2": 1, "bsd": 1, "isc": 1, "zlib": 1, "bsl-1": 1, "cc-by": 1,
    "lgpl": 2, "mpl": 2, "mpl-2": 2, "epl": 2, "gpl": 3, "gpl-2": 3, "gpl-3": 3, "agpl": 3, "cc-by-sa": 3,
    "cc-by-nc": 4, "cc-by-nd": 4, "cc-by-nc-nd": 4, "cc-by-nc-sa": 4, "all-rights-reserved": 5,
    "afl": 1, "apache-1": 1, "artistic": 1, "ecl": 1, "fsfap": 1, "ms-pl": 1, "ncsa": 1, "ofl": 1, "openssl": 1, "postgresql": 1, "psf": 1, "upl": 1,
    "wtfpl": 0, "cddl": 2, "eupl": 3, "odbl": 3, "osl": 3,
}
# An identifier that no table knows is its own label, and stricter than all.
UNKNOWN_STRICTNESS = 6
# Belief that a licence applies, by kind of finding.
WEIGHTS = {"tag": 0.95, "base": 0.9, "notice": 0.7}

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                    for c in range(256))
_TAG_AT = re.compile(r"(?i)spdx[\x00-/:-@\[-`{-\x7f]+license[\x00-/:-@\[-`{-\x7f]+identifier[ \t]*:?[ \t]*([A-Za-z0-9.+\-() \t]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+\-]*")


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
    lower-cased, as UTF-8."""
    return text.encode("utf-8").translate(_WORD_BYTES).split()


class WordAutomaton:
    """Aho-Corasick automaton whose letters are words."""

    def __init__(self, phrases: dict[tuple[bytes, ...], object]):
        self.goto: list[dict[bytes, int]] = [{}]
        self.out: list[list[tuple[int, object]]] = [[]]
        for words, label in phrases.items():
            at = 0
            for w in words:
                if w not in self.goto[at]:
                    self.goto[at][w] = len(self.goto)
                    self.goto.append({})
                    self.out.append([])
                at = self.goto[at][w]
            self.out[at].append((len(words), label))
        self.fail = [0] * len(self.goto)
        queue = deque(self.goto[0].values())
        while queue:
            s = queue.popleft()
            for w, t in self.goto[s].items():
                queue.append(t)
                f = self.fail[s]
                while f and w not in self.goto[f]:
                    f = self.fail[f]
                self.fail[t] = self.goto[f].get(w, 0)
                self.out[t] = self.out[t] + self.out[self.fail[t]]
        self.vocabulary = {w for g in self.goto for w in g}

    def scan(self, words: list[bytes]):
        """(start word, label) of every place of every phrase."""
        known, state, last = self.vocabulary, 0, -2
        for i in [i for i, w in enumerate(words) if w in known]:
            if i != last + 1:
                state = 0
            last, w = i, words[i]
            while state and w not in self.goto[state]:
                state = self.fail[state]
            state = self.goto[state].get(w, 0)
            for length, label in self.out[state]:
                yield i - length + 1, label


def parse_expression(text: str) -> list[str] | None:
    """Postfix order of a licence expression by the shunting-yard method:
    WITH binds tighter than AND, AND tighter than OR; None if it is not one."""
    rank = {"or": 1, "and": 2, "with": 3}
    out: list[str] = []
    ops: list[str] = []
    operand = True  # whether an operand must come next
    for tok in _TOKEN.findall(text):
        low = tok.lower()
        if low == "(":
            if not operand:
                break
            ops.append(low)
        elif low == ")":
            if operand or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif low in rank:
            if operand:
                return None
            while ops and ops[-1] != "(" and rank[ops[-1]] >= rank[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif operand:
            out.append(low)
            operand = False
        else:  # prose after the expression
            break
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate_expression(text: str) -> tuple[frozenset[str], int] | None:
    """(labels to comply with, strictness): AND needs both sides, OR lets the
    taker choose the less strict side, WITH keeps its licence (an exception
    only grants more). An identifier that is not known stays, as its own label
    and stricter than all others. None for a malformed expression."""
    post = parse_expression(text)
    if post is None:
        return None
    stack: list[tuple[frozenset[str], int]] = []
    for tok in post:
        if tok in ("and", "or", "with"):
            b, a = stack.pop(), stack.pop()
            if tok == "with":
                stack.append(a)
            elif tok == "and":
                stack.append((a[0] | b[0], max(a[1], b[1])))
            else:
                stack.append(min(a, b, key=lambda x: (x[1], sorted(x[0]))))
        else:
            name = re.sub(r"(-only|-or-later|\+)$", "", tok)
            label = IDENTIFIERS.get(name, tok)
            stack.append((frozenset([label]), STRICTNESS.get(label, UNKNOWN_STRICTNESS)))
    return stack[0]


def _automaton() -> WordAutomaton:
    phrases: dict[tuple[bytes, ...], object] = {tuple(TAG.encode().split()): ("tag", TAG_LABEL)}
    phrases |= {tuple(p.encode().split()): ("notice", label) for p, label in NOTICE_PHRASES.items()}
    phrases |= {tuple(p.encode().split()): ("base", label) for p, label in BASE_PHRASES.items()}
    return WordAutomaton(phrases)


SCAN_FIELDS = [StructField("n_words", LongType()), StructField("n_base", LongType()),
               StructField("first_word", LongType()), StructField("last_word", LongType()),
               StructField("base_labels", StringType()), StructField("labels", StringType()),
               StructField("score", DoubleType()), StructField("expressions", StringType()),
               StructField("strictness", LongType()), StructField("spans", StringType())]


def scan_text(text: str, automaton: WordAutomaton) -> tuple:
    words = words_of(text)
    starts, base, labels, spans, doubt, tagged = [], set(), set(), [], 1.0, False
    for start, (kind, label) in automaton.scan(words):
        spans.append(f"{start}:{kind if kind == 'tag' else label}")
        if kind == "tag":
            tagged = True
            continue
        if kind == "base":
            starts.append(start)
            base.add(label)
        labels.add(label)
        doubt *= 1 - WEIGHTS[kind]
    strict = max((STRICTNESS[x] for x in labels), default=None)  # notices name known labels only
    expressions = []
    if tagged:
        for m in _TAG_AT.finditer(text):
            if (found := evaluate_expression(m[1])) is not None:
                expressions.append(" ".join(parse_expression(m[1])))
                labels |= found[0]
                strict = max(found[1], strict or 0)
                doubt *= 1 - WEIGHTS["tag"]
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - doubt,
            ";".join(expressions), strict, ",".join(spans))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan every whole text. Returns ``doc_id``, ``n_words``, ``n_base``
    (places of base phrases), ``first_word`` and ``last_word`` (their smallest
    and largest start word, null if none), ``base_labels`` and ``labels``
    (distinct, sorted, comma-joined), ``score`` (belief that any licence
    applies, 0 to 1), ``expressions`` (postfix form of valid tags),
    ``strictness`` (of the strictest finding, null if none) and ``spans``
    (start word and label of every place).

    A null or empty text has no words and no labels. Repeated rows give
    repeated results; other columns are not read. One pass, no shuffle.
    """
    fields = [StructField("doc_id", docs.schema[id_col].dataType), *SCAN_FIELDS]
    arrow = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches):
        automaton = _automaton()
        for batch in batches:
            rows = [scan_text(t.as_py(), automaton) for t in batch.column("text")]
            cols = list(zip(*rows)) if rows else [[] for _ in SCAN_FIELDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, arrow[f.dataType.simpleString()]) for c, f in zip(cols, SCAN_FIELDS))],
                names=[f.name for f in fields])

    return map_batches(id_text(docs, id_col, text_col), run, StructType(fields))
