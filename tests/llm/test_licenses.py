"""Operator 5 against a plain search, and its expression parser."""

import re

import pytest

from revsift.llm.licenses import (BASE_PHRASES, NOTICE_PHRASES, WordAutomaton, evaluate_expression,
                                  parse_expression, scan_licenses, words_of)
from revsift.llm.queries import op5_license_scan

from .conftest import MEDIUM, documents, rows_by


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_places(words, phrases):
    return [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]


def test_query_matches_a_plain_search(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = rows_by(op5_license_scan(spark, MEDIUM))
    assert len(got) == len(docs)
    found = 0
    for i, text in docs.items():
        words, r = plain_words(text), got[i]
        base = plain_places(words, BASE_PHRASES)
        extra = plain_places(words, NOTICE_PHRASES)
        found += len(base)
        assert (r["n_words"], r["n_base"]) == (len(words), len(base))
        assert r["first_word"] == min((s for s, _ in base), default=None)
        assert r["last_word"] == max((s for s, _ in base), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert set(filter(None, r["labels"].split(","))) >= {x for _, x in base + extra}
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert found > 5


def test_edges(spark):
    texts = [None, "", "Under THE mit-license under the MIT License", "under the mitt license", "apache license apache license version 2",
             "x" * 200_000 + " cc by nc", "under\nthe\x00MIT...license", "ünder the mit license",
             "// SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0\nrest"]
    got = rows_by(scan_licenses(documents(spark, texts).withColumnRenamed("lang", "labels").withColumnRenamed("source", "score")))
    assert [got[i]["n_base"] for i in range(9)] == [0, 0, 2, 0, 1, 1, 1, 0, 0]
    assert (got[2]["first_word"], got[2]["last_word"]) == (0, 4)
    assert got[4]["first_word"] == 2 and got[0]["n_words"] == 0 and got[0]["labels"] == "" and got[0]["strictness"] is None
    assert got[8]["labels"] == "apache-2,mit" and got[8]["expressions"] == "mit gpl-3.0-only or apache-2.0 and"
    assert scan_licenses(documents(spark, ["a"]).limit(0)).count() == 0
    assert len(scan_licenses(documents(spark, ["a", "a"], ids=[None, None])).collect()) == 2


def test_overlapping_and_nested_phrases():
    a = WordAutomaton({(b"a", b"b", b"a"): 1, (b"b", b"a"): 2, (b"a",): 3})
    assert sorted(a.scan(words_of("a b a b a x a"))) == sorted([(0, 1), (2, 1), (1, 2), (3, 2), (0, 3), (2, 3), (4, 3), (6, 3)])


@pytest.mark.parametrize("text,labels,strict", [
    ("MIT", {"mit"}, 1), ("MIT AND GPL-3.0-only", {"mit", "gpl-3"}, 3), ("MIT OR GPL-3.0-or-later", {"mit"}, 1),
    ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2"}, 3), ("MIT OR GPL-3.0-only AND CC-BY-NC-4.0", {"mit"}, 1),
    ("MIT OR LicenseRef-Foo", {"mit"}, 1), ("LicenseRef-Foo OR Apache-2.0", {"apache-2"}, 1), ("MIT AND LicenseRef-Foo", {"mit", "licenseref-foo"}, 6),
    ("MIT AND WTFPL", {"mit", "wtfpl"}, 1), ("Unknown-1.0", {"unknown-1.0"}, 6), ("Unknown-1.0 WITH x OR CC-BY-NC-ND-4.0", {"cc-by-nc-nd"}, 4),
    ("(MIT OR ISC) AND MPL-2.0", {"isc", "mpl-2"}, 2), ("MIT and apache-2.0 or gpl-2.0+", {"gpl-2"}, 3)])
def test_expressions(text, labels, strict):
    got = evaluate_expression(text)
    if text.startswith("MIT and apache"):
        labels, strict = {"mit", "apache-2"}, 1  # the less strict side
    assert got == (frozenset(labels), strict)


def test_bad_expressions():
    for t in ("", "AND MIT", "MIT AND", "(MIT", "MIT OR )"):
        assert parse_expression(t) is None
        assert evaluate_expression(t) is None


def test_every_label_has_a_strictness():
    from revsift.llm.licenses import IDENTIFIERS, STRICTNESS
    assert set(IDENTIFIERS.values()) | set(BASE_PHRASES.values()) | set(NOTICE_PHRASES.values()) <= set(STRICTNESS)
