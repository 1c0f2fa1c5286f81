"""Awkward inputs and brute-force versions shared by the tests."""

from __future__ import annotations

import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, fp string, __row string, tie string"


def docs_of(spark, texts, ids=None):
    """A documents table with extra columns whose names clash with those the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", None if k % 5 == 4 else f"s{k % 3}", len(t or ""), k, "x", None, "y") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


SENTENCES = [
    "The quick brown fox jumps over the lazy dog near the old river bank at dawn.",
    "Une phrase écrite en français avec des accents éèêç pour voir les octets.",
    "Ein Satz über Größe und Maße, der länger ist als die meisten anderen Sätze.",
    "Numbers 1234 and symbols #$% appear in this line, which nobody reads twice.",
]

AWKWARD = [
    None,
    "",
    " \t\n",
    "a",
    SENTENCES[0],
    SENTENCES[0],
    SENTENCES[0] + " " + SENTENCES[1],
    SENTENCES[1] + " " + SENTENCES[2] + " " + SENTENCES[0],
    "x" * 3000,
    "word " * 5000,
    "日本語のテキスト 😀 " * 40,
    SENTENCES[3] * 3,
    "tab\tand no-break 　 wide lines\x00nul  double  spaces ",
]

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))
