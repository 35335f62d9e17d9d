"""Small tables with the cases every operator has to define."""

from __future__ import annotations

import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark, texts, sources=None, extra=False):
    """Texts by doc_id; with ``extra``, columns named like those the operators make."""
    rows = [
        (i, t, "en", sources[i] if sources else "s", len(t) if t is not None else None) for i, t in enumerate(texts)
    ]
    docs = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("_text", "score", "ids", "size", "copies", "kept", "hi", "lo", "doc", "component", "key", "n", "x"):
            docs = docs.withColumn(name, docs["lang"])
    return docs


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
