"""Fixtures of the operators' tests: rows that hurt, and other columns whose names clash with theirs."""

from __future__ import annotations

import random
import re

CLASHES = ("_id", "_text", "_key", "_row", "size", "start", "n_words", "shard", "lid", "host", "comp", "_part", "items", "kept", "failed", "_c0", "_c1", "_at")


def documents(spark, rows, clash=True):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if clash:
        rows = [(*r, *[f"x{i}" for i in range(len(CLASHES))]) for r in rows]
        schema += "".join(f", {c} string" for c in CLASHES)
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return documents(spark, [(0, "a")]).where("false")


def prose(rng: random.Random, words: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(words))


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
