"""Decontamination against a plain scan, with the broadcast set and with windows joined by shuffle."""

import hashlib
import pickle
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from eventlens.llm import decontaminate
from tests.llm.helpers import by_id, documents, empty, prose

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    grams = {}
    for i, t in items:
        w = split(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[a:a + k]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, own = split(t), set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                if (g := tuple(w[a:a + k])) in grams:
                    hit.update(range(a, a + k))
                    own |= grams[g]
        own = sorted(str(x) for x in own if x is not None)
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def data():
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randrange(1, 40), 300)) for i in range(30)] + [(30, None), (31, "?! "), (None, "null item of more than ten words here to be found somewhere"), (3, "solo")]
    items.append((32, items[0][1]))
    docs = [(i, prose(rng, rng.randrange(0, 200), 300)) for i in range(100)]
    for i in range(40):
        t = items[rng.randrange(30)][1].split()
        docs.append((100 + i, prose(rng, 20, 300) + ". " + "-".join(t).upper() + ", é " + prose(rng, 20, 300)))
    docs += [(200, None), (201, ""), (202, "Solo"), (202, "Solo"), (203, "x " + items[-3][1]), (None, "SOLO solo sólo"), (204, prose(rng, 40_000, 300))]
    return docs, items


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 1500])
def test_scan_matches_a_plain_scan(spark, most):
    docs, items = data()
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.scan(documents(spark, docs), b, broadcast_bytes=most)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in out.collect()), key=repr)
    assert got == brute(docs, items)


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 1500])
def test_remove(spark, most):
    docs, items = data()
    b = spark.createDataFrame(items, "item_id long, text string")
    d = documents(spark, docs)
    clean = [r[0] for r in brute(docs, items) if not r[5]]
    kept = decontaminate.remove(d, b, broadcast_bytes=most)
    assert kept.columns == d.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(clean, key=repr)
    cut = decontaminate.remove(d, b, spans=True, broadcast_bytes=most)
    left = {(r[0], r[1] - r[2]) for r in brute(docs, items)}
    assert {(r.doc_id, len(split(r.text))) for r in cut.collect()} == left
    assert cut.where("doc_id = 200").first().text is None


def test_empty_tables(spark):
    docs, items = data()
    b = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.scan(empty(spark), b).count() == 0
    assert decontaminate.scan(documents(spark, docs), b.where("false")).where("n_hit > 0").count() == 0
    assert by_id(decontaminate.scan(documents(spark, docs[:1]), b.where("false")), "items", "spans") == [([], [])]


def test_the_set_is_small_and_a_larger_benchmark_is_not_collected(spark):
    docs, items = data()
    b = spark.createDataFrame(items, "item_id long, text string")
    many = decontaminate.Grams([str(i) for i, _ in items], [t for _, t in items], 10)
    rng = random.Random(1)
    big = decontaminate.Grams([str(i) for i in range(400)], [prose(rng, 300) for _ in range(400)], 10)
    text = sum(len(big.words.low[a:z]) for a, z in zip(big.words.at, big.words.at[1:]))
    assert len(pickle.dumps(big)) < 14 * text and set(many.by_length) >= {1, 10}
    plan = lambda most: decontaminate.scan(documents(spark, docs), b, broadcast_bytes=most)._jdf.queryExecution().executedPlan().toString()
    assert plan(1 << 20).count("MapInArrow") == 1 and "Join" not in plan(1 << 20)
    assert "MapInArrow" not in plan(1500) and "Join" in plan(1500)  # hits are a written table


def test_equal_hashes_of_different_words_stay_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "windows", lambda h, k: np.zeros(max(len(h) - k + 1, 0), np.uint64))
    grams = decontaminate.Grams(["1", "2", None, "1", "3"], ["a b", "b c", "a b", "a b", "x"], 2)
    w = decontaminate.Words(pa.array(["a b c", "b c", "c a", "x a b"]), decontaminate.ALNUM)
    assert sorted(grams.hits(w)) == [(0, 2, ["1"]), (1, 2, ["2"]), (3, 2, ["2"]), (7, 1, ["3"]), (8, 2, ["1"])]
