"""Importance resampling against plain Python: feature texts, zlib and a sort."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventlens.llm import resample as R
from eventlens.llm.textops import ALNUM, Words

from . import helpers as H

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=5, min_words=20, buckets=10_000, seed=42):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in grams(text)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in grams(text)[1]:
            t[bucket(f)] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s, t)]
    rows, enough = [], []
    for n, (i, text) in enumerate(docs):
        words, found = grams(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if words >= min_words:
            enough.append(n)
    enough.sort(key=lambda n: (-rows[n][3], rows[n][0] is None, rows[n][0] or 0))
    for rank, n in enumerate(enough[:percent * len(enough) // 100], 1):
        rows[n][4] = rank
    return sorted(map(tuple, rows), key=repr)


def corpus(rng):
    odd = ["", None, "...", "one", "Two words", "ÄÖ ü naïve ÉCOLE 中文字 " * 9, "x" * 70 + " " + "y" * 5000 + " a " + "é" * 64, "A b\x00c\x7fd-e_f 1e9",
           "seventeen" * 2 + " " + "sixteen_" * 2, "𝔘 😀 " * 25, "a " * 400]
    docs = [(i, " ".join(rng.choice(["the", "of", "and", "model", "Ünder"] + [f"w{rng.randrange(300)}"] * 3) for _ in range(rng.randrange(60)))) for i in range(150)]
    target = [" ".join(f"w{rng.randrange(40)}" for _ in range(50)) for _ in range(5)] + [None, ""]
    return docs + [(1000 + i, t) for i, t in enumerate(odd)] + docs[:8] + [(None, docs[3][1])] * 3, target


def run(spark, docs, target, **kw):
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    return H.by_id(R.draw(H.documents(spark, docs), t, **kw), "doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("sizes", [{}, {"words": 40, "pairs": 25, "share": 300}, {"words": 0, "pairs": 0}])
def test_matches_brute_force_whatever_the_vocabulary(spark, sizes):
    docs, target = corpus(random.Random(2))
    want = brute(docs, target, percent=30, buckets=997)
    assert run(spark, docs, target, percent=30, buckets=997, **sizes) == want
    assert sum(r[4] is not None for r in want) > 20


def test_crc_of_runs_from_states():
    rng = np.random.default_rng(4)
    texts = ["a bb ccc " + "d" * 63 + " " + "e" * 64 + " f " + "g" * 65 + " " + "h" * 100_000 + " i j", "", "one", "two words"]
    texts += [" ".join("".join(chr(rng.integers(97, 100)) for _ in range(rng.integers(1, 20))) for _ in range(200)) for _ in range(5)]
    w = Words(pa.array(texts, pa.string()), ALNUM)
    for head in (R.Head([], []), R.Head([b"a", b"bb", b"one", b"ab", b"c"], [b"a bb", b"ab c", b"zz a"])):
        for block in (1 << 18, 3):
            R._BLOCK, old = block, R._BLOCK
            try:
                got = {}
                for text, runs in R.features(w, head, 1 << 30):
                    for bucket, there in runs:
                        for t, b in zip(text[there].tolist(), bucket[there].tolist()):
                            got.setdefault(t, []).append(b)
            finally:
                R._BLOCK = old
            for i, t in enumerate(texts):
                assert sorted(got.get(i, [])) == sorted(zlib.crc32(f.encode()) % (1 << 30) for f in grams(t)[1])


def test_head_holds_what_is_frequent(spark):
    docs = [(i, "common pair here " * 20 + " ".join(f"r{i}x{j}" for j in range(50))) for i in range(30)]
    h = R.head(H.documents(spark, docs), words=3, pairs=2, share=100)
    assert set(h.word_crc.tolist()) == {zlib.crc32(x) for x in (b"common", b"pair", b"here")}
    assert set(h.pair_crc.tolist()) == {zlib.crc32(x) for x in (b"common pair", b"pair here")}


def test_documents_like_the_target_are_drawn(spark):
    rng = random.Random(9)
    docs = [(i, H.prose(rng, 60)) for i in range(190)] + [(500 + i, " ".join(f"t{rng.randrange(30)}" for _ in range(60))) for i in range(10)]
    target = [" ".join(f"t{rng.randrange(30)}" for _ in range(300)) for _ in range(10)]
    drawn = [r[0] for r in run(spark, docs, target) if r[4] is not None]
    assert len(drawn) == 10 and min(drawn) >= 500


def test_sample_returns_whole_rows(spark):
    docs, target = corpus(random.Random(6))
    docs = docs[:150]
    t = spark.createDataFrame([(x,) for x in target], "text string")
    df = H.documents(spark, docs)
    want = sorted(r[0] for r in brute(docs, target, percent=20) if r[4] is not None)
    got = R.sample(df, t, percent=20)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == want
    assert R.sample(df, t, percent=0).count() == 0


def test_empty_tables(spark):
    t = spark.createDataFrame([("a b c",)], "text string")
    assert R.draw(H.empty(spark), t).count() == 0
    assert run(spark, [(1, "x " * 30)], []) == brute([(1, "x " * 30)], [])
    assert R.draw(H.documents(spark, [(1, None)]).withColumn("doc_id", F.lit(None).cast("long")), t).first()["rank"] is None
