"""The pipeline, stage by stage, against brute force on a small table."""

import random
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from eventlens.llm import mixing
from tests.llm.helpers import documents, prose, words
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_quality import brute as measures

VOCABULARY = "the and of to in that have with for it be is on as at by we or an".split()


def text(rng, n):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < 0.3 else f"w{rng.randrange(9000)}x" for _ in range(n))


def data():
    rng = random.Random(17)
    items = [(i, prose(rng, 20, 500)) for i in range(5)]
    rows = [(i, text(rng, rng.randrange(30, 400)), f"s{i % 5}") for i in range(120)]
    rows += [(200 + i, rows[i][1], f"s{i % 3}") for i in range(10)]                                          # copies
    rows += [(300 + i, rows[40 + i][1] + " end", "s1") for i in range(10)]                                   # near copies
    rows += [(400 + i, rows[60 + i][1] + " x " + items[i % 5][1] + " " + text(rng, 150), "s2") for i in range(8)]  # leaks
    rows += [(500, None, "s0"), (501, "", None), (502, " ".join(f"{w}###" for w in rows[0][1].split()), "s0"), (503, text(rng, 9000), None), (504, "a b c " * 90, "s4")]
    return rows, items


def fives(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    rows, items = data()
    at = tmp_path_factory.mktemp("sf")
    documents(spark, rows, clash=False).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), [None]
    out[0] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, str(at))
        if name != "sharding":
            assert df.columns == docs.columns
        df.write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out.append(docs.collect())
    return str(at), items, out


def test_quality_stage(steps):
    _, _, (before, after, *_) = steps
    kept = {r.doc_id for r in after}
    for r in before:
        n, _, symbols, _, repeated = measures(r.text)
        bad = n < 50 or 2 * repeated > n or 4 * symbols > n
        assert (r.doc_id in kept) != bad


def test_near_duplicate_stage(steps):
    _, _, (_, before, after, *_) = steps
    sets, root = {r.doc_id: fives(r.text) for r in before}, {r.doc_id: r.doc_id for r in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in after) == [i for i in ids if find(i) == i]
    assert len(after) < len(before) - 10


def test_decontamination_stage(steps):
    _, items, (_, _, before, after, *_) = steps
    want = [r[0] for r in contaminated([(r.doc_id, r.text) for r in before], items) if not r[5]]
    assert sorted(r.doc_id for r in after) == sorted(want) and len(after) < len(before)


def test_mixing_stage(steps):
    _, _, (_, _, _, before, after, _) = steps
    size, got = Counter(), Counter()
    text_of = {r.doc_id: r.text for r in before}
    for r in before:
        size[r.source] += len(words(r.text))
    for r in after:
        got[r.source] += len(words(r.text))
        assert r.n_chars == len(r.text)
        own = words(text_of[r.doc_id])
        assert not Counter(words(r.text)) - Counter(own)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    due = mixing.targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()))
    for s, t in zip(order, due):
        assert abs(got[s] - t) <= 2 * mixing.BLOCK_WORDS
    assert max(Counter(r.doc_id for r in after).values()) == 2
    assert any(r.text == text_of[r.doc_id] for r in after)


def test_sharding_stage(steps):
    _, _, (*_, before, after) = steps
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in after) == Counter((r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in before)
    slots = {}
    for r in after:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_equals_the_stages(spark, steps):
    at, _, out = steps
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, at).collect()) == Counter(tuple(r) for r in out[-1])


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert any(k.startswith(f"op{n}_") for k in names)
    assert names["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
