"""Part codebooks against plain Python with unbounded whole numbers."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from eventlens.llm import vector_codes as V

from .helpers import CLASHES

SCHEMA = "vec_id long, embedding array<float>, label int" + "".join(f", `{c}` string" for c in (*CLASHES, "pos", "entry", "salt", "part", "_v"))


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * (len(CLASHES) + 5)) for r in rows], SCHEMA)


def brute(rows, parts, entries, rounds, scale=256):
    """[(vec_id, code list, error, label error)], codebooks, by the definition."""
    kept = [(i, [math.floor(scale * x) for x in v], g) for i, v, g in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    if not kept:
        return [], []
    w = len(kept[0][1]) // parts
    books = [[r[1][p * w:(p + 1) * w] for r in kept[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((dist(r[1][p * w:(p + 1) * w], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for r in kept]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [r[1][p * w:(p + 1) * w] for r, a in zip(kept, found) if a[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found, by = assign(), {}
    out = [(r[0], r[2], [e for _, e in a], sum(d for d, _ in a)) for r, a in zip(kept, found)]
    for _, g, _, e in out:
        by[g] = by.get(g, 0) + e
    return [(i, c, e, by[g]) for i, g, c, e in out], books


def result(df, parts, entries, rounds):
    codes, books = V.compress(df, parts=parts, entries=entries, rounds=rounds)
    rows = [(r["id"], r["label"], r["codes"], r["error"]) for r in codes.collect()]
    by = {}
    for _, g, _, e in rows:
        by[g] = by.get(g, 0) + (e or 0)
    return sorted([(i, c, e, by[g]) for i, g, c, e in rows], key=repr), books


def noise(rng, n, size):
    return [rng.choice([rng.uniform(-1, 1), 0.25, -1 / 256, 0.0]) for _ in range(size)]


def test_matches_brute_force_with_ties_copies_and_a_hot_vector(spark):
    rng = random.Random(3)
    hot = noise(rng, 1, 12)
    rows = [(i if i % 11 else i - 1, hot if i % 3 == 0 else noise(rng, 1, 12), rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(900, None, 1), (901, [0.1] * 11 + [float("nan")], 1), (902, [0.1] * 11 + [float("inf")], 1), (903, [None] + [0.5] * 11, 2)]
    rows += [(None, noise(rng, 1, 12), None)] * 2
    for parts, entries, rounds in ((4, 9, 2), (3, 5, 3), (12, 2, 0), (4, 200, 1)):
        want, books = brute(rows, parts, entries, rounds)
        got, found = result(frame(spark, rows), parts, entries, rounds)
        assert got == sorted(want, key=repr)
        assert found.tolist() == books


def test_other_lengths_stay_and_empty_tables(spark):
    df = frame(spark, [(1, [0.5] * 4, 1), (2, [0.1] * 6, 1), (3, [], 1), (4, [0.25] * 4, 1), (0, [0.2] * 3, None)])
    got, _ = result(df, 2, 8, 2)
    assert [(i, c, e) for i, c, e, _ in got] == [(0, None, None), (1, [0, 0], 0), (2, None, None), (3, None, None), (4, [1, 1], 0)]
    codes, books = V.compress(df.where("false"))
    assert codes.count() == 0 and books is None


def test_nearest_is_exact_for_large_numbers():
    rng = np.random.default_rng(1)
    for most in (200, V.LIMIT):
        x, book = rng.integers(-most, most, (300, 8)), rng.integers(-most, most, (20, 8))
        entry, error = V.nearest(x, book)
        all_ = np.array([[int(((a - b) ** 2).sum()) for b in book] for a in x])
        assert (entry == all_.argmin(axis=1)).all() and (error == all_.min(axis=1)).all()


def test_huge_components_are_held_at_the_limit(spark):
    codes, books = V.compress(frame(spark, [(1, [3e38, -3e38], 1), (2, [0.0, 0.0], 1)]), parts=2, entries=1, rounds=0)
    assert books.tolist() == [[[V.LIMIT]], [[-V.LIMIT]]] and [r["error"] for r in codes.orderBy("id").collect()] == [0, 2 * V.LIMIT ** 2]


def test_members_stay_with_their_owner(spark):
    """Only moved parts meet an exchange, and the owners' sums need none before one row per salt is left."""
    m = V.Members(spark)
    rows = [(i, i % 2, i % 3, 0, [i, -i]) for i in range(60)]
    first = m.keep(m.place(spark.createDataFrame(rows, "row long, pos int, entry int, salt int, part array<int>")))

    def near(pos, part):
        return F.struct(F.pmod(F.get(part, F.lit(0)), F.lit(2)).alias("entry"))

    both = V.moved(first, near, m.place)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") == 2
    second = m.keep(both)
    sums = second.groupBy("pos", "entry", "salt").count()
    assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["pos"], r["entry"], r["count"]) for r in sums.collect()) == [(0, 0, 30), (1, 1, 30)]
    m.close()


def test_decoded_vectors_are_near(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], 1) for i in range(120)]
    codes, books = V.compress(frame(spark, rows), parts=8, entries=32, rounds=3)
    got = {r["id"]: r["vector"] for r in V.decode(codes, books).collect()}
    miss = [abs(a - b) for i, v, _ in rows for a, b in zip(v, got[i])]
    assert sum(miss) / len(miss) < 0.05


def test_query_digest(spark, tmp_path):
    rows = [(i, [((i * 37 + j * 11) % 101) / 50 - 1 for j in range(32)], i % 3) for i in range(100)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in V.op12_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error").collect())
    want, books = brute(rows, 16, 64, 2)
    assert got == sorted((i, "".join(f"{c:02x}" for c in code), e, le) for i, code, e, le in want)
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in V.op12_vector_codes(spark, str(tmp_path)).collect()} == {digest}
