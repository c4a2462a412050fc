"""N-gram Jaccard join against all pairs."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import common, ngram_join
from tests.llm.helpers import documents, empty, prose, words


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(t):
    w = words(lower(t))
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d, links[i]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def edit(rng, t, n):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def data(groups=12, hot=0):
    rng = random.Random(6)
    rows, line = [], "the same line in very many documents of this table"
    for g in range(groups):
        base = prose(rng, rng.choice([5, 12, 40, 150, 600]))
        rows.append(base)
        for _ in range(rng.randrange(0, 6)):
            rows.append(edit(rng, base, rng.randrange(0, 4)))
    rows += [line + "\n" + prose(rng, 30) for _ in range(30)]
    base = prose(rng, 200)
    rows += [edit(rng, base, rng.randrange(0, 5)) for _ in range(hot)]
    rows += [None, "", " \n", "one", "ONE", "two words", "two  words", "a b c", "A b\tc", prose(rng, 20_000)]
    rng.shuffle(rows)
    out = list(enumerate(rows))
    return out + [(3, rows[3]), (3, rows[4]), (None, rows[5]), (None, "only null")]


@pytest.mark.parametrize("hot,block", [(0, 256), (60, 16)])
def test_matches_all_pairs(spark, monkeypatch, hot, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = data(hot=hot)
    out = ngram_join.linked(documents(spark, rows))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out.collect()), key=repr) == brute(rows)


def test_components_without_link_counts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rows = data(hot=60)
    out = ngram_join.linked(documents(spark, rows), n_links=False)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted((r[:3] for r in brute(rows)), key=repr)


def test_copies_are_folded_before_the_shuffle(spark, monkeypatch):
    """3000 copies of a text and one near copy: one component, and no exchange after the window over shingles carries the copies."""
    docs = spark.createDataFrame([(i, "a b c d e f g h i j k l") for i in range(3000)] + [(5000, "a b c d e f g h i j k z")], "doc_id long, text string")
    classes = spark.createDataFrame([(sid, 0, 2, 2, 0, [1, 2]) for sid in [7] * 1000 + [8]], ngram_join._CLASSES).repartition(4)
    seen = []
    monkeypatch.setattr(ngram_join, "cut", lambda df: seen.append(df) or common.cut(df))
    assert {(r.node, r.root) for r in ngram_join._groups(classes).collect()} == {(7, 7), (8, 7)}
    assert seen[0].count() == 4 and "max(df" in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert {r.component_id for r in ngram_join.linked(docs, percent=80).collect()} == {0}


def test_two_blocks_probe_every_member_of_side_0():
    """Links across two blocks do not depend on the order of the members: the only side-0 member may come last."""
    toks = np.arange(100, dtype=np.uint64)
    other = np.arange(500, 600, dtype=np.uint64)
    members = [(1, 1, 2, toks), (2, 1, 1, toks[:95]), (3, 1, 1, other), (4, 0, 3, toks[1:])]
    edges, links = ngram_join._verify(members, 90)
    assert sorted(edges) == [(4, 1), (4, 2)] and sorted(links) == [(1, 3), (2, 3), (4, 3)]
    for order in ([3, 0, 1, 2], [0, 3, 1, 2], [0, 1, 3, 2]):
        e, n = ngram_join._verify([members[k] for k in order], 90)
        assert sorted(e) == sorted(edges) and sorted(n) == sorted(links)


def test_long_sets_take_little_memory():
    """Comparing two blocks of long sets takes under 40 bytes a shingle."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 62, 3000, np.uint64))
    members = [(i, i % 2, 1, np.sort(rng.choice(base, len(base) - i % 7, replace=False))) for i in range(300)]
    tracemalloc.start()
    edges, links = ngram_join._verify(members, 90)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(edges) == 299 and links == [(i, 150) for i in range(300)]
    assert peak < 40 * sum(len(x[3]) for x in members)


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    """A group of few but long sets is dealt into several blocks, with the same result."""
    base = list(range(1000))
    sets = [(sid, 1, 1, [x for x in base if x % 50 != sid]) for sid in range(12)]
    sets = spark.createDataFrame(sets, "sid long, comp long, copies long, toks array<long>")
    want = {(sid, 11) for sid in range(12)}
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 3000, raising=False)
    out = ngram_join._links(sets, 90)
    plan = out._jdf.queryExecution().analyzed().toString()
    got = out.where("b is null").groupBy("a").agg({"links": "sum"}).collect()
    assert {tuple(r) for r in got} == want and "3000" in plan


def test_sets_of_unlike_sizes_get_no_edge(spark):
    """A shared shingle joins sets whose sizes may link, or that others of sizes between them join: runs in order of size."""
    rng = random.Random(3)
    sizes, toks = {}, {}
    for t in range(60):
        for _ in range(rng.randrange(2, 9)):
            sid = len(sizes)
            sizes[sid], toks[sid] = rng.choice([rng.randrange(1, 12), rng.randrange(50, 400), rng.randrange(4000, 9000)]), t
    sizes |= {1000: 100, 1001: 125, 1002: 156, 1003: 196, 1004: 100, 1005: 126}
    toks |= {1000: 900, 1001: 900, 1002: 900, 1003: 900, 1004: 901, 1005: 901}  # 196 is over 1.25 times 156, 126 over 1.25 times 100
    rows = [(sid, 0, 2, 1, 0, [toks[sid]], n) for sid, n in sizes.items()]
    want = set()
    for t in set(toks.values()):
        run = []
        for sid in sorted((x for x in toks if toks[x] == t), key=lambda x: (sizes[x], x)) + [None]:
            if run and (sid is None or 80 * sizes[sid] > 100 * sizes[run[-1]]):
                want |= {(x, min(run)) for x in run if len(run) > 1}
                run = []
            run.append(sid)
    assert {(1000, 1000), (1001, 1000), (1002, 1000)} <= want and not any(x in (1003, 1004, 1005) for x, _ in want)
    got = ngram_join._groups(spark.createDataFrame(rows, ngram_join._SIZED), 80).collect()
    assert {(r.node, r.root) for r in got} == want and len(got) == len(want)


def grid():
    """A group of sets of many sizes, of which few pairs may link."""
    rng = random.Random(12)
    out = []
    for sid in range(60):
        start, n = rng.randrange(0, 4), int(20 * 1.08 ** sid)
        out.append((sid, 1, 1 + sid % 3, list(range(start, start + n))))
    return out


def grid_links(rows, percent=80):
    sets = {sid: set(t) for sid, _, _, t in rows}
    copies = {sid: c for sid, _, c, _ in rows}
    pairs = [(a, b) for a in sets for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return pairs, {a: sum(copies[b] for x, b in pairs if x == a) for a, _ in pairs}


def test_blocks_meet_only_where_sizes_link(spark, monkeypatch):
    """Every linked pair meets in one task; a set is not sent to the blocks of all other sizes of its group."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows = grid()
    sizes = spark.createDataFrame([(sid, comp, len(t)) for sid, comp, _, t in rows] + [(999, 2, 5)], "sid long, comp long, n long")
    tasks = [tuple(r) for r in ngram_join._tasks(sizes, 80).select("sid", "i", "j", "side").collect()]
    members = {}
    for sid, i, j, side in tasks:
        members.setdefault((i, j), []).append((sid, side))
    for a, b in grid_links(rows)[0]:
        met = [k for k, v in members.items() if {a, b} <= {x for x, _ in v} and (k[0] == k[1] or dict(v)[a] != dict(v)[b])]
        assert len(met) == 1
    assert len(tasks) == len(set(tasks)) and not any(sid == 999 for sid, *_ in tasks)
    assert len(tasks) < 60 * 15 / 2  # 15 blocks


@pytest.mark.parametrize("sent", [1 << 26, 4000])
def test_waves_find_the_same(spark, monkeypatch, sent):
    """What tasks are sent is bounded by wave, and all waves together find what one does; a set that comes twice counts once."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows, cuts = grid(), []
    monkeypatch.setattr(ngram_join, "cut", lambda df: cuts.append(df) or common.cut(df))
    sets = spark.createDataFrame(rows + rows[::7], "sid long, comp long, copies long, toks array<long>").repartition(3)
    pairs, links = grid_links(rows)
    found = ngram_join._links(sets, 80, sent=sent).collect()
    got = {}
    for r in found:
        if r.b is None:
            got[r.a] = got.get(r.a, 0) + r.links
    assert got == links and {(r.a, r.b) for r in found if r.b is not None} <= set(pairs)
    edges = spark.createDataFrame(pairs, "a long, b long")
    bare = ngram_join._links(sets, 80, False, sent).where("b is not null").select("a", "b")
    want = {(r.node, r.root) for r in common.components(edges).collect()}
    assert {(r.node, r.root) for r in common.components(bare).collect()} == want
    assert (len(cuts) > 6) == (sent == 4000)


def test_release_waits_until_frames_are_let_go(spark):
    """When the JVM's collector runs, it knows of all frames that Python let go."""
    for _ in range(20):
        spark.range(10).groupBy((F.col("id") % 3).alias("k")).count().collect()
    common.release(spark)
    assert not spark.sparkContext._gateway._gateway_client.finalizer_deque


@pytest.mark.parametrize("block", [2, 5])
def test_small_blocks_match_all_pairs(spark, monkeypatch, block):
    """Many tasks of two blocks, some of them with an empty block."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = data(groups=2, hot=24)
    out = ngram_join.linked(documents(spark, rows))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out.collect()), key=repr) == brute(rows)


def test_frequent_shingles_only_change_the_order(spark, monkeypatch):
    """With nearly all shingles treated as frequent, the result stays."""
    rows = data(groups=8, hot=30)
    monkeypatch.setattr(ngram_join, "_heavy_list", lambda folded, members: __import__("numpy").unique(
        __import__("numpy").concatenate(ngram_join.shingle_sets(__import__("pyarrow").array([t for _, t in rows]), 3))[::2]))
    out = ngram_join.linked(documents(spark, rows))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert ngram_join.linked(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + rng.randrange(1, 50)) for _ in range(60)] + [(200, 199), (300, 300), (199, 200)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {(i, root(i)) for a, b in edges if a != b for i in (a, b)}
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == want and len(got) == len(want)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shuffles_are_released_between_steps(spark, monkeypatch):
    """What the prefixes shuffled goes before the rounds, and what a round shuffled before the next one."""
    calls = []

    def noted(name, f):
        return lambda *a, **k: calls.append(name) or f(*a, **k)

    monkeypatch.setattr(common, "EDGES_RELEASED", 1, raising=False)
    monkeypatch.setattr(common, "release", noted("release", common.release))
    monkeypatch.setattr(common, "_settled", noted("settled", common._settled))
    monkeypatch.setattr(ngram_join, "release", noted("release first", common.release))
    classes = spark.createDataFrame([(sid, 0, 2, 2, 0, [sid, sid + 1]) for sid in range(1, 20)], ngram_join._CLASSES)
    assert {r.root for r in ngram_join._groups(classes).collect()} == {1}
    rounds = calls.count("settled")
    assert calls[0] == "release first" and rounds > 1
    assert calls.count("release") >= rounds


def test_one_document_of_each_group(spark):
    rows = [r for r in data(hot=20)]
    kept = ngram_join.first_of_group(documents(spark, rows))
    want = {}
    for (d, t), (_, n, c, _) in zip(sorted(rows, key=lambda r: repr(r[0])), sorted(brute(rows), key=lambda r: repr(r[0]))):
        pass
    sets = [(d, t, shingle_set(t)) for d, t in rows]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == documents(spark, rows).columns
    assert sorted(repr(d) for d, t, s in sets if not s) == sorted(repr(d) for d, t in got if not shingle_set(t))
    comps = {c for _, n, c, _ in brute(rows) if n and c is not None}
    named = [d for d, t in got if shingle_set(t) and d is not None]
    assert comps <= set(named)
    assert len([1 for d, t in got if shingle_set(t)]) == len({(c if c is not None else "null") for _, n, c, _ in brute(rows) if n}) + \
        (len(named) - len(set(named)))
    del want
