"""Mixing: targets, draws, permutations and the words that are taken."""

import random
from collections import Counter

import numpy as np

from eventlens.llm import mixing
from tests.llm.helpers import documents, empty, prose, words


def test_targets_stop_and_reshare():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 450) == [200.0, 500 / 3, 250 / 3]
    t = mixing.targets([10, 1000, 1000, 0], [5, 2, 1, 5], 3015)
    assert t[0] == 20 and t[3] == 0 and t[1] == 2 * 1000 - 0 * t[2] or abs(sum(t) - 3015) < 1e-6
    assert mixing.targets([], [], 0) == []


def test_shard_counts_add_up_and_spread():
    draws = np.array([1000, 10, 0, 500])
    c = mixing.shard_counts(draws, 16, 5)
    assert c.sum(axis=0).tolist() == draws.tolist() and (c >= 0).all()
    size = c.sum(axis=1)
    assert size.max() - size.min() <= 16 and c[:, 0].std() > 0
    assert (c == mixing.shard_counts(draws, 16, 5)).all()


def test_permute_is_a_permutation_for_each_key():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        i = np.arange(n)
        a = mixing.permute(i, np.full(n, n), np.full(n, 9, np.uint64))
        assert sorted(a.tolist()) == list(range(n))
    b = mixing.permute(i, np.full(n, n), np.full(n, 10, np.uint64))
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(i, a)[0, 1]) < 0.1


def rows():
    rng = random.Random(4)
    out = [(i, prose(rng, rng.randrange(1, 400)), rng.choice(["a", "a", "a", "b", "é", None, "z"])) for i in range(300)]
    return out + [(301, None, "a"), (302, "", "b"), (303, " \t ", None), (5, out[5][1], out[5][2]), (5, out[5][1], out[5][2]), (None, prose(rng, 90), "b"),
                  (304, prose(rng, 9000), "z"), (305, None, "only")]


def brute(p, rows):
    """Words taken per (id, size): blocks of each source filled in id order, every draw adds its block's words."""
    drawn = Counter()
    for s, n in enumerate(p.draws.tolist()):
        size = -(-p.words[s] // p.block_words[s])
        for k in range(n):
            drawn[s, k // size, k % size] += 1
    blocks = Counter()
    for (s, turn, k), _ in drawn.items():
        size = -(-p.words[s] // p.block_words[s])
        key = mixing.mix(np.array([p.seed + s * 2**20 + turn], np.uint64))
        blocks[s, int(mixing.permute(np.array([k]), np.array([size]), key)[0])] += 1
    return blocks


def test_taken_matches_a_plain_fill(spark):
    d = documents(spark, rows())
    p, placed, mixed = mixing.mix_documents(d)
    blocks = brute(p, rows())
    want = Counter()
    for r in placed.collect():
        s = p.sources.index(r.source)
        for w in range(r.start, r.start + r["size"]):
            want[r._row] += blocks[s, w // p.block_words[s]]
    got = Counter()
    for r in mixed.collect():
        got[r._row] += r.to_word - r.from_word
    assert got == +want
    assert p.sources == ["a", "b", "only", "z", "é", None]


def test_contract(spark):
    out = mixing.taken(documents(spark, rows())).collect()
    size = Counter()
    for _, t, s in rows():
        size[s] += len(words(t))
    assert len(out) == len(rows())
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((i, len(words(t))) for i, t, _ in rows())
    due = {r.source_size: r.target for r in out}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))], 1.5 * sum(size.values()))
    assert sorted(due.items()) == sorted(zip([size[s] for s in order], want))
    got = Counter()
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        got[r.source_size] += r.taken
    for s, t in due.items():
        assert abs(got[s] - t) <= 2 * mixing.BLOCK_WORDS
    again = Counter(tuple(r) for r in mixing.taken(documents(spark, rows()).repartition(5)).collect())
    assert again == Counter(tuple(r) for r in out)


def test_small_sources_meet_their_targets(spark):
    """Sources of 1 to 100 words, and one of many: each is within two of its blocks (one word, for these) of its target."""
    rng = random.Random(9)
    small = [(i, prose(rng, n), f"s{n:03d}") for i, n in enumerate([1, 2, 3, 5, 18, 33, 63, 64, 65, 80, 100])]
    out = mixing.taken(documents(spark, small + [(1000 + i, prose(rng, 60), "z") for i in range(100)])).collect()
    got, due, size = Counter(), {}, {}
    for r in out:
        assert r.taken <= 2 * r["size"]
        got[r.source_size] += r.taken
        due[r.source_size] = r.target
    for s, t in due.items():
        assert abs(got[s] - t) <= (2 * mixing.BLOCK_WORDS if s > 1000 else 1)
    assert [mixing.block_length(w) for w in (0, 1, 65, 640, 4095, 4096, 10**9)] == [1, 1, 1, 10, 63, 64, 64]


def test_slots_of_a_shard_are_gapless_and_empty_input(spark):
    p, _, _ = mixing.mix_documents(documents(spark, rows()), shards=8)
    drawn = mixing.draw(spark, p).toPandas()
    for shard, g in drawn.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g))) and len(g) == p.counts[shard].sum()
    assert mixing.taken(empty(spark)).count() == 0
