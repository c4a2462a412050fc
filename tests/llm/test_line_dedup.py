"""Fuzzy line deduplication against all pairs of lines."""

import random

import pyarrow as pa

from eventlens.llm import line_dedup as ld
from tests.llm.helpers import documents, empty, prose, words


def shingle_set(x, k=ld.SHINGLE):
    return {x[i:i + k] for i in range(max(len(x) - k, 0) + 1)}


def brute(rows):
    """Components of equal or similar lines, and the lines that go: {(id, text): [numbers]}."""
    lines = sorted({x for _, t in rows for x in (t or "").split("\n") if words(x)})
    sets, parent = [shingle_set(x) for x in lines], list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    comp = {x: root(i) for i, x in enumerate(lines)}
    first = {}
    for d, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            if words(x):
                first.setdefault(comp[x], set()).add((d is not None, d or 0, n))
    return comp, {c: min(v) for c, v in first.items()}


def data():
    rng = random.Random(15)
    base = [prose(rng, rng.randrange(3, 40)) for _ in range(25)] + ["a", "é", "short", "same line everywhere, é"]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(0, 5)):
            x = rng.choice(base)
            if rng.random() < 0.4 and len(x) > 60:
                at = rng.randrange(len(x))
                x = x[:at] + rng.choice(["Z", "é", "QQ", ""]) + x[at + 1:]
            lines.append(x)
        if i % 3 == 0:
            lines += ["same line everywhere, é", " ", ""]
        lines.append(prose(rng, 12))
        rows.append((i, "\n".join(lines)))
    return rows + [(130, None), (131, ""), (132, prose(rng, 20_000)), (133, "\n\n"), (5, rows[5][1]), (None, "same line everywhere, é\n" + prose(rng, 5))]


def test_matches_all_pairs(spark):
    rows = data()
    comp, first = brute(rows)
    got = ld.decisions(documents(spark, rows)).collect()
    keep = {(r._id, r._no): r.keep for r in got}
    want = {(d, n): (d is not None, d or 0, n) == first[comp[x]] for d, t in rows for n, x in enumerate((t or "").split("\n")) if words(x)}
    wrong = [k for k in want if keep[k] != want[k]]
    assert set(keep) == set(want) and len(wrong) <= 0.01 * len(want)  # banding finds a pair at 0.8 with probability 0.995
    roots = {}
    for r in got:
        if r.keep:
            assert roots.setdefault(r.root, (r._id, r._no)) == (r._id, r._no)


def test_dedup_keeps_columns_and_other_lines(spark):
    rows = data()
    d = documents(spark, rows)
    comp, first = brute(rows)
    out = ld.dedup(d)
    assert out.columns == d.columns and out.count() == len(rows)
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[130] is None and text[131] == "" and text[133] == "\n\n" and text[132] == rows[122][1]
    kept = [x for t in {k: v for k, v in text.items()}.values() for x in (t or "").split("\n") if words(x)]
    assert abs(len(kept) - len(first)) <= 0.02 * len(first)
    assert sum(x == " " for t in text.values() for x in (t or "").split("\n")) == sum(x == " " for x in "\n".join({i: t or "" for i, t in rows}.values()).split("\n"))


def test_many_variants_of_one_line(spark):
    rng = random.Random(16)
    base = prose(rng, 60)
    rows = [(i, base[:k] + "#" + base[k + 1:]) for i, k in enumerate(rng.sample(range(len(base)), 150))]
    got = ld.decisions(documents(spark, rows)).collect()
    assert [r._id for r in got if r.keep] == [0] and len({r.root for r in got}) == 1


def test_large_buckets_of_unlike_lines_are_split(spark):
    """300 lines that share a long beginning, so that many meet in a bucket, against all pairs."""
    rng = random.Random(17)
    start = prose(rng, 14)
    rows = [(i, start + " " + prose(rng, 9)) for i in range(300)]
    rows += [(1000 + i, t[:-3] + "zz") for i, (_, t) in enumerate(rows[:40])]
    comp, _ = brute(rows)
    want = {}
    for d, t in rows:
        want.setdefault(comp[t], set()).add(d)
    for small in (16,):
        lines = ld.lines_of(documents(spark, rows), "doc_id", "text")
        root = {r.lid: r.root for r in ld.groups(lines, small=small).collect()}
        got = {}
        for r in lines.select("_id", "lid").collect():
            got.setdefault(root.get(r.lid, r.lid), set()).add(r._id)
        lost = sum(s not in list(got.values()) for s in want.values())
        assert lost <= 0.03 * len(want)


def test_recall_of_the_bands(spark):
    """Share of pairs of similarity 0.80 to 0.85 that meet in a bucket: measured on 600 pairs."""
    rng = random.Random(18)
    pairs = []
    while len(pairs) < 600:
        a = prose(rng, rng.randrange(8, 40))
        b = a
        for _ in range(1 + len(a) // 90):
            at = rng.randrange(len(b))
            b = b[:at] + "#" + b[at + 1:]
        x, y = shingle_set(a), shingle_set(b)
        if 0.80 <= len(x & y) / len(x | y) <= 0.85:
            pairs.append((a, b))
    rows = [(i, x) for i, x in enumerate(t for p in pairs for t in p)]
    lines = ld.lines_of(documents(spark, rows), "doc_id", "text")
    met = ld.buckets(ld.signatures(lines, ld.SHINGLE, ld.BANDS * ld.ROWS, ld.SEED), ld.BANDS, ld.ROWS)
    of = {r.lid: r._id // 2 for r in lines.collect()}
    found, by = set(), {}
    for r in met.collect():
        by.setdefault(r.bucket, []).append(of[r.lid])
    for ids in by.values():
        found |= {i for i in ids if ids.count(i) > 1}
    print("recall", len(found) / len(pairs))
    assert len(found) / len(pairs) >= 0.985


def test_shingle_hashes_and_similarity_against_plain_sets():
    """Characters of one to four bytes, lines shorter than a shingle, NUL characters."""
    rng = random.Random(19)
    lines = ["".join(rng.choice("abcé漢😀 x\0") for _ in range(rng.randrange(1, 40))) for _ in range(400)] + ["a", "abcdef", "abcdefg"]
    x, n = ld.shingle_hashes(pa.array(lines), ld.SHINGLE)
    of, at = {}, 0
    for line, k in zip(lines, n.tolist()):
        parts = [line[i:i + ld.SHINGLE] for i in range(max(len(line) - ld.SHINGLE, 0) + 1)]
        assert len(parts) == k
        for part, h in zip(parts, x[at:at + k].tolist()):
            assert of.setdefault(part, h) == h
        at += k
    assert at == len(x) and len(set(of.values())) == len(of)
    other = [line[:-1] + "q" if i % 2 else line for i, line in enumerate(lines)]
    want = [100 * len(a & b) >= 80 * len(a | b) for a, b in ((shingle_set(p), shingle_set(q)) for p, q in zip(lines, other))]
    assert ld.similar(pa.array(lines), pa.array(other), ld.SHINGLE, 80).tolist() == want and 0 < sum(want) < len(want)


def test_empty_table(spark):
    assert ld.removed(empty(spark)).count() == 0 and ld.dedup(empty(spark)).count() == 0


def variants(rng, n):
    """Lines of one family, some of them alike, some only to a few others, and lines of its own."""
    base = prose(rng, 25)
    out = {base}
    while len(out) < n:
        x = rng.choice(sorted(out)) if rng.random() < 0.3 else base
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(x))
            x = x[:at] + rng.choice(["#", "QQ", "é"]) + x[at + 1:]
        out.add(x if rng.random() < 0.9 else prose(rng, 12))
    return sorted(out)


def test_links_of_a_group_join_what_all_pairs_join():
    rng = random.Random(21)
    for n in (1, 2, 7, 60, 150):
        lines = variants(rng, n)
        comp, _ = brute([(0, "\n".join(lines))])
        links = ld.joined(pa.array(lines), ld.SHINGLE, 80)
        assert len(links) == n - len(set(comp.values()))  # a forest: no pair more than needed
        assert all(comp[lines[a]] == comp[lines[b]] for a, b in links)


def test_a_large_group_is_compared_in_blocks_without_a_row_for_each_pair(spark, monkeypatch):
    """One group of 300 lines in blocks of some 16 (long lines fill a block alone): as all pairs join them, but no row for each pair."""
    rng = random.Random(22)
    lines = variants(rng, 298) + [prose(rng, 500), prose(rng, 700)]
    comp, _ = brute([(0, "\n".join(lines))])
    texts = spark.createDataFrame(list(enumerate(lines)), "lid long, _line string")
    held = texts.selectExpr("0L as lead", "lid")
    monkeypatch.setattr(ld, "CHARS", 64)
    placed = ld._placed(held.join(texts.selectExpr("lid", "length(_line) as chars"), "lid"), 16).groupBy("i", "j").count().collect()
    assert max(r["count"] for r in placed) <= 2 * 16 and len(placed) > 100
    links = [tuple(r) for r in ld.links(held, texts, ld.SHINGLE, 80, 16).collect()]
    assert len(links) < len(lines) * len(lines) / 8
    root = list(range(len(lines)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert comp[lines[a]] == comp[lines[b]]
        root[top(a)] = top(b)
    assert len({top(i) for i in range(len(lines))}) == len(set(comp.values()))
