"""URL filters against rule-by-rule brute force."""

import random

from pyspark.sql import functions as F

from eventlens.llm import url_filter as U

from .helpers import CLASHES


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def brute(url, rules, default="allow"):
    host, path = split(url)
    fits = [(len(h) + len(p), len(h), v == "block", h + p) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], default if best is None else ("block" if best[2] else "allow")


def pages(spark, urls):
    rows = [(i, u, *["x"] * len(CLASHES), "y") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string" + "".join(f", `{c}` string" for c in (*CLASHES, "won")))


def judged(df):
    return sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect())


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/1", "http://www.example.org/en/17", "http://www.example.org/en/2",
        "http://notexample.org/es/", "https://a.com/fr/x?y#z", "https://A.com/de/", "https://com/de/1", "http://org", "http://org/", "http://x.org?/es/",
        "http://example.org:80/es/", "http://example.org./es/", "ftp://u@b.com/FR/", "x://y://example.org/es/", "http://é.example.org/es/é",
        "http://com", "http://.com/de/", "http://a..org/", "http://example.org/es", "HTTP://EXAMPLE.ORG/es/#q", "http://example.org/es/1", "http://b.com/de/\nx",
        "http://" + "a." * 3000 + "org/" + "z" * 20000, "http://" + "b" * 50000]


def test_registered_rules(spark):
    got = judged(U.judge(pages(spark, URLS), U.rules_frame(spark)))
    assert got == sorted((i, *brute(u, U.RULES)) for i, u in enumerate(URLS))


def test_many_rules_by_broadcast_and_by_shuffle(spark):
    rng = random.Random(5)
    host = lambda: ".".join(rng.choice(["a", "b", "cc", "d"]) for _ in range(rng.randrange(1, 4)))
    path = lambda: rng.choice(["", "/", "/a", "/a/", "/ab", "/b/c"])
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), path()) for _ in range(60))}.values())
    rules += [("block", "q.a", "/"), ("allow", "q.a", "/"), ("block", None, None)]
    urls = [f"http://{host()}{path()}{rng.choice(['', '?a=/b', '#/a'])}" for _ in range(300)] + ["http://a/ab"] * 200 + URLS
    plain = [(v, h or "", p or "") for v, h, p in rules]
    want = sorted((i, *brute(u, plain, "block")) for i, u in enumerate(urls))
    r = U.rules_frame(spark, rules)
    assert judged(U.judge(pages(spark, urls), r, default="block")) == want
    assert judged(U.judge(pages(spark, urls), r, default="block", broadcast_bytes=0)) == want


def test_keep_returns_whole_rows(spark):
    p = pages(spark, URLS)
    want = sorted(i for i, u in enumerate(URLS) if brute(u, U.RULES)[3] == "allow")
    kept = U.keep(p, U.rules_frame(spark))
    assert kept.columns == p.columns and sorted(r["page_id"] for r in kept.collect()) == want
    strict = U.keep(p, U.rules_frame(spark), default="block")
    assert sorted(r["page_id"] for r in strict.collect()) == [i for i in want if brute(URLS[i], U.RULES)[2]]


def test_empty_tables_no_rules_and_repeated_rows(spark):
    p, r = pages(spark, URLS), U.rules_frame(spark)
    assert U.judge(p.where("false"), r).count() == 0
    assert {x["verdict"] for x in U.judge(p, U.rules_frame(spark, ())).collect()} == {"allow"}
    twice = p.union(p).withColumn("page_id", F.lit(None).cast("long"))
    assert U.judge(twice, r).count() == 2 * len(URLS)


def test_plan_is_native(spark):
    plan = U.judge(pages(spark, URLS), U.rules_frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
