"""Licence scans: held-out accuracy, planted notices, and prose left alone."""

import random
import textwrap

import pytest

from eventlens.llm import licence_scan as ls
from tests.llm.helpers import documents, empty, prose

NOTICES = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
           "This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "proprietary",
           "Copyright (c) 2019 A. Author. Licensed under the Apache License, Version 2.0 (the \"License\").": "apache-2.0",
           "Licensed under the GNU Lesser General Public License, version 2.1.": "lgpl", "Licensed under CC BY-SA 4.0.": "cc-by-sa"}
DECOYS = ["The public library is under new management.", "She reserved all the rights seats in version 3.", "A general licence to drive.", "software and the general public"]


def data():
    rng = random.Random(14)
    words = "the of and to a in is that for it was on are as with his they at be this have from or one had by word but not what all were we when your can said".split()
    line = lambda n: " ".join(rng.choice(words) if rng.random() < 0.4 else f"w{rng.randrange(3000)}" for _ in range(n))
    rows, want = [], {}
    for i in range(150):
        lines, own = [line(rng.randrange(3, 60)) for _ in range(rng.randrange(1, 5))], []
        if i % 5 == 0:
            n, f = rng.choice(list(NOTICES.items()))
            at = rng.randrange(len(lines) + 1)
            lines.insert(at, n)
            own = [(at, f)]
        if i % 7 == 0:
            lines.append(rng.choice(DECOYS))
        rows.append((i, "\n".join(lines)))
        want[i] = own
    return rows, want


@pytest.fixture(scope="module")
def trained(spark):
    rows, _ = data()
    return ls.Classifier(spark, ls.paragraphs(documents(spark, rows), "doc_id", "text"))


def test_notices_are_found_and_prose_is_not(spark):
    rows, want = data()
    long = prose(random.Random(1), 50_000) + "\nAll rights reserved.\n\nx"
    rows += [(200, None), (201, ""), (202, "\n \nAll rights reserved."), (202, "\n \nAll rights reserved."), (203, long), (None, "Released under the MIT License.")]
    want |= {200: [], 201: [], 202: [(2, "proprietary")], 203: [(1, "proprietary")], None: [(0, "mit")]}
    out = ls.scan(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    assert [(r.doc_id, [(f.no, f.family) for f in r.found]) for r in out if [(f.no, f.family) for f in r.found] != want[r.doc_id]] == []
    n = {r.doc_id: r.n_paragraphs for r in out}
    assert n[200] == n[201] == 0 and n[202] == 1 and n[203] == 3


def test_wrapped_notices_and_other_versions(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify")
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
           "conditions are met:")
    gpl = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
           "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
    rows, _ = data()
    wrap = lambda t, mark="": "\n".join(mark + x for x in textwrap.wrap(t, 70))
    new = {300: (wrap(mit), [(0, "mit")]), 301: ("Copyright 2001 A. Author\n\n" + wrap(bsd, " * ") + "\n\nend", [(2, "bsd")]), 302: ("w1 w2\n\n" + wrap(gpl, "# "), [(2, "gpl")]),
           303: ("Licensed under CC BY-SA 3.0.", [(0, "cc-by-sa")]), 304: ("Licensed under the Apache License, Version 1.1.", []),
           305: ("Released under the\nMIT License.", [(0, "mit")])}
    out = ls.scan(documents(spark, rows + [(k, t) for k, (t, _) in new.items()])).where("doc_id >= 300").collect()
    assert {r.doc_id: [(f.no, f.family) for f in r.found] for r in out} == {k: w for k, (_, w) in new.items()}


def test_held_out_accuracy(spark, trained):
    _, held = trained._rows([prose(random.Random(2), 30) for _ in range(200)], 8, seed=99)
    got = trained.judge(spark.createDataFrame(held, "label double, _line string"), known_only=False).select("label", "_family", "_best").collect()
    families = ls.FAMILIES
    known = [r for r in got if r.label]
    right = sum(r._best >= trained.threshold and r._family == families[int(r.label)] for r in known)
    assert right / len(known) > 0.85
    assert sum(r._best >= trained.threshold for r in got if not r.label) / sum(not r.label for r in got) < 0.02
    assert trained.threshold >= ls.LEAST_PROBABILITY


def test_empty_table(spark):
    assert ls.scan(empty(spark)).count() == 0


def test_each_line_meets_the_model_once(spark, trained):
    rows, _ = data()
    lines = ls.paragraphs(documents(spark, rows), "doc_id", "text")
    plan = trained.judge(lines)._jdf.queryExecution().optimizedPlan().toString()
    # tokenizer, 2-grams, counts, probabilities, vector to array
    assert plan.count("UDF") <= 6
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_match_plain_python(spark, trained):
    """The judgement of every line by hand: tokens, features, the model's softmax, threshold, 3-grams and versions."""
    import numpy as np
    import regex

    def tokens(line):
        line = regex.sub(r"\b[vV]?[0-9]+(?:\.[0-9]+)*\b", " 0 ", line)
        return [w for w in regex.split(r"[^\p{L}\p{N}]+", line.lower()) if w]

    def threes(w):
        return {" ".join(w[i:i + 3]) for i in range(len(w) - 2)} or {" ".join(w)}

    place = {g: i for i, g in enumerate(trained.features.vocabulary)}
    weights, start = trained.model.coefficientMatrix.toArray(), trained.model.interceptVector.toArray()

    def judged(line):
        w = tokens(line)
        x = np.zeros(len(place))
        for g in w + [" ".join(p) for p in zip(w, w[1:])]:
            if g in place:
                x[place[g]] = 1
        z = weights @ x + start
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        family = ls.FAMILIES[1 + int(p[1:].argmax())]
        if p[1:].max() < trained.threshold:
            return None
        share = max(len(threes(w) & set(t)) / len(t) for t in trained.templates[family])
        number = regex.search(r"-(\d+)\.0$", family)
        if share < trained.confirm or number and not regex.search(rf"(?<![0-9.]){number[1]}(?:\.0)?(?!\.?[0-9])", line):
            return None
        return family

    rows, _ = data()
    texts = sorted({x for _, t in rows for x in t.split("\n")} | {"Licensed under the Apache License, Version 1.1.", "", "Ünder the MIT license.", "all rights  RESERVED"})
    df = spark.createDataFrame(list(enumerate(texts)), "_id long, _line string")
    got = {r["_id"]: r["_family"] for r in trained.judge(df).collect()}
    assert {i: f for i, t in enumerate(texts) if (f := judged(t))} == got
    assert len(got) >= 8
    assert all(regex.search(ls._anchors(trained.confirm), texts[i]) for i in got)  # what the words of `_anchors` let through loses nothing
