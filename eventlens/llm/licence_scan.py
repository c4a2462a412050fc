"""Licence scans: a trained paragraph classifier with template comparison.

1. Training rows are the notice templates below, varied (holders and years
   added, words left out, other words around them), and as unknown class a
   bounded sample of paragraphs of the corpus: at most `negatives` distinct
   paragraphs chosen by hash, less those that resemble a template.
2. Features are the word 1- and 2-grams of the templates, as sparse binary
   counts; the model is a multinomial logistic regression (spark.ml).
3. The unknown class is calibrated on held-out rows: a family is predicted only
   at a probability above all but `false_rate` of the held-out unknown
   paragraphs, and not below `least_probability`.
4. A prediction stands if the paragraph holds `confirm` of the word 3-grams of
   a template of the family. Version numbers count as one word, but a family
   of one version needs that version.
5. Besides lines, runs of adjacent lines are judged, so that hard-wrapped
   notices are found; such a notice has the number of its first line.

Everything runs in the JVM (DataFrame functions and spark.ml); no Python user
function. Each paragraph is judged in its own row; only predicted paragraphs
and one row of counts per document are shuffled.

Defined cases: null and empty texts have no paragraphs; a paragraph is a line
with a word, numbered from 0 among all lines of the text; paragraphs of any
length are judged whole; rows that repeat exactly (id and text) have one result
row each, with the same result; an empty table gives an empty table (the
classifier is then trained on templates alone). Only id and text are read.
"""

from __future__ import annotations

import random
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, NGram, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, table

UNKNOWN = "unknown"
NEGATIVES = 2000
VARIANTS = 12
FALSE_RATE = 0.001
LEAST_PROBABILITY = 0.5
CONFIRM = 0.75
SEED = 7

# Public licence notices.
TEMPLATES = {
    "mit": ("Released under the MIT License.",
            "Licensed under the MIT License.",
            "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Released under the Apache License 2.0."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "Released under the GNU General Public License.",
            "Licensed under the GNU GPL version 2 or later."),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.",
             "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.",
             "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "bsd": ("Released under the BSD License.",
            "Licensed under the 3-clause BSD license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "Licensed under the Mozilla Public License, version 2.0."),
    "cc-by": ("Licensed under CC BY 4.0.",
              "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Released under CC0 1.0.",
            "This work is dedicated to the public domain under the Creative Commons Zero v1.0 Universal waiver."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "proprietary": ("All rights reserved.",
                    "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."),
}
FAMILIES = (UNKNOWN, *TEMPLATES)


def _tokens(df: DataFrame, text: str, out: str) -> DataFrame:
    """Words; version numbers and years count as one word, 0."""
    df = df.withColumn("_folded", F.regexp_replace(text, r"\b[vV]?[0-9]+(?:\.[0-9]+)*\b", " 0 "))
    return RegexTokenizer(inputCol="_folded", outputCol=out, pattern=r"[^\p{L}\p{N}]+", toLowercase=True).transform(df).drop("_folded")


def _grams(df: DataFrame) -> DataFrame:
    """Add `_w` (words) and `_g` (1- and 2-grams) of `_line`."""
    df = NGram(n=2, inputCol="_w", outputCol="_b").transform(_tokens(df, "_line", "_w"))
    return df.withColumn("_g", F.concat("_w", "_b")).drop("_b")


def _trigrams(words):
    """Distinct word 3-grams, of shorter runs the whole."""
    whole = F.array(F.array_join(words, " "))
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.array_join(F.slice(words, i + 1, 3), " "))
    return F.array_distinct(F.when(F.size(words) < 3, whole).otherwise(runs))


def _template_rows(spark) -> DataFrame:
    return spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, _line string")


def _alike(own, templates: dict[str, list[list[str]]]):
    """Map family -> largest share of a template's 3-grams among `own`, those of the paragraph."""
    share = lambda t: F.size(F.array_intersect(own, F.array(*[F.lit(x) for x in t]))) / F.lit(float(len(t)))
    return {f: F.greatest(*[share(t) for t in ts], F.lit(0.0)) for f, ts in templates.items()}


def once(df: DataFrame) -> DataFrame:
    """`df`, its columns computed where they are, once.

    Catalyst would push a later filter below the projection and spell out what
    it mentions there, the whole model for each mention; it moves no filter
    past a row number that the filter needs.
    """
    return df.withColumn("_at", F.monotonically_increasing_id()).where("_at >= 0").drop("_at")


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _key, _no, _line): the lines of the texts; lines without a word included."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.select("_id", F.xxhash64("_text").alias("_key"), F.posexplode(F.split("_text", "\n")).alias("_no", "_line"))


def _anchors(confirm: float = CONFIRM) -> str:
    """Regex that a text holding `confirm` of a template's 3-grams matches: words whose absence takes more than the rest of them."""
    out = set()
    for t in (t for ts in TEMPLATES.values() for t in ts):
        w = re.findall(r"[a-z0-9]+", re.sub(r"\bv?[0-9]+(?:\.[0-9]+)*\b", " 0 ", t.lower()))
        missing = set()
        for word in sorted({*w} - {"0"}, key=lambda x: (-len(x), x)):
            out.add(word)
            missing |= {k for k in range(max(1, len(w) - 2)) if word in w[k:k + 3]}
            if len(missing) > (1 - confirm) * max(1, len(w) - 2):
                break
    return r"(?i)\b(?:" + "|".join(sorted(out)) + r")\b"


def wrapped(docs: DataFrame, id_col: str, text_col: str, confirm: float = CONFIRM) -> DataFrame:
    """(_id, _key, _no, _last, _line, _rest): runs of adjacent lines, joined, from line _no to _last; _rest is the run without its first line.

    Of each line, the run of two lines and the run whose further lines hold as many words as the longest template.
    A line without a word ends a run. Only runs that can hold a notice are made.
    """
    most = max(len(t.split()) for ts in TEMPLATES.values() for t in ts) + 4
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).where(F.col("_text").rlike(_anchors(confirm)))
    rows = rows.select("_id", F.xxhash64("_text").alias("_key"), F.split("_text", "\n").alias("_lines"))
    rows = rows.select("_id", "_key", "_lines", F.posexplode("_lines").alias("_no", "_first")).where(F.col("_first").rlike(WORD))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("words"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def longer(a, line):
        go = a["open"] & (a["words"] < most) & line.rlike(WORD)
        return F.when(go, F.struct(F.concat_ws(" ", a["text"], line).alias("text"), (a["words"] + F.size(F.split(F.trim(line), r"\s+"))).alias("words"),
                                   (a["n"] + 1).alias("n"), F.lit(True).alias("open"))
                      ).otherwise(F.struct(a["text"].alias("text"), a["words"].alias("words"), a["n"].alias("n"), F.lit(False).alias("open")))

    two = F.aggregate(F.slice("_lines", F.col("_no") + 2, 1), start, longer)
    more = F.aggregate(F.slice("_lines", F.col("_no") + 2, most), start, longer)
    runs = rows.select("_id", "_key", "_no", "_first", F.explode_outer(F.array_distinct(F.array(two, more))).alias("_run")).where("_run.n > 0")
    return (runs.select("_id", "_key", "_no", (F.col("_no") + F.col("_run.n")).alias("_last"), F.concat_ws(" ", "_first", "_run.text").alias("_line"), F.col("_run.text").alias("_rest"))
            .where(F.col("_line").rlike(_anchors(confirm))))


class Classifier:
    """Features, model, threshold and templates of one training."""

    def __init__(self, spark, lines: DataFrame, negatives: int = NEGATIVES, variants: int = VARIANTS, false_rate: float = FALSE_RATE,
                 least_probability: float = LEAST_PROBABILITY, confirm: float = CONFIRM, seed: int = SEED):
        known = _grams(_template_rows(spark)).select("family", "_g", _trigrams(F.col("_w")).alias("t")).collect()  # the template table
        self.templates: dict[str, list[list[str]]] = {}
        for r in known:
            self.templates.setdefault(r["family"], []).append(r["t"])
        self.confirm = confirm
        vocabulary = sorted({g for r in known for g in r["_g"]})
        self.features = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_g", outputCol="_x")
        self.features.setBinary(True)
        # a share of the paragraphs' hash range that holds a few times `negatives`, then the smallest of them:
        # what is shuffled and sorted is bounded, whatever the number of paragraphs
        share = max(1, lines.count() // (4 * negatives))
        h = F.xxhash64("_line", F.lit(seed))
        sample = (lines.where(F.col("_line").rlike(WORD) & (F.pmod(F.xxhash64("_line"), F.lit(share)) == 0)).select("_line").distinct()
                  .orderBy(h, "_line").limit(negatives))  # bounded by `negatives`
        sample = once(once(_tokens(sample, "_line", "_w")).withColumn("_t", _trigrams(F.col("_w"))))
        shares = _alike(F.col("_t"), self.templates)
        others = [r["_line"] for r in sample.where(F.greatest(*shares.values()) < 0.3).select("_line").collect()]
        train, held = self._rows(others, variants, seed)
        lr = LogisticRegression(featuresCol="_x", labelCol="label", maxIter=60, regParam=1e-3, family="multinomial")
        rows = cut(self._featured(spark.createDataFrame(train, "label double, _line string")).select("label", "_x").coalesce(2))
        self.model = lr.fit(rows)
        self.model.setRawPredictionCol("").setPredictionCol("").setProbabilityCol("_p")
        scored = self.judge(spark.createDataFrame(held, "label double, _line string"), known_only=False)
        top = [r["_best"] for r in scored.where("label = 0").select("_best").collect()]  # at most half of `negatives`
        top.sort()
        self.threshold = max(least_probability, top[min(len(top) - 1, int(len(top) * (1 - false_rate)))] if top else 0.0)

    @staticmethod
    def _rows(others: list[str], variants: int, seed: int):
        rng = random.Random(seed)
        words = [w for line in others[:200] for w in line.split()] or ["text"]
        train, held = [], []
        for no, family in enumerate(FAMILIES[1:], 1):
            for t in TEMPLATES[family]:
                train.append((float(no), t))
                for k in range(variants):
                    w = t.split()
                    if k % 3 == 1 and len(w) > 6:
                        del w[rng.randrange(len(w))]
                    if k % 3 == 2:
                        w = ["Copyright", "(c)", str(rng.randrange(1990, 2030)), rng.choice(words), *w]
                    around = rng.randrange(0, 12)
                    w = [rng.choice(words) for _ in range(around)] + w + [rng.choice(words) for _ in range(rng.randrange(0, 6))]
                    (held if k % 4 == 3 else train).append((float(no), " ".join(w)))
        half = [(0.0, x) for x in others]
        return train + half[::2] + [(0.0, "text")], held + half[1::2]

    def _featured(self, rows: DataFrame) -> DataFrame:
        return self.features.transform(_grams(rows))

    def judge(self, rows: DataFrame, known_only: bool = True) -> DataFrame:
        """Add `_family` (the most probable known family), `_best` (its probability); with `known_only`, keep predictions that stand."""
        p = self.model.transform(self._featured(rows))
        known = F.slice(vector_to_array("_p"), 2, len(FAMILIES) - 1)
        p = once(p.select(*rows.columns, "_w", known.alias("_known")))
        p = p.withColumn("_best", F.array_max("_known"))
        families = F.array(*[F.lit(f) for f in FAMILIES[1:]])
        p = p.withColumn("_family", F.get(families, F.array_position("_known", F.col("_best")).cast("int") - 1))
        if not known_only:
            return p.drop("_known")
        p = self._compared(p.where(F.col("_best") >= self.threshold).drop("_known"), "_w", "_share")
        p = p.where(F.col("_share") >= self.confirm)
        for f in FAMILIES[1:]:  # numbers are folded: a family of one version needs that version
            if m := re.search(r"-(\d+)\.0$", f):
                p = p.where((F.col("_family") != f) | F.col("_line").rlike(rf"(?<![0-9.]){m[1]}(?:\.0)?(?!\.?[0-9])"))
        if "_rest" in rows.columns:  # a notice begins in the first line of its run
            p = _tokens(once(p), "_rest", "_v")
            p = self._compared(once(p), "_v", "_less").where("_less < _share").drop("_v", "_less")
        return p.drop("_w", "_share")

    def _compared(self, p: DataFrame, words: str, out: str) -> DataFrame:
        """Add `out`: the share of the 3-grams of a template of the row's own family; those of other families are not looked at."""
        p = once(p.withColumn("_t", _trigrams(F.col(words))))
        shares = _alike(F.col("_t"), self.templates)
        return once(p.withColumn(out, F.coalesce(*[F.when(F.col("_family") == f, s) for f, s in shares.items()])).drop("_t"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """Per document: id, n_paragraphs, found: array<struct<no, family>> of the paragraphs with a known licence."""
    spark = docs.sparkSession
    lines = paragraphs(docs, id_col, text_col)
    classifier = Classifier(spark, lines, **training)
    columns = ["_id", "_key", "_no", "_last", "_family"]
    # a line without a word of `_anchors` cannot hold CONFIRM of a template, so the model need not see it
    judged = (classifier.judge(lines.where(F.col("_line").rlike(_anchors(classifier.confirm)))).withColumn("_last", F.col("_no")).select(*columns)
              .unionByName(classifier.judge(wrapped(docs, id_col, text_col, classifier.confirm)).select(*columns)))
    every = F.collect_set(F.struct(F.col("_no").alias("no"), F.col("_last").alias("last"), F.col("_family").alias("family")))
    # a run gives way to a line of its family in it, and to a run of its family that begins a line earlier
    before = lambda x: F.exists("all", lambda y: (y["family"] == x["family"]) & (
        ((y["no"] == y["last"]) & y["no"].between(x["no"], x["last"])) | ((y["no"] < y["last"]) & (y["no"] == x["no"] - 1))))
    kept = F.filter("all", lambda x: (x["no"] == x["last"]) | ~before(x))
    found = (judged.groupBy("_id", "_key").agg(every.alias("all"))
             .select(F.col("_id").alias("_i"), F.col("_key").alias("_k"),
                     F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.struct(x["no"].alias("no"), x["family"].alias("family"))))).alias("found")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_key"),
                       F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))).cast("long").alias("n_paragraphs"))
    out = rows.join(found, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    return out.select(F.col("_id").alias(id_col), "n_paragraphs", F.coalesce("found", F.array().cast("array<struct<no:int,family:string>>")).alias("found"))


def op4_licence_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_licence"),
                        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",").alias("families"),
                        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["no"], x["family"])), ",").alias("spans"))
