"""Corpus pipeline over `documents`: five stages, each reads what the one before wrote.

1. quality rules: documents that a rule rejects go;
2. n-gram Jaccard join: one document of each near-duplicate group stays
   (five-word shingles, similarity 0.8);
3. benchmark decontamination: documents with a benchmark n-gram go;
4. mixing to target weights: the words that the mix takes of each document
   (a document that two passes take has two rows);
5. sharding: every document's shard and slot.

No SQL expresses the whole (hashes, random draws); tests/llm/test_pipeline.py
holds the stages against brute force.
"""

from __future__ import annotations

import uuid

from eventlens.llm import decontaminate, mixing, ngram_join, quality, sharding
from eventlens.session import scratch_path

SHINGLE, PERCENT = 5, 80


def quality_rules(spark, docs, sf_dir):
    return quality.keep(docs)


def near_duplicates(spark, docs, sf_dir):
    return ngram_join.first_of_group(docs, shingle=SHINGLE, percent=PERCENT)


def decontamination(spark, docs, sf_dir):
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def shard(spark, docs, sf_dir):
    return sharding.assign(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mix_sources", mix_sources), ("sharding", shard)]

ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "pipeline", uuid.uuid4().hex)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
