"""Mixing sources to target weights in fixed-length token blocks.

1. The words of a source, in id order, are packed into blocks of
   `block_words`; a block holds word spans of one or more documents. A source
   of fewer than `block_words` blocks of that length has shorter ones
   (`block_length`), so that its target can be met by whole blocks too.
2. Output shards draw multinomial source counts, shard by shard, each with the
   weights of what is still due. A source never gets more than is due, and the
   last shard takes the rest. Draws are counted by the words that the blocks
   hold on average, so a source's words meet its target to within two blocks.
3. Draw number i of a source is mapped by a pseudorandom permutation of the
   source's block numbers (a keyed Feistel network, walked until it falls
   into the range); each pass over the source has its own permutation. A block
   comes up again only after all blocks of the source came up, so no document
   is taken more often than the passes its source needs.
4. Draws join blocks by (source, block).

The driver holds one row per source and the shard counts (sources x shards
numbers), and plans name each source once: sources are a short list (some
thousands), not a key that grows with the rows. Blocks, draws and spans are
only ever rows of DataFrames.

Defined cases: a null text has no words, is part of no block and is taken 0
times; a null source is a source of its own, last in order; ids that repeat or
are null keep one result row per input row; an empty table gives an empty
table; a source without words has the target 0. Only id, source and text
columns are read, so further columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, running_total, table
from .textops import mix

WEIGHTS = (5, 2, 1)
MULTIPLE = 1.5     # of all words, to be shared by the sources
MOST = 2.0         # times its own words that a source may give
BLOCK_WORDS = 64
SHARDS = 64
SEED = 20240229


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of `total` by weight, none above `most` times its size; what is over is shared again by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
            free.discard(i)
        left = max(left, 0.0)
    return out


def block_length(words: int, most: int = BLOCK_WORDS) -> int:
    """Words in a block of a source: `most`, less where a source would have fewer than `most` blocks."""
    return min(max(words // most, 1), most)


def shard_counts(draws: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Matrix [shard, source]: multinomial draws of each output shard; the columns add up to `draws`."""
    rng, due = np.random.default_rng(seed), draws.astype(np.int64).copy()
    out = np.zeros((shards, len(draws)), np.int64)
    for s in range(shards - 1):
        slots = int(round(due.sum() / (shards - s)))
        while slots > 0:
            got = np.minimum(rng.multinomial(slots, due / due.sum()), due)
            out[s] += got
            due -= got
            slots -= int(got.sum())
    out[-1] += due
    return out


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of i under a pseudorandom permutation of range(n) chosen by `key`; all arguments are arrays."""
    bits = np.maximum(np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.int64), 2)
    bits += (np.uint64(1) << bits.astype(np.uint64)) < n.astype(np.uint64)
    half = ((bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, live = i.astype(np.uint64).copy(), np.arange(len(i))
    while len(live):
        h, m, k = half[live], mask[live], key[live].astype(np.uint64)
        left, right = out[live] >> h, out[live] & m
        for r in range(4):
            left, right = right, left ^ (mix(right + mix(k + np.uint64(r))) & m)
        out[live] = (left << h) | right
        live = live[out[live] >= n[live].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass
class Plan:
    """What the driver knows: sources in order, their words and targets, and the draws of each shard."""
    sources: list[str | None]
    words: list[int]
    target: list[float]
    block_words: list[int]
    counts: np.ndarray
    seed: int
    draws: np.ndarray = field(init=False)

    def __post_init__(self):
        self.draws = self.counts.sum(axis=0)


def plan(sizes: DataFrame, weights=WEIGHTS, multiple=MULTIPLE, most=MOST, block_words=BLOCK_WORDS, shards=SHARDS, seed=SEED) -> Plan:
    """`sizes` has columns source, size. Collects one row per source."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("words")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    words = [int(r["words"] or 0) for r in rows]
    due = targets(words, [weights[i % len(weights)] for i in range(len(rows))], multiple * sum(words), most)
    lengths = [block_length(w, block_words) for w in words]
    draws = np.array([round(t * -(-w // n) / w) if w else 0 for t, w, n in zip(due, words, lengths)], np.int64)
    return Plan([r["source"] for r in rows], words, due, lengths, shard_counts(draws, shards, seed), seed)


def draw(spark, p: Plan) -> DataFrame:
    """Rows (source_no, block, pass_no, shard, slot): every block taken by every output shard, in its place there."""
    blocks = np.array([-(-w // n) for w, n in zip(p.words, p.block_words)], np.int64)
    firsts = np.concatenate([[0], np.cumsum(p.draws)])                  # of the sources, over all draws
    by_source = np.vstack([np.zeros(len(p.words), np.int64), np.cumsum(p.counts, axis=0)])  # before each shard, within a source
    in_shard = np.hstack([np.zeros((len(p.counts), 1), np.int64), np.cumsum(p.counts, axis=1)])
    seed, draws = p.seed, p.draws

    def rows(batches):
        for pdf in batches:
            g = pdf["id"].to_numpy()
            s = np.searchsorted(firsts, g, side="right") - 1
            i = g - firsts[s]
            shard = np.empty(len(g), np.int64)
            for one in np.unique(s):
                m = s == one
                shard[m] = np.searchsorted(by_source[:, one], i[m], side="right") - 1
            place = in_shard[shard, s] + i - by_source[shard, s]
            size = in_shard[shard, -1]
            turn = i // blocks[s]
            key = mix(np.uint64(seed) + s.astype(np.uint64) * np.uint64(1 << 20) + turn.astype(np.uint64))
            slot = permute(place, size, mix(np.uint64(seed ^ 0x5EED) + shard.astype(np.uint64)))
            yield pd.DataFrame({"source_no": s, "block": permute(i % blocks[s], blocks[s], key), "pass_no": turn, "shard": shard, "slot": slot})

    total = int(draws.sum())
    parts = max(spark.sparkContext.defaultParallelism, -(-total // 5_000_000))
    return spark.range(0, total, 1, parts).mapInPandas(rows, "source_no long, block long, pass_no long, shard long, slot long")


def spans(docs: DataFrame, p: Plan) -> DataFrame:
    """Word spans of the documents in the blocks of their source: (row columns, source_no, block, from_word, to_word)."""
    L = _of_source(p.block_words, "long")
    cols = docs.columns
    b = docs.where("size > 0").select("*", F.explode(F.sequence(
        F.floor(F.col("start") / L), F.floor((F.col("start") + F.col("size") - 1) / L))).alias("block"))
    return b.select(*cols, "block", F.greatest(F.col("block") * L - F.col("start"), F.lit(0)).alias("from_word"),
                    F.least((F.col("block") + 1) * L - F.col("start"), F.col("size")).alias("to_word"))


def _of_source(values: list, kind: str):
    """The value of the row's source, by an array lookup (one entry per source)."""
    return F.get(F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>"), F.col("source_no").cast("int"))


def packed(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """doc_id, source, size, _row (a number of the input row), start (words of the source before it)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.xxhash64(F.col(text_col)).alias("_text"))
    return running_total(rows, ["source"], ["doc_id", "_text", "size"], "size", "start")


def _source_no(p: Plan):
    """Number of the source, by an array lookup (one entry per source)."""
    named = [s for s in p.sources if s is not None]
    no = F.array_position(F.array(*[F.lit(s) for s in named]).cast("array<string>"), F.col("source")) - 1
    return F.when(F.col("source").isNull(), F.lit(len(named)).cast("long")).otherwise(no)


def mix_documents(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", **options) -> tuple[Plan, DataFrame, DataFrame]:
    """(plan, documents with their place in the source, mixed spans).

    The mixed spans have one row per document part of every drawn block:
    doc_id, _row, source_no, block, pass_no, shard, slot, from_word, to_word.
    Texts are not carried through the joins; cut words [from_word, to_word) out of a text where it is read again.
    """
    spark = docs.sparkSession
    rows = cut(packed(docs, id_col, source_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    p = plan(rows, **options)
    if not p.sources:
        p.counts = np.zeros((1, 0), np.int64)
    parts = spans(rows.withColumn("source_no", _source_no(p)), p)
    drawn = draw(spark, p)
    return p, rows, parts.join(drawn, ["source_no", "block"])


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), taken (words that the mix takes of it)."""
    p, rows, mixed = mix_documents(docs, **options)
    got = mixed.groupBy("_row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    size, due = _of_source(p.words, "long"), _of_source(p.target, "double")
    return (rows.withColumn("source_no", _source_no(p)).join(got, "_row", "left")
            .select("doc_id", "size", size.alias("source_size"), due.alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix as documents, in the columns they came with: one row per document and pass that takes words of it.

    A pass that takes all words keeps the text as it is; else the text is the
    taken words, single-spaced. Rows equal in id, source and text count as
    copies of one row; `chars_col`, if there, gets the new text's length.
    """
    _, rows, mixed = mix_documents(docs, id_col, source_col, text_col, **options)
    span = F.struct(F.col("from_word").alias("a"), F.col("to_word").alias("b"))
    copies = mixed.groupBy("_row", "pass_no").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    copies = (copies.join(rows, "_row").groupBy("doc_id", "source", "_text").agg(F.collect_list(F.struct("pass_no", "_row", "spans")).alias("_copies"))
              .withColumnsRenamed({"doc_id": "_i", "source": "_s", "_text": "_t"}))
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    df = docs.toDF(*names.values()).withColumn("_key", F.xxhash64(names[text_col]))
    df = df.dropDuplicates([names[id_col], names[source_col], "_key"])
    df = df.join(copies, F.col(names[id_col]).eqNullSafe(F.col("_i")) & F.col(names[source_col]).eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_t")))
    text = F.col(names[text_col])
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    df = df.withColumns({"_words": words, "_copy": F.explode("_copies")})
    taken_ = F.aggregate("_copy.spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    cut_out = F.array_join(F.flatten(F.transform("_copy.spans", lambda s: F.slice(F.col("_words"), (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")))), " ")
    df = df.withColumn(names[text_col], F.when(taken_ == F.size("_words"), text).otherwise(cut_out))
    if chars_col in names:
        df = df.withColumn(names[chars_col], F.length(names[text_col]).cast(docs.schema[chars_col].dataType))
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))
