"""Fuzzy line deduplication by MinHash, with numpy inside Arrow tasks.

1. Lines with a word are hashed; equal lines (64-bit hash) are one line.
2. A line's signature holds, for each of `bands * rows` random orders, the
   smallest of its character shingles' hashes. A task computes it for each
   distinct line of a slice of rows at once, so what is shuffled is one row of
   band keys for a line.
3. Lines that agree on all rows of a band share a bucket. With independent
   orders a pair of similarity 0.8 shares one with probability 0.995. The four
   rows of a band use four different hashes, each under masks of its own; the
   test measures the recall.
4. Buckets with the same smallest line make one group, so a line is sent once
   for such buckets, and each pair of a bucket meets in a group. A task
   compares the lines of a group by exact Jaccard similarity of the shingle
   sets and returns links that join the same lines as all links would. Once
   lines are united only those outside the largest component are compared
   with the others, as every link between two components has such an end.
   Groups of more than `SMALL` lines are compared block by block, each two
   blocks in one task, so no task or row holds a large group; no pair of lines
   becomes a row.
5. Components (distributed star rounds) keep their first line: the smallest
   (id, line number).

The form in SQL functions only, which makes a row of every shingle, costs more
than the limits allow (see the README), so shingles stay inside the task here.
Its memory follows the longest line and the size of a block.

Defined cases: null and empty texts have no lines; lines without a word are
never removed; lines shorter than a shingle are their own only shingle; rows
that repeat exactly (id and text) are one document and get the same result; a
null id is smaller than others; lines of any length are shingled whole; an
empty table gives an empty table. `decisions` reads id and text only;
`dedup` returns the columns it was given.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, components, cut, release, table
from .textops import mix, slices, windows

SHINGLE = 7      # characters
BANDS = 10
ROWS = 4
PERCENT = 80
SMALL = 512      # lines of a block; a larger group is compared block by block
CHARS = 1024     # characters that count as one line there, so longer lines make smaller blocks
FEW = 6          # lines of a group whose pairs are compared all at once, together with those of other groups
SEED = 11
SLICE = 1 << 16  # bytes of lines that are hashed at once, so that the arrays stay in cache


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _key, _no, _line, lid): the lines with a word; _key tells texts of one id apart, lid is the line's hash."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    lines = rows.select("_id", F.xxhash64("_text").alias("_key"), F.posexplode(F.split("_text", "\n")).alias("_no", "_line"))
    return lines.where(F.col("_line").rlike(WORD)).withColumn("lid", F.xxhash64("_line"))


def _characters(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One number for each character of the lines (its UTF-8 bytes, never 0), and where each line begins."""
    kind = np.int64 if pa.types.is_large_string(lines.type) else np.int32
    _, offsets, data = lines.buffers()
    at = np.frombuffer(offsets, kind, len(lines) + 1, lines.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    if raw.max(initial=0) < 128:
        return raw.astype(np.uint64) + np.uint64(1), at
    begin = np.flatnonzero((raw & 0xC0) != 0x80)
    size = np.diff(np.append(begin, len(raw)))
    value = raw[begin].astype(np.uint64) + np.uint64(1)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        value[more] += raw[begin[more] + k].astype(np.uint64) << np.uint64(8 * k)
    return value, np.searchsorted(begin, at)


def shingle_hashes(lines: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of lines that aren't empty, and each line's number of them; a shorter line is its own only shingle."""
    value, at = _characters(lines)
    chars = np.diff(at)
    whole = np.zeros(len(value), np.uint64)
    w = windows(value, shingle)
    whole[:len(w)] = w
    starts = np.repeat(at[1:], chars) - np.arange(len(value)) >= shingle
    for n in np.unique(chars[chars < shingle]).tolist():
        short = at[:-1][chars == n]
        run = value[short[:, None] + np.arange(n)].ravel()
        whole[short] = windows(run, n)[::n]
        starts[short] = True
    return whole[starts], np.maximum(chars - shingle, 0) + 1


def signatures(lines: DataFrame, shingle: int, hashes: int, seed: int) -> DataFrame:
    """(lid, h0, h1, ...): the smallest shingle hash under each order.

    A line has a row for each slice of rows in which it occurs; `buckets` folds these.
    """
    rng = random.Random(seed)
    salt, masks = np.uint64(rng.getrandbits(64)), [np.uint32(rng.getrandbits(32)) for _ in range(hashes)]
    names = ["lid", *[f"h{i}" for i in range(hashes)]]

    def run(batches):
        for b in slices(batches, "_line", SLICE):
            lid, at = np.unique(b.column("lid").to_numpy(), return_index=True)
            x, n = shingle_hashes(b.column("_line").take(pa.array(at)), shingle)
            x = mix(x ^ salt)
            parts = [part.astype(np.uint32) for y in (x, mix(x + salt)) for part in (y >> np.uint64(32), y)]
            first = np.cumsum(n) - n
            least = [np.minimum.reduceat(parts[i % 4] ^ m, first).view(np.int32) for i, m in enumerate(masks)]
            yield pa.RecordBatch.from_arrays([pa.array(lid), *[pa.array(x) for x in least]], names=names)

    return lines.select("lid", "_line").mapInArrow(run, ", ".join(["lid long", *[f"{c} int" for c in names[1:]]]))


def buckets(sig: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, lid, lead) for buckets of two lines or more; `lead` is the bucket's smallest line."""
    keys = [F.xxhash64(F.lit(b), *[f"h{b * rows + i}" for i in range(rows)]).alias(f"k{b}") for b in range(bands)]
    one = sig.select("lid", *keys).groupBy("lid").agg(*[F.max(f"k{b}").alias(f"k{b}") for b in range(bands)])
    flat = one.select("lid", F.explode(F.array(*[f"k{b}" for b in range(bands)])).alias("bucket"))
    ends = {"lead": F.min("lid"), "last": F.max("lid")}
    return flat.withColumns({c: f.over(Window.partitionBy("bucket")) for c, f in ends.items()}).where("lead < last").select("bucket", "lid", "lead")


def similar(a: pa.Array, b: pa.Array, shingle: int, percent: int) -> np.ndarray:
    """Which lines of `a` have the Jaccard similarity asked for with the line of `b` at the same place.

    A pair's number takes the upper bits of its shingles' hashes, so that one sort holds the sets of a slice apart.
    """
    shift = np.uint64(64 - max((len(a) - 1).bit_length(), 1))

    def sets(lines):
        x, n = shingle_hashes(lines, shingle)
        x = np.sort((x & ((np.uint64(1) << shift) - np.uint64(1))) | (np.repeat(np.arange(len(n), dtype=np.uint64), n) << shift))
        return x[np.append(True, x[1:] != x[:-1])]

    def count(x):
        return np.bincount((x >> shift).astype(np.int64), minlength=len(a))

    x, y = sets(a), sets(b)
    z = np.sort(np.concatenate([x, y]))
    both = count(z[1:][z[1:] == z[:-1]])
    return 100 * both >= percent * (count(x) + count(y) - both)


def joined(lines: pa.Array, shingle: int, percent: int) -> list[tuple[int, int]]:
    """Places (a, b) of similar lines that join the same lines as all similar pairs; the lines are unlike texts."""
    x, n = shingle_hashes(lines, shingle)
    m = len(n)
    kinds, token = np.unique(x, return_inverse=True)
    token, line = np.divmod(np.unique(token * m + np.repeat(np.arange(m), n)), m)  # each line once for each of its shingles, by shingle
    size, often = np.bincount(line, minlength=m), np.bincount(token, minlength=len(kinds))
    begin = np.cumsum(often) - often
    own = token[np.argsort(line, kind="stable")]
    end = np.cumsum(size)
    label, asked, links = np.arange(m), np.zeros(m, bool), []
    while True:
        rest = np.flatnonzero((label != np.bincount(label).argmax()) & ~asked)
        if len(rest) == 0:
            return links
        a = rest[0]
        asked[a] = True
        t = own[end[a] - size[a]:end[a]]
        k = often[t]
        both = np.bincount(line[np.repeat(begin[t] - np.cumsum(k) + k, k) + np.arange(k.sum())], minlength=m)
        near = np.flatnonzero((100 + percent) * both >= percent * (size + size[a]))
        met, at = np.unique(label[near], return_index=True)
        links += [(int(a), int(b)) for b in near[at] if label[b] != label[a]]
        label[np.isin(label, met)] = label[a]


def _placed(held: DataFrame, small: int) -> DataFrame:
    """(lead, i, j, lid): the lines of each group; for each two blocks i < j of a large one, i = j for the others."""
    group = Window.partitionBy("lead")
    load = F.greatest(F.col("chars"), F.lit(CHARS)).cast("long")
    before = F.sum(load).over(group.orderBy("lid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - load
    rows = held.withColumn("here", F.floor(before / (small * CHARS)))
    rows = rows.withColumn("here", F.dense_rank().over(group.orderBy("here"))).withColumn("blocks", F.max("here").over(group))
    other = F.filter(F.sequence(F.lit(1), F.col("blocks")), lambda x: (x != F.col("here")) | (F.col("blocks") == 1))
    rows = rows.select("lead", "lid", "here", F.explode(other).alias("other"))
    return rows.select("lead", F.least("here", "other").alias("i"), F.greatest("here", "other").alias("j"), "lid")


def links(held: DataFrame, texts: DataFrame, shingle: int, percent: int, small: int) -> DataFrame:
    """(a, b): similar lines of the groups, enough of them to join all that are linked in a group."""
    sizes = texts.select("lid", F.length("_line").alias("chars"))
    rows = _placed(held.join(sizes, "lid"), small).join(texts, "lid")
    sets = rows.groupBy("lead", "i", "j").agg(F.collect_list(F.struct("lid", "_line")).alias("members"))

    def run(batches):
        for b in batches:
            members = b.column("members")
            size, flat = np.diff(members.offsets.to_numpy()).astype(np.int64), members.flatten()
            lid, line = flat.field("lid").to_numpy(), flat.field("_line")
            first = np.cumsum(size) - size
            pairs = []
            for s in range(2, FEW + 1):
                p, q = np.triu_indices(s, 1)
                at = first[size == s][:, None]
                pairs.append(np.stack([(at + p).ravel(), (at + q).ravel()]))
            p, q = np.concatenate(pairs, 1)
            length = pa.compute.binary_length(line).to_numpy().astype(np.int64)
            part = np.cumsum(length[p] + length[q]) // SLICE
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for x, y in zip(cuts, cuts[1:]):
                ok = similar(line.take(pa.array(p[x:y])), line.take(pa.array(q[x:y])), shingle, percent)
                yield pa.RecordBatch.from_arrays([pa.array(lid[p[x:y][ok]]), pa.array(lid[q[x:y][ok]])], names=["a", "b"])
            for g in np.flatnonzero(size > FEW):
                found = np.array(joined(line.slice(first[g], size[g]), shingle, percent), np.int64).reshape(-1, 2) + first[g]
                yield pa.RecordBatch.from_arrays([pa.array(lid[found[:, 0]]), pa.array(lid[found[:, 1]])], names=["a", "b"])

    return sets.select("members").mapInArrow(run, "a long, b long")


def groups(lines: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, seed: int = SEED,
           small: int = SMALL) -> DataFrame:
    """(lid, root): the lines that have a partner, with their component."""
    spark = lines.sparkSession
    one = lines.select("lid", "_line")
    held = cut(buckets(signatures(one, shingle, bands * rows, seed), bands, rows).select("lead", "lid").distinct())
    release(spark)
    texts = cut(one.join(held.select("lid").distinct(), "lid", "left_semi").dropDuplicates(["lid"]))
    release(spark)
    found = cut(links(held, texts, shingle, percent, small))
    release(spark)
    return components(found).withColumnRenamed("node", "lid")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per line with a word: _id, _key, _no, root (its component), keep."""
    lines = lines_of(docs, id_col, text_col)
    root = groups(lines, **options)
    at = lines.select("_id", "_key", "_no", "lid").distinct().join(root, "lid", "left").withColumn("root", F.coalesce("root", "lid")).drop("lid")
    # the first of a component: smallest id (null before others), then line number, then key; combined map-side
    first = at.groupBy("root").agg(F.min(F.struct("_id", "_no", "_key")).alias("_first"))
    keep = F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_no") == F.col("_first._no")) & (F.col("_key") == F.col("_first._key"))
    return at.join(first, "root").select("_id", "_key", "_no", "root", keep.alias("keep"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document (id and text): _id, _key, n_lines (with a word), removed (numbers of the lines that go, from 0)."""
    d = decisions(docs, id_col, text_col, **options)
    gone = d.groupBy("_id", "_key").agg(F.array_sort(F.collect_list(F.when(~F.col("keep"), F.col("_no")))).alias("removed"), F.count("*").alias("n_lines"))
    return gone.select("_id", "_key", "n_lines", "removed")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without the removed lines; columns and rows stay."""
    gone = removed(docs, id_col, text_col, **options).select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), F.col("removed").alias("_gone"))
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    text = F.col(names[text_col])
    df = docs.toDF(*names.values())  # all at once: a column may be called _c0 already
    df = df.join(gone, F.col(names[id_col]).eqNullSafe(F.col("_i")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_k")), "left")
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone")
    df = df.withColumn(names[text_col], F.when(F.coalesce(F.size("_gone"), F.lit(0)) <= 0, text).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")))
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])


def op6_fuzzy_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = removed(docs).withColumnsRenamed({"_id": "_i", "_key": "_k"})
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))
