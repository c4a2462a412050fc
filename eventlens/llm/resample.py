"""Importance resampling towards a target distribution, on hashed word n-grams.

Runs of 1 to 3 words fall into buckets by their CRC-32. How much more common a
bucket is in the target texts than in the corpus is its gain; a document's
weight is the sum of the gains of its features, and the documents with the
highest weight plus Gumbel noise are drawn.

Features are hashed by a head-tail vocabulary. Every task gets the CRC states of
frequent words and of frequent word pairs, both exact and looked up by the
words' own bytes; words and pairs that are not there take their CRC directly,
so the vocabulary decides speed only, never a bucket. The state of a longer run
follows from the states of its pieces, because a CRC is linear: no feature text
is ever built. Both feed the same exact bucket totals.

* The vocabulary is counted over all texts: every slice of text reports the
  words and pairs that make up at least 1 / `SHARE` of it, so none that is that
  common in the corpus is missed, and no slice reports more than 2 x `SHARE`.
  The most frequent, up to `HEAD_WORDS` and `HEAD_PAIRS`, are kept.
* A task returns one count per bucket, the driver gets one total per bucket;
  the broadcasts (vocabulary, gains) have a fixed size.
* Ranks come from a range-partitioned running count over (score, id, row
  number): equal rows spread like any others.

Defined cases: a null or empty text has no words, weight 0 and n_features 0; a
null id is hashed as an empty one and comes after all others in ties; repeated
rows count each and are drawn each; an empty target gives every bucket the
gains of T = 0; an empty table gives an empty table. Words of any length count;
texts are worked on in blocks of words. `weigh` and `draw` read the id and text
columns only; `sample` returns the columns it was given.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, running_total, table
from .textops import ALNUM, Words, mix, slices

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 5, 42
HEAD_WORDS, HEAD_PAIRS, SHARE = 1 << 15, 1 << 16, 20_000
#: Longest word of the vocabulary, in bytes (two machine words).
SHORT = 16
_BLOCK = 1 << 18


def _one_byte() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_BYTE = _one_byte()
_IDENTITY = np.array([[v << 8 * k for v in range(256)] for k in range(4)], np.uint32)


def _apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The linear map with byte tables `t` (4, 256), applied to each value."""
    return t[0][c & np.uint32(255)] ^ t[1][(c >> np.uint32(8)) & np.uint32(255)] ^ t[2][(c >> np.uint32(16)) & np.uint32(255)] ^ t[3][c >> np.uint32(24)]


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Maps of a CRC over 0..63 further zero bytes, and over 2^k of them."""
    small = [_IDENTITY]
    for _ in range(63):
        small.append(_BYTE[small[-1] & np.uint32(255)] ^ (small[-1] >> np.uint32(8)))
    powers = [small[1]]
    for _ in range(31):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.array(small), powers


_SMALL, _POWERS = _shifts()
_SPACE = np.uint32(zlib.crc32(b" "))


def shifted(c: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc(A) as it counts in crc(A + B), for |B| = size; crc(A + B) is this ^ crc(B)."""
    k = np.minimum(size, 63)
    b = lambda i: ((c >> np.uint32(8 * i)) & np.uint32(255)).astype(np.int64)
    flat, at = _SMALL.reshape(-1), k.astype(np.int64) * 1024
    out = flat[at + b(0)] ^ flat[at + 256 + b(1)] ^ flat[at + 512 + b(2)] ^ flat[at + 768 + b(3)]
    for i in np.flatnonzero(size > 63).tolist():
        one, n = c[i:i + 1], int(size[i])
        for bit in range(n.bit_length()):
            if n >> bit & 1:
                one = _apply(_POWERS[bit], one)
        out[i] = one[0]
    return out


def direct(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of raw[start:start + size] for each word, byte after byte over all words at once, the longest words first."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    most = int(left[0]) if len(left) else 0
    for j in range(min(most, 64)):
        n = int(np.searchsorted(-left, -j, side="left"))  # words with more than j bytes
        c[:n] = _BYTE[(c[:n] ^ raw[at[:n] + j]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~c
    for i in np.flatnonzero(size > 64).tolist():
        out[i] = zlib.crc32(raw[start[i]:start[i] + size[i]].tobytes())
    return out


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def packed(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each word as two numbers; words hold no zero byte, so these are exact up to 16 bytes."""
    room = np.concatenate([raw, np.zeros(SHORT, np.uint8)])
    eight = np.ndarray((len(room) - 7,), "<u8", room, strides=(1,))
    return (eight[start] & _MASK[np.minimum(size, 8)],
            eight[np.minimum(start + 8, len(eight) - 1)] & _MASK[np.clip(size - 8, 0, 8)])


def _slot(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return (mix(a + mix(b)) >> np.uint64(64 - bits)).astype(np.int64)


class _Table:
    """Pairs of numbers -> position, one look at one slot; a pair whose slot is taken is left out (it is then no part of the head)."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.bits = max(4, int(len(a)).bit_length() + 2)
        slot = _slot(a, b, self.bits)
        _, first = np.unique(slot, return_index=True)
        self.a, self.b = (np.zeros(1 << self.bits, np.uint64) for _ in range(2))
        self.at = np.full(1 << self.bits, -1, np.int64)
        self.a[slot[first]], self.b[slot[first]], self.at[slot[first]] = a[first], b[first], first

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = _slot(a, b, self.bits)
        return np.where((self.a[slot] == a) & (self.b[slot] == b), self.at[slot], -1)


class Head:
    """CRC states of frequent words and of frequent pairs of these words."""

    def __init__(self, words: list[bytes], pairs: list[bytes]):
        words = [w for w in words if len(w) <= SHORT]
        raw, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        self.words = _Table(*packed(raw, np.cumsum(size) - size, size))
        self.word_crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        place = {w: i for i, w in enumerate(words)}
        both = [(place.get(a), place.get(b), p) for p in pairs for a, b in [p.split(b" ")]]
        both = [x for x in both if x[0] is not None and x[1] is not None]
        self.pairs = _Table(np.array([x[0] + 1 for x in both], np.uint64), np.array([x[1] + 1 for x in both], np.uint64))
        self.pair_crc = np.array([zlib.crc32(x[2]) for x in both], np.uint32)

    def word_states(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(CRC, place in the head or -1) of each word."""
        place = np.full(len(start), -1, np.int64)
        if len(self.word_crc):
            place = np.where(size <= SHORT, self.words.find(*packed(raw, start, size)), -1)
        crc = np.empty(len(start), np.uint32)
        tail = place < 0
        crc[~tail] = self.word_crc[place[~tail]]
        crc[tail] = direct(raw, start[tail], size[tail])
        return crc, place

    def pair_states(self, crc: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """CRC of each word, a space and the next word."""
        out, found = np.empty(max(len(crc) - 1, 0), np.uint32), np.full(max(len(crc) - 1, 0), -1, np.int64)
        known = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0)) if len(self.pair_crc) else np.empty(0, np.int64)
        found[known] = self.pairs.find((place[known] + 1).astype(np.uint64), (place[known + 1] + 1).astype(np.uint64))
        head = found >= 0
        out[head] = self.pair_crc[found[head]]
        tail = np.flatnonzero(~head)
        spaced = _apply(_SMALL[1], crc[tail]) ^ _SPACE
        out[tail] = shifted(spaced, size[tail + 1]) ^ crc[tail + 1]
        return out


def features(w: Words, head: Head, buckets: int):
    """For each block of words: (text of each word, buckets of the runs of 1, 2 and 3 words that begin there, which runs exist)."""
    size, n = (w.end - w.start).astype(np.int64), len(w.start)
    text = np.repeat(np.arange(len(w.of) - 1), np.diff(w.of))
    left = w.of[1:][text] - np.arange(n) if n else np.empty(0, np.int64)
    of = lambda c: (c % np.uint32(buckets)).astype(np.int64)
    for a in range(0, n, _BLOCK):
        b, end = min(a + _BLOCK, n), min(a + _BLOCK + 2, n)
        crc, place = head.word_states(w.low, w.start[a:end], size[a:end])
        two = head.pair_states(crc, place, size[a:end])
        three = shifted(_apply(_SMALL[1], two[:-1]) ^ _SPACE, size[a + 2:end]) ^ crc[2:] if len(two) > 1 else np.empty(0, np.uint32)
        runs = [(of(crc[:b - a]), np.ones(b - a, bool))]
        for k, c in ((2, two), (3, three)):
            whole = np.zeros(b - a, np.uint32)
            whole[:min(b - a, len(c))] = c[:b - a]
            runs.append((of(whole), left[a:b] >= k))
        yield text[a:b], runs


def _n_features(n_words: np.ndarray) -> np.ndarray:
    return n_words + np.maximum(n_words - 1, 0) + np.maximum(n_words - 2, 0)


def _common(w: Words, share: int) -> tuple[list[bytes], list[int]]:
    """Words and pairs (joined by a space) that make up at least 1 / share of the words of these texts, with their counts."""
    size, n = (w.end - w.start).astype(np.int64), len(w.start)
    lo, hi = packed(w.low, w.start, size)
    _, first, inverse, counts = np.unique(mix(lo + mix(hi)), return_index=True, return_inverse=True, return_counts=True)
    often = (counts * share >= n) & (counts > 1) & (size[first] <= SHORT)
    found, number = [w.word(int(i)) for i in first[often]], counts[often].tolist()
    last = np.zeros(n, bool)
    ends = w.of[1:][np.diff(w.of) > 0] - 1
    last[ends] = True
    at = np.flatnonzero(often[inverse[:-1]] & often[inverse[1:]] & ~last[:-1])
    if len(at):
        _, first, counts = np.unique(inverse[at].astype(np.int64) * len(often) + inverse[at + 1], return_index=True, return_counts=True)
        keep = (counts * share >= n) & (counts > 1)
        found += [w.word(int(i)) + b" " + w.word(int(i) + 1) for i in at[first[keep]]]
        number += counts[keep].tolist()
    return found, number


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{text_col}`").alias("_text"))


def head(docs: DataFrame, text_col: str = "text", words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS, share: int = SHARE) -> Head:
    """The most frequent words and pairs of the corpus; what a task reports is combined before the shuffle."""
    def run(batches):
        for b in slices(batches, "_text"):
            w = Words(b.column("_text"), ALNUM)
            if len(w.start):
                found, n = _common(w, share)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(n, pa.int64())], names=["gram", "n"])

    n = _texts(docs, text_col).mapInArrow(run, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = cut(n.select("gram", (F.instr(F.col("gram").cast("string"), " ") > 0).alias("pair"), F.floor(F.log2("n") * 16).alias("level")))
    # Levels of frequency, 16 for each doubling: those that fit as a whole are taken, so no ranking of all grams is needed.
    levels = sorted(n.groupBy("pair", "level").count().collect(), key=lambda r: -r["level"])
    keep = F.lit(False)
    for pair, most in ((False, words), (True, pairs)):
        least = None
        for r in levels:
            if r["pair"] == pair:
                most -= r["count"]
                if most < 0:
                    break
                least = r["level"]
        if least is not None:
            keep = keep | ((F.col("pair") == pair) & (F.col("level") >= least))
    found = n.where(keep).select("gram", "pair").collect()  # at most words + pairs rows
    of = lambda pair: sorted(bytes(r["gram"]) for r in found if r["pair"] == pair)
    return Head(of(False), of(True))


def totals(df: DataFrame, shared, buckets: int = BUCKETS, min_words: int = MIN_WORDS, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(features in each bucket, number of texts with at least `min_words` words) over all rows."""
    def run(batches):
        count, long_enough = np.zeros(buckets, np.int64), 0
        for b in slices(batches, "_text"):
            w = Words(b.column("_text"), ALNUM)
            long_enough += int((np.diff(w.of) >= min_words).sum())
            for _, runs in features(w, shared.value, buckets):
                for bucket, there in runs:
                    count += np.bincount(bucket[there], minlength=buckets)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(count[used], long_enough), pa.int64())], names=["bucket", "n"])

    out, n = np.zeros(buckets, object), 0
    rows = _texts(df, text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    for r in rows.collect():  # at most buckets + 1
        if r["bucket"] < 0:
            n = int(r["n"])
        else:
            out[r["bucket"]] = int(r["n"])
    return out, n


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share of the target over that of the corpus."""
    buckets = len(corpus)
    s_all, t_all = sum(corpus.tolist()), sum(target.tolist())
    one = lambda s, t: math.floor(1000 * math.log(float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets))))
    return np.array([one(s, t) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weigher(shared, buckets: int):
    """Per slice of texts: (words, features, weight) of each."""
    def of(texts: pa.Array):
        h, gain = shared.value
        w = Words(texts, ALNUM)
        n, weight = np.diff(w.of).astype(np.int64), np.zeros(len(texts), np.int64)
        for text, runs in features(w, h, buckets):
            total = sum(np.where(there, gain[bucket], 0) for bucket, there in runs)
            first = int(text[0])
            # sums of whole numbers far below 2^53 in one block, so doubles hold them exactly
            part = np.bincount(text - first, weights=total.astype(np.float64)).astype(np.int64)
            weight[first:first + len(part)] += part
        return n, _n_features(n), weight
    return of


def _noise(id_: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


_SCORED = {"_n_words": "long", "_n_features": "long", "_weight": "long"}


def _scored(rows: DataFrame, id_col: str, text_col: str, keep: list[str], target: DataFrame, target_text: str, buckets: int,
            min_words: int, seed: int, words: int, pairs: int, share: int) -> tuple[DataFrame, int]:
    """`keep` columns with `_SCORED` and `_score` of each row, and the number of rows with enough words."""
    sc = rows.sparkSession.sparkContext
    h = head(rows, text_col, words, pairs, share)
    shared = sc.broadcast(h)
    corpus, n = totals(rows, shared, buckets, min_words, text_col)
    wanted, _ = totals(target, shared, buckets, min_words, target_text)
    weigh_ = _weigher(sc.broadcast((h, gains(corpus, wanted))), buckets)

    def run(batches):
        for b in slices(batches, text_col):
            found = weigh_(b.column(b.schema.get_field_index(text_col)))
            cols = [b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(x, pa.int64()) for x in found]
            yield pa.RecordBatch.from_arrays(cols, names=keep + list(_SCORED))

    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in _SCORED])
    need = list(dict.fromkeys([*keep, text_col]))
    return rows.select(*need).mapInArrow(run, schema).withColumn("_score", F.col("_weight") + _noise(F.col(id_col), seed)), n


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS,
         id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS,
         share: int = SHARE) -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score, rank (of the drawn ones, 1 the best; null else)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    scored, n = _scored(rows, "_id", "_text", ["_id"], target, target_text, buckets, min_words, seed, words, pairs, share)
    enough = F.col("_n_words") >= min_words
    # cut, because the range exchange of the ranks reads its input twice
    scored = cut(scored.select("_id", *_SCORED, "_score", enough.cast("long").alias("_enough"), (-F.col("_score")).alias("_order"),
                           F.col("_id").isNull().alias("_null"), F.monotonically_increasing_id().alias("_at")))
    ranked = running_total(scored, [], ["_order", "_null", "_id", "_at"], "_enough", "_ahead")
    drawn = (F.col("_enough") == 1) & (F.col("_ahead") < F.lit(percent * n // 100))
    return ranked.select(F.col("_id").alias(id_col), *[F.col(c).alias(c[1:]) for c in _SCORED], F.col("_score").alias("score"),
                         F.when(drawn, F.col("_ahead") + 1).cast("long").alias("rank"))


def sample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS,
           id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", **head_sizes) -> DataFrame:
    """The drawn documents with the columns they came with. Rows that equal the last drawn one in score and id all come along."""
    sizes = {"words": HEAD_WORDS, "pairs": HEAD_PAIRS, "share": SHARE, **head_sizes}
    last = draw(docs, target, percent, min_words, seed, buckets, id_col, text_col, target_text, **sizes)
    last = last.where("rank is not null").orderBy(F.desc("rank")).limit(1).select(F.col(id_col).alias("id"), "score").collect()
    if not last:
        return docs.where("false")
    names = docs.columns
    rows = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    id_, text = (f"_c{names.index(c)}" for c in (id_col, text_col))
    scored, _ = _scored(rows, id_, text, rows.columns, target, target_text, buckets, min_words, seed, **sizes)
    end = last[0]
    as_good = F.lit(True) if end["id"] is None else F.col(id_) <= F.lit(end["id"])
    drawn = (F.col("_n_words") >= min_words) & ((F.col("_score") > end["score"]) | ((F.col("_score") == end["score"]) & as_good))
    return scored.where(drawn).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def op13_importance_resample(spark, sf_dir: str) -> DataFrame:
    out = draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
