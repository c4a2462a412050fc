"""Benchmark decontamination by word n-grams.

The distinct n-grams of the benchmark texts are hashed into a set that every
task receives; the window hashes of each document's words are looked up in it
and every hit is verified word by word. A hit carries the ids of the items
that own the n-gram. Documents, or the hit spans in them, can be removed.

The set is built once, as numpy arrays, and broadcast only while the benchmark
texts are proven small (`BROADCAST_BYTES`, measured before; the arrays take
some ten times that). With a larger benchmark nothing of it is collected:
windows of items and documents are rows, joined on hash and words by shuffle.
A bitmap of fixed size (2^`_BITMAP` bits) of the benchmark's hashes keeps other
windows out of that shuffle; it costs or saves time only. Results are the same.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII
characters. An item with fewer than n words, but not none, is one window of
all its words.

Defined cases: null and empty texts have no words, hence no hits; a null
item text or one without words has no window; a null item id still marks
words but is not listed; repeated items count once per distinct id; repeated
documents are scanned alike, one result row each; an empty benchmark finds
nothing; an empty documents table gives an empty table. `scan` reads the id
and text columns only; `remove` returns the columns it was given.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table
from .textops import ALNUM, Words, slices, windows

N = 10
BROADCAST_BYTES = 16 << 20
_BITMAP = 27
#: The word class of ALNUM as a pattern (texts in either case).
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _gram(w: Words, i: int, k: int) -> bytes:
    return b" ".join([w.word(i + j) for j in range(k)])


def _item_windows(w: Words, n: int):
    """(k, hash, first word, item) arrays: all windows of the items, by their length k."""
    count = np.diff(w.of)
    least, h = np.minimum(count, n), w.hashes()
    for k in np.unique(least[least > 0]).tolist():
        mine = np.flatnonzero(least == k)
        many = count[mine] - k + 1
        first = np.repeat(w.of[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        yield k, windows(h, k)[first], first, np.repeat(mine, many)


class Grams:
    """The n-grams of some benchmark items as arrays: by length, a table of low hash bits, sorted hashes, a place in the words, and item numbers."""

    def __init__(self, ids: list[str | None], texts: list[str | None], n: int):
        w = self.words = Words(pa.array(texts, pa.string()), ALNUM)
        self.names = sorted({x for x in ids if x is not None})
        number = {x: i for i, x in enumerate(self.names)}
        no = np.array([number.get(x, -1) for x in ids], np.int64)
        self.by_length = {}
        for k, h, first, item in _item_windows(w, n):
            order = np.argsort(h, kind="stable")
            h, first, own = h[order], first[order], no[item[order]]
            other = np.zeros(len(h), np.int64)  # tells apart different words of one hash
            place = np.arange(len(h))
            run = np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1]), place, 0))
            at, seen = -1, {}
            for e in np.flatnonzero(run != place).tolist():
                if run[e] != at:
                    at = run[e]
                    seen = {_gram(w, int(first[at]), k): 0}
                other[e] = seen.setdefault(_gram(w, int(first[e]), k), len(seen))
            order = np.lexsort((own, other, h))
            h, other, first, own = h[order], other[order], first[order], own[order]
            new = np.append(True, (h[1:] != h[:-1]) | (other[1:] != other[:-1]))
            group = np.cumsum(new) - 1
            listed = (own >= 0) & np.append(True, (group[1:] != group[:-1]) | (own[1:] != own[:-1]))
            keys = h[new]
            mask = np.uint64((1 << max(16, (8 * len(keys)).bit_length())) - 1)
            bits = np.zeros(int(mask) + 1, bool)
            bits[(keys & mask).astype(np.int64)] = True
            at = np.searchsorted(group[listed], np.arange(len(keys) + 1))
            self.by_length[k] = mask, bits, keys, first[new], at, own[listed].astype(np.int32)
        del w._inside, w.raw

    def hits(self, w: Words):
        """(first word, length, item ids) of each verified occurrence."""
        h = w.hashes()
        for k, (mask, bits, keys, place, at, own) in self.by_length.items():
            win = windows(h, k)
            near = np.flatnonzero(bits[(win & mask).astype(np.int64)])
            if len(near):
                group = np.searchsorted(keys, win[near])
                found = keys[np.minimum(group, len(keys) - 1)] == win[near]
                near, group = near[found], group[found]
                inside = near + k <= w.of[np.searchsorted(w.of, near, side="right")]  # the window ends in the text it began in
                near, group = near[inside], group[inside]
            else:
                continue
            for i, g in zip(near.tolist(), group.tolist()):
                said = _gram(w, i, k)
                while g < len(keys) and keys[g] == win[i]:
                    if _gram(self.words, int(place[g]), k) == said:
                        yield i, k, [self.names[x] for x in own[at[g]:at[g + 1]].tolist()]
                        break
                    g += 1


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))


def _find(grams: Grams, texts: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, set]], Words]:
    """Words per text, and for the texts with hits: (mask of hit words, item ids)."""
    w = Words(texts, ALNUM)
    mask, items = np.zeros(len(w.start), bool), defaultdict(set)
    for i, k, own in grams.hits(w):
        mask[i:i + k] = True
        items[int(np.searchsorted(w.of, i, side="right")) - 1].update(own)
    return np.diff(w.of), {t: (mask[w.of[t]:w.of[t + 1]], own) for t, own in items.items()}, w


def _spans(w: Words, t: int, mask: np.ndarray) -> list[dict]:
    """Runs of hit words of text t as code point spans, end exclusive."""
    base, first = w.at[t], w.of[t]
    points = lambda b: int(np.count_nonzero((w.raw[base:b] & 0xC0) != 0x80))
    return [{"start": points(w.start[first + a]), "end": points(w.end[first + b - 1])} for a, b in _runs(mask)]


_SPANS = "array<struct<start:long,end:long>>"
_MARKS = {"_n_words": "long", "_n_hit": "long", "_items": "array<string>", "_spans": _SPANS}


def _mark(docs: DataFrame, text_col: str, shared) -> DataFrame:
    """Add the columns `_MARKS` by a scan with the broadcast set."""
    own = docs.columns
    schema = docs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in _MARKS.items()]).schema
    types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches):
        for b in slices(batches, text_col):
            words, found, w = _find(shared.value, b.column(text_col))
            hit, items, spans = [0] * len(words), [[]] * len(words), [[]] * len(words)
            for t, (mask, ids) in found.items():
                hit[t], items[t], spans[t] = int(mask.sum()), sorted(ids), _spans(w, t, mask)
            cols = [pa.array(x, t) for x, t in zip((words, hit, items, spans), types)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in own] + cols, names=own + list(_MARKS))

    return docs.mapInArrow(run, schema)


def _item_rows(items: DataFrame, n: int) -> DataFrame:
    """(k, h, gram, item): the windows of all items as rows."""
    def run(batches):
        for b in slices(batches, "text"):
            w, ids = Words(b.column("text"), ALNUM), b.column("item").to_pylist()
            for k, h, first, item in _item_windows(w, n):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(h), k), pa.int32()), pa.array(h.view(np.int64)), pa.array([_gram(w, i, k).decode() for i in first.tolist()], pa.string()),
                    pa.array([ids[i] for i in item.tolist()], pa.string())], names=["k", "h", "gram", "item"])

    return items.mapInArrow(run, "k int, h long, gram string, item string")


def _bitmap(grams: DataFrame) -> np.ndarray:
    """2^_BITMAP bits: the low bits of all hashes, gathered as at most 2^_BITMAP / 32768 pieces of 4 KB."""
    bit = F.col("h").bitwiseAND((1 << _BITMAP) - 1) + 1
    rows = grams.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect()
    out = np.zeros((1 << _BITMAP) // 8, np.uint8)
    for r in rows:
        piece = np.frombuffer(r["m"], np.uint8)
        out[(r["b"] - 1) * 4096:(r["b"] - 1) * 4096 + len(piece)] = piece
    return out


def _near_rows(texts: DataFrame, lengths: list[int], shared) -> DataFrame:
    """(key, h, gram, i, j, s, e): the windows of the texts whose hash is in the bitmap: words i to j, code points s to e."""
    def run(batches):
        bits, low = shared.value, np.uint64((1 << _BITMAP) - 1)
        for b in slices(batches, "text"):
            w, keys = Words(b.column("text"), ALNUM), b.column("key").to_pylist()
            h, point = w.hashes(), np.cumsum(np.append(0, (w.raw & 0xC0) != 0x80))
            for k in lengths:
                win = windows(h, k)
                x = (win & low).astype(np.int64)
                near = np.flatnonzero((bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1)
                text = np.searchsorted(w.of, near, side="right") - 1
                inside = near + k <= w.of[np.minimum(text + 1, len(w.of) - 1)]
                near, text = near[inside], text[inside]
                zero = point[w.at[text]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([keys[t] for t in text.tolist()], pa.string()), pa.array(win[near].view(np.int64)),
                    pa.array([_gram(w, i, k).decode() for i in near.tolist()], pa.string()), pa.array(near - w.of[text], pa.int64()),
                    pa.array(near - w.of[text] + k, pa.int64()), pa.array(point[w.start[near]] - zero, pa.int64()),
                    pa.array(point[w.end[near + k - 1]] - zero, pa.int64())], names=["key", "h", "gram", "i", "j", "s", "e"])

    return texts.mapInArrow(run, "key string, h long, gram string, i long, j long, s long, e long")


def _joined(docs: DataFrame, items: DataFrame, n: int, text_col: str) -> DataFrame:
    """Add the columns `_MARKS` by a join of window rows; results belong to texts, so copies of one fold before the shuffle."""
    spark = docs.sparkSession
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    grams = cut(_item_rows(items, n).distinct())
    lengths = sorted(r["k"] for r in grams.select("k").distinct().collect())  # n at most
    shared = spark.sparkContext.broadcast(_bitmap(grams))
    near = _near_rows(docs.select(key.alias("key"), F.col(text_col).alias("text")), lengths, shared).distinct()
    hits = cut(near.join(grams.select("h", "gram").distinct(), ["h", "gram"]))
    before = F.max("j").over(Window.partitionBy("key").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("i") <= F.col("before"), 0).otherwise(1)).over(Window.partitionBy("key").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, 0))
    runs = hits.withColumn("before", before).withColumn("run", run).groupBy("key", "run").agg(
        F.min("i").alias("i"), F.max("j").alias("j"), F.min("s").alias("start"), F.max("e").alias("end"))
    marks = runs.groupBy("key").agg(F.sum(F.col("j") - F.col("i")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    owners = hits.select("key", "h", "gram").distinct().join(grams.where("item is not null").select("h", "gram", "item"), ["h", "gram"])
    owners = owners.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = marks.join(owners.withColumnRenamed("key", "_k"), F.col("key") == F.col("_k"), "left").select(
        F.col("key").alias("_f_key"), F.col("n_hit").alias("_f_hit"), F.col("items").alias("_f_items"), F.col("spans").alias("_f_spans"))
    return docs.join(found, key == F.col("_f_key"), "left").select(
        *[docs[f"`{c}`"] for c in docs.columns], F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long").alias("_n_words"),
        F.coalesce("_f_hit", F.lit(0)).cast("long").alias("_n_hit"), F.coalesce("_f_items", F.array().cast("array<string>")).alias("_items"),
        F.coalesce("_f_spans", F.array().cast(_SPANS)).cast(_SPANS).alias("_spans"))


def _marked(docs: DataFrame, benchmark: DataFrame, n: int, text_col: str, item_col: str, item_text_col: str, most: int) -> DataFrame:
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("item"), F.lit(0)) + 64)).first()[0] or 0
    if size > most:
        return _joined(docs, items, n, text_col)
    rows = items.collect()  # below the bound
    return _mark(docs, text_col, docs.sparkSession.sparkContext.broadcast(Grams([r["item"] for r in rows], [r["text"] for r in rows], n)))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: id, n_words, n_hit, items (ids of items with an occurring window, sorted as strings), spans (hit runs, code points)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = _marked(rows, benchmark, n, "_text", item_col, item_text_col, broadcast_bytes)
    return found.select(F.col("_id").alias(id_col), *[F.col(c).alias(c[1:]) for c in _MARKS])


def remove(docs: DataFrame, benchmark: DataFrame, n: int = N, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           spans: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without hits; with `spans`, all documents, the hit spans cut out of their texts. Columns stay as they were."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    text = names[text_col]
    found = _marked(docs.toDF(*names.values()), benchmark, n, text, item_col, item_text_col, broadcast_bytes)
    if not spans:
        found = found.where("_n_hit = 0")
    else:
        last = F.concat(F.array(F.lit(0).cast("long")), F.transform("_spans", lambda s: s["end"]))
        first = F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.length(text).cast("long")))
        pieces = F.transform(F.arrays_zip(last.alias("a"), first.alias("b")), lambda x: F.substr(F.col(text), x["a"] + 1, x["b"] - x["a"]))
        found = found.withColumn(text, F.when(F.col("_n_hit") == 0, F.col(text)).otherwise(F.array_join(pieces, "")))
    return found.select(*[F.col(n).alias(c) for c, n in names.items()])


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB: windows of items and documents as rows, equal windows joined.
ORACLE_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
dl as (select rid, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as l from d),
bl as (select row_number() over () as bid, item_id,
              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as l from benchmark),
bw as (select distinct item_id, least(len(l), 10) as k, array_to_string(l[i:i + least(len(l), 10) - 1], ' ') as g
       from (select item_id, l, unnest(range(1, len(l) - least(len(l), 10) + 2)) as i from bl where len(l) > 0)),
ks as (select distinct k from bw),
hits as (select rid, i, k, item_id
         from (select rid, k, i, array_to_string(l[i:i + k - 1], ' ') as g
               from (select rid, k, l, unnest(range(1, len(l) - k + 2)) as i from dl, ks where len(l) >= k)) join bw using (k, g)),
marks as (select rid, count(distinct i + j) as n_hit from (select rid, i, unnest(range(0, k)) as j from hits) group by rid),
items as (select rid, count(distinct item_id) as n_items, string_agg(item_id, ',' order by item_id) as s
          from (select distinct rid, cast(item_id as varchar) as item_id from hits where item_id is not null) group by rid)
select doc_id, len(l) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d join dl using (rid) left join marks using (rid) left join items using (rid)
"""
