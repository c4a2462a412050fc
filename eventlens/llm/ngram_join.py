"""N-gram Jaccard self-join with multiple-global-order filtering.

Two documents link when the Jaccard similarity of their sets of word shingles
reaches a threshold. Under any total order of all shingles, linked sets share
a shingle of their prefixes (the first n - ceil(t * n) + 1 of n). Candidates
must share one under each of several orders:

1. Equal sets are folded to one (128-bit fingerprint), so copies of a text
   cost one set. The first half of the fingerprint names the set from there on.
2. Each order ranks a quarter of the shingle space before the rest (by a hash
   of its own), in it rare shingles before frequent ones, and the few shingles
   in a large part of all documents last. The order is estimated for those
   (`_HEAVY`) and exact for the others; a wrong estimate costs time, never a
   link. Shingles of one set only cannot link and leave at once.
3. Sets that share a prefix shingle fall into one candidate group. The next
   order works inside the groups of the last, and splits them further: a pair
   stays only if every order keeps it. Groups are built from one edge per set
   and shingle (a star around the smallest set), so no pair list is made. Sets
   that share a shingle but lie too far apart in size to link, with no sets of
   sizes between them, get no edge, so fewer chance meetings make large groups.
4. Inside a final group all pairs are verified by exact overlap. A large group
   is dealt into blocks in order of size, every pair of blocks whose sizes let
   sets link is a task of its own, and a task returns spanning edges and link
   counts, never its pairs. Where only the components are wanted, pairs already
   united in a task are passed over. What the tasks are sent is bounded: beyond
   a quarter of all shingles they run in several waves.
5. Connected components of the verified edges, by distributed star rounds.

Shingles are 64-bit hashes of the words (wrong only if two shingles of a pair
collide). Texts are shuffled once, for the sets that the first order keeps.

Defined cases: null and empty texts and texts without words have an empty set
and link with nothing; texts shorter than a shingle have one shingle, all
their words; rows that repeat are copies and link; a null id is a document
like others, and a component of null ids only has the id null; an empty table
gives an empty table. Only id and text columns are read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, components, cut, release, table
from .textops import NOT_SPACE, Words, mix, slices, windows

SHINGLE = 3
PERCENT = 90
ORDERS = 3
BLOCK = 256                # sets of a block,
BLOCK_SHINGLES = 1 << 20   # and shingles of all its sets: a task compares two blocks and takes some 25 bytes a shingle besides the sets
SENT = 1 << 26             # shingles sent to such tasks at once, or a quarter of those of all documents if that is more
_HEAVY = 0.005     # of the documents; at most average set size / _HEAVY shingles reach it
_CHUNK = 2000      # documents over which a task counts shingles
_SEEDS = [np.uint64(0x1234567 * (k + 1)) for k in range(16)]


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(texts, NOT_SPACE)
    h = w.hashes()
    win = windows(h, size)
    out = []
    for a, b in zip(w.of[:-1].tolist(), w.of[1:].tolist()):
        out.append(np.unique(win[a:b - size + 1]) if b - a >= size else windows(h[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(x.view(np.int64)) for x in (mix(s).sum(dtype=np.uint64), mix(s ^ _SEEDS[15]).sum(dtype=np.uint64)))


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _fold(rows: DataFrame, size: int) -> DataFrame:
    """Per document: _id, _key (tells texts of one id apart), n, h1, h2 (the set's fingerprint); besides, rows of n = -1: a frequent shingle h1 and its count h2."""
    def run(batches):
        seen, docs = [], 0

        def heavy():
            nonlocal seen, docs
            if not seen:
                return None
            t, c = np.unique(np.concatenate(seen), return_counts=True)
            keep = c >= max(8, _HEAVY * docs)
            seen, docs = [], 0
            return t[keep], c[keep]

        for b in slices(batches, "_text"):
            sets = shingle_sets(b.column("_text"), size)
            prints = np.array([_fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1])],
                                             names=["_id", "_key", "n", "h1", "h2"])
            seen += sets
            docs += len(sets)
            kind = b.schema.field("_id").type
            if docs >= _CHUNK and (found := heavy()):
                yield _heavy_rows(kind, *found)
        if seen and (found := heavy()):
            yield _heavy_rows(kind, *found)

    rows = rows.withColumn("_key", F.xxhash64("_text"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _key long, n long, h1 long, h2 long")


def _heavy_rows(kind: pa.DataType, t: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(t), kind), pa.nulls(len(t), pa.int64()), pa.array(np.full(len(t), -1)), pa.array(_signed(t)),
                                       pa.array(c.astype(np.int64))], names=["_id", "_key", "n", "h1", "h2"])


_CLASSES = "sid long, comp long, room long, size long, cls int, toks array<long>"
_SIZED = _CLASSES + ", n long"


def _classes(sets: list[np.ndarray], sids, comps, order: int, percent: int, heavy: np.ndarray) -> pa.RecordBatch:
    """The shingles that may be in a set's prefix, by class of the order: class size, how many prefix places it has left, and the set's size."""
    out = [[], [], [], [], [], [], []]
    for s, sid, comp in zip(sets, sids, comps):
        n = len(s)
        left = n - -(-percent * n // 100) + 1 if n else 0
        if not left:
            continue
        rank = mix(s ^ _SEEDS[order])
        cls = (rank & np.uint64(3)).astype(np.int8)
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
            cls[heavy[at] == s] = 4
        for c in range(5):
            mine = np.flatnonzero(cls == c)
            if not len(mine):
                continue
            if c == 4:  # the frequent ones have their rank already
                mine = mine[np.argsort(rank[mine])[:left]]
            for col, x in zip(out, (sid, comp, left, len(mine), c, _signed(s[mine]), n)):
                col.append(x)
            left -= len(mine)
            if left <= 0:
                break
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["sid", "comp", "room", "size", "cls", "toks", "n"])


def _shared(classes: DataFrame) -> DataFrame:
    """(comp, tok, sid, n): the shingles of each set's prefix, in the groups `comp` that share them."""
    # frequent shingles (class 4, few sets have them in their prefix) are spread by a salt: they need no count
    salt = F.when(F.col("cls") == 4, F.pmod(F.col("sid"), F.lit(64))).otherwise(F.lit(0))
    t = (classes.select("sid", "comp", (F.col("room") - F.col("size")).alias("room"), "cls", "n", F.explode("toks").alias("tok"))
         .withColumn("salt", salt))
    at = Window.partitionBy("comp", "tok", "salt")
    some = t.withColumns({"df": F.count("*").over(at), "lo": F.min("sid").over(at), "hi": F.max("sid").over(at)}).where("cls = 4 or lo < hi")
    # copies of a text bring the same rows: they are folded where the window left them, before the next shuffle
    some = some.groupBy("comp", "tok", "salt", "sid", "cls").agg(*[F.max(c).alias(c) for c in ("room", "n", "df")])
    own = Window.partitionBy("sid", "cls")
    some = (some.withColumn("shared", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("df", "tok")))
            .where("rank - shared <= room").select("comp", "tok", "sid", "n"))
    return cut(some)


def _star(classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b): each set and the smallest one that shares a prefix shingle with it, among those that sizes may link to it.

    In order of size, sets that share a shingle are a run while no size is over 100 / percent times the one before it.
    Sizes of one band are within that of each other, so that runs are made of the least and largest size of each band.
    """
    prefix = _shared(classes)
    release(classes.sparkSession)  # the shuffles of all shingles go before the rounds make theirs
    prefix = prefix.withColumn("band", F.floor(F.log("n") / max(math.log(100 / percent) * (1 + 1e-9), 1e-9)))
    star = prefix.groupBy("comp", "tok", "band").agg(F.min("sid").alias("root"), F.max("sid").alias("last"), F.min("n").alias("least"), F.max("n").alias("most"))
    up = Window.partitionBy("comp", "tok").orderBy("band")
    star = star.withColumn("apart", (F.lag("band").over(up) < F.col("band") - 1) | (F.lag("most").over(up) * 100 < F.col("least") * percent))
    star = star.withColumn("run", F.count(F.when(F.col("apart"), 1)).over(up))
    run = Window.partitionBy("comp", "tok", "run")
    star = (star.select("comp", "tok", "band", F.min("root").over(run).alias("root"), F.max("last").over(run).alias("last"))
            .where("root < last").drop("last"))
    return prefix.join(star, ["comp", "tok", "band"]).select(F.col("sid").alias("a"), F.col("root").alias("b"))


def _groups(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Candidate groups (node, root) under one order, within the groups `comp`; without sizes `n`, all sets count as of one size."""
    if "n" not in classes.columns:
        classes = classes.withColumn("n", F.lit(1).cast("long"))
    return components(_star(classes, percent))


def _lists(col: pa.Array) -> list[np.ndarray]:
    flat, at = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(col.offsets) - col.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _verify(members: list[tuple], percent: int, count: bool = True):
    """Edges that span the linked sets of a group, and each set's number of linked documents; members: (sid, side, copies, shingles).

    Without `count` the numbers are left out, and a set is compared only with sets of other components so far.
    """
    m = len(members)
    n = np.array([len(x[3]) for x in members])
    copies = np.array([x[2] for x in members], np.int64)
    side = np.array([x[1] for x in members])
    toks = np.concatenate([x[3] for x in members])
    order = np.argsort(toks, kind="stable")  # one sort, and 32-bit places: a task's memory is mostly these arrays
    toks = toks[order]
    new = np.append(True, toks[1:] != toks[:-1])
    del toks
    posting, ptr = np.repeat(np.arange(m, dtype=np.int32), n)[order], np.append(np.flatnonzero(new), len(new)).astype(np.int32)
    code = np.empty(len(new), np.int32)
    code[order] = np.cumsum(new, dtype=np.int32) - 1
    del order, new
    first = np.cumsum(n) - n
    parent, links, edges = list(range(m)), np.zeros(m, np.int64), []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    two = side.min() != side.max()
    for x in range(m if two else m - 1):  # of two sides, side 0 probes whole: members come in any order
        if two and side[x]:
            continue
        if not count:
            apart = np.array([root(y) for y in range(m)]) != root(x)
            if not apart.any():
                break
        cs = code[first[x]:first[x] + n[x]]
        size = ptr[cs + 1] - ptr[cs]
        at = np.repeat(ptr[cs] - (np.cumsum(size, dtype=np.int32) - size), size) + np.arange(int(size.sum()), dtype=np.int32)
        both = np.bincount(posting[at], minlength=m)
        ok = 100 * both >= percent * (n[x] + n - both)
        if two:
            ok &= side == 1
        else:
            ok[:x + 1] = False
        if not count:
            ok &= apart
        ys = np.flatnonzero(ok)
        links[x] += copies[ys].sum()
        links[ys] += copies[x]
        for y in ys.tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[a] = b
                edges.append((members[x][0], members[y][0]))
    return edges, [(members[i][0], int(links[i])) for i in np.flatnonzero(links).tolist()] if count else []


def _tasks(sizes: DataFrame, percent: int) -> DataFrame:
    """(sid, comp, n, i, j, side): the pairs of blocks, i <= j, in which a set is compared; side 1 is block j of two. `sizes`: sid, comp, n.

    Blocks follow the sizes of a group's sets, and two blocks meet only if their sizes let a set of one link to a set of the other.
    """
    up = Window.partitionBy("comp").orderBy("n", "sid")
    s = sizes.withColumns({"m": F.count("*").over(Window.partitionBy("comp")), "place": F.row_number().over(up) - 1,
                           "before": F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")})
    s = s.where("m > 1").withColumn("block", F.floor(F.col("place") / BLOCK) + F.floor(F.col("before") / BLOCK_SHINGLES))
    blocks = s.groupBy("comp", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    pairs = (blocks.select("comp", F.col("block").alias("i"), "most").join(blocks.select("comp", F.col("block").alias("j"), "least"), "comp")
             .where((F.col("i") <= F.col("j")) & (F.col("least") * percent <= F.col("most") * 100)))
    sides = F.when(F.col("i") < F.col("j"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    pairs = (pairs.select("comp", "i", "j", F.explode(sides).alias("side"))
             .withColumn("block", F.when(F.col("side") == 1, F.col("j")).otherwise(F.col("i"))))
    return s.join(pairs, ["comp", "block"]).select("sid", "comp", "n", "i", "j", "side")


def _links(sets: DataFrame, percent: int, count: bool = True, sent: int = SENT) -> DataFrame:
    """Rows (a, b, links): spanning edges (links null), and link counts of a (b null). `sets`: sid, comp, copies, toks, and n if known; rows of a sid may repeat.

    Tasks that are sent more than `sent` shingles in all run in waves, and what a wave shuffled is released before the next.
    """
    if "n" not in sets.columns:
        sets = sets.withColumn("n", F.size("toks"))
    tasks = _tasks(sets.select("sid", "comp", "n").distinct(), percent)
    waves = -(-(tasks.agg(F.sum("n")).first()[0] or 0) // sent)
    if waves < 2:
        return _compared(tasks, sets, percent, count)
    tasks, found = cut(tasks), []
    for k in range(waves):
        found.append(cut(_compared(tasks.where(F.pmod(F.xxhash64("comp", "i", "j"), F.lit(waves)) == k), sets, percent, count)))
        release(sets.sparkSession)
    return functools.reduce(DataFrame.unionByName, found)


def _compared(tasks: DataFrame, sets: DataFrame, percent: int, count: bool) -> DataFrame:
    """What the tasks find."""
    s = tasks.drop("n").join(sets.select("sid", "copies", "toks"), "sid")
    s = s.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")

    def run(batches):
        key, group, seen = None, [], set()

        def done():
            edges, counts = _verify(group, percent, count) if key[1] == key[2] or len({x[1] for x in group}) > 1 else ([], [])  # the other block is empty
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges] + [c[0] for c in counts], pa.int64()),
                                               pa.array([e[1] for e in edges] + [None] * len(counts), pa.int64()),
                                               pa.array([None] * len(edges) + [c[1] for c in counts], pa.int64())], names=["a", "b", "links"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("comp", "i", "j", "sid", "side", "copies")]
            for comp, i, j, sid, side, copies, toks in zip(*cols, _lists(b.column("toks"))):
                if (comp, i, j) != key:
                    if len(group) > 1:
                        yield done()
                    key, group, seen = (comp, i, j), [], set()
                if sid not in seen:
                    seen.add(sid)
                    group.append((sid, side, copies, toks))
        if len(group) > 1:
            yield done()

    return s.mapInArrow(run, "a long, b long, links long")


def _members(docs: DataFrame, shingle: int, percent: int, orders: int, id_col: str, text_col: str, count: bool = True) -> DataFrame:
    """Per document: _id, _key, n, its group (_g1, _g2), _links (null without `count`), copies (documents of the same set)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    folded = cut(_fold(rows, shingle))
    members = folded.where("n >= 0")
    heavy = _heavy_list(folded, members)

    def first(batches):
        seen = set()  # a task sends each set once, however many copies it reads
        for b in slices(batches, "_text"):
            sets = {_fingerprint(s)[0]: s for s in shingle_sets(b.column("_text"), shingle)}
            sids = [x for x in sets if x not in seen]
            seen.update(sids)
            yield _classes([sets[x] for x in sids], sids, [0] * len(sids), 0, percent, heavy)

    group = _groups(rows.mapInArrow(first, _SIZED), percent)
    release(docs.sparkSession)
    unique = members.where("n > 0").groupBy("h1", "h2").agg(F.min("_id").alias("_rep"), F.count("*").alias("copies"))
    wanted = unique.join(group, F.col("h1") == F.col("node")).select("_rep", F.col("h1").alias("sid"), F.col("root").alias("comp"), "copies")

    def read(batches):
        seen = set()  # a set comes again where an id repeats: once from a task, and whoever reads sets expects copies
        for b in slices(batches, "_text"):
            sets, sid, keep = shingle_sets(b.column("_text"), shingle), b.column("sid").to_pylist(), []
            for s, x in zip(sets, sid):
                keep.append(x not in seen and _fingerprint(s)[0] == x)  # ids may repeat over other texts
                if keep[-1]:
                    seen.add(x)
            toks = [_signed(s) for s, ok in zip(sets, keep) if ok]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep, pa.bool_())) for c in ("sid", "comp", "copies")] +
                                             [pa.array([len(t) for t in toks], pa.int64()), pa.array(toks, pa.list_(pa.int64()))],
                                             names=["sid", "comp", "copies", "n", "toks"])

    sets = (rows.join(wanted, F.col("_id").eqNullSafe(F.col("_rep"))).select("_text", "sid", "comp", "copies")
            .mapInArrow(read, "sid long, comp long, copies long, n long, toks array<long>"))
    sets = cut(sets)
    release(docs.sparkSession)
    for k in range(1, orders):
        def again(batches, k=k):
            for b in batches:
                yield _classes(_lists(b.column("toks")), b.column("sid").to_pylist(), b.column("comp").to_pylist(), k, percent, heavy)

        group = _groups(sets.select("sid", "comp", "toks").mapInArrow(again, _SIZED), percent)
        release(docs.sparkSession)
        sets = sets.drop("comp").join(group.select(F.col("node").alias("sid"), F.col("root").alias("comp")), "sid")
    found = cut(_links(sets, percent, count, max(SENT, (members.agg(F.sum("n")).first()[0] or 0) // 4)))
    release(docs.sparkSession)
    comp = components(found.where("b is not null").select("a", "b")).withColumnRenamed("root", "_root")
    degree = found.where("b is null").groupBy(F.col("a").alias("_a")).agg(F.sum("links").alias("_links"))

    out = members.join(comp, F.col("h1") == F.col("node"), "left").join(degree, F.col("h1") == F.col("_a"), "left")
    out = out.withColumns({"_g1": F.coalesce("_root", "h1"), "_g2": F.when(F.col("_root").isNull(), F.col("h2")).otherwise(0)})
    same = unique.select(F.col("h1").alias("_c1"), F.col("h2").alias("_c2"), "copies")
    out = out.join(same, (F.col("n") > 0) & (F.col("h1") == F.col("_c1")) & (F.col("h2") == F.col("_c2")), "left")
    return out.select("_id", "_key", "n", "_g1", "_g2", "_links", "copies")


def linked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, orders: int = ORDERS,
           id_col: str = "doc_id", text_col: str = "text", n_links: bool = True) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable by links), and unless switched off n_links (documents linked directly)."""
    out = _members(docs, shingle, percent, orders, id_col, text_col, n_links)
    least = (out.where("n > 0").groupBy("_g1", "_g2").agg(F.min("_id").alias("_least"))
             .withColumnsRenamed({"_g1": "_l1", "_g2": "_l2"}))
    out = out.join(least, (F.col("n") > 0) & (F.col("_g1") == F.col("_l1")) & (F.col("_g2") == F.col("_l2")), "left")
    links = F.coalesce("_links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("_id")).alias("component_id"),
                      *[links.alias("n_links")] * n_links)


def first_of_group(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, orders: int = ORDERS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with the columns it came with: the smallest id (null last), then the smallest text hash.

    Documents without words belong to no group and all stay. Of rows equal in id and text one stays.
    """
    members = cut(_members(docs, shingle, percent, orders, id_col, text_col, count=False).where("n > 0").select("_id", "_key", "_g1", "_g2"))
    release(docs.sparkSession)
    first = members
    for c in ("_id", "_key"):
        least = first.groupBy("_g1", "_g2").agg(F.min(c).alias("_least")).withColumnsRenamed({"_g1": "_l1", "_g2": "_l2"})
        first = first.join(least, (F.col("_g1") == F.col("_l1")) & (F.col("_g2") == F.col("_l2")) & F.col(c).eqNullSafe(F.col("_least"))).drop("_l1", "_l2", "_least")
    first = first.select("_id", "_key").distinct().withColumn("_first", F.lit(True))
    # Only documents that go, or that have a row equal in id and text, are named; all others pass the join unmatched.
    rows = members.groupBy("_id", "_key").agg(F.count("*").alias("_rows")).withColumnsRenamed({"_id": "_i", "_key": "_k"})
    named = (rows.join(first, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left")
             .where("_first is null or _rows > 1").select("_i", "_k", F.coalesce("_first", F.lit(False)).alias("_first")))
    named = cut(named)
    release(docs.sparkSession)
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    df, own = docs.toDF(*names.values()).withColumn("_key", F.xxhash64(names[text_col])), names[id_col]
    df = df.join(named, F.col(own).eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left").where("_first is null or _first")
    out = [F.col(n).alias(c) for c, n in names.items()]
    if named.where("_first").isEmpty():
        return df.select(*out)
    return df.where("_first is null").unionByName(df.where("_first").dropDuplicates([own, "_key"])).select(*out)


def _heavy_list(folded: DataFrame, members: DataFrame) -> np.ndarray:
    """Shingles counted in at least _HEAVY of all documents; the sum of all set sizes bounds their number."""
    n = members.count()
    h = folded.where("n = -1").groupBy("h1").agg(F.sum("h2").alias("c")).where(F.col("c") >= max(16, _HEAVY * n)).select("h1").collect()
    return np.sort(np.array([r[0] for r in h], np.int64).view(np.uint64))


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


#: DuckDB: shared shingles counted for all pairs, then the transitive closure.
ORACLE_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') as l from documents),
s as (select distinct doc_id, case when len(l) < 3 then array_to_string(l, ' ') else array_to_string(l[i:i + 2], ' ') end as g
      from (select doc_id, l, unnest(range(1, greatest(len(l) - 1, 2))) as i from d where len(l) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (select a.doc_id as x, b.doc_id as y from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
          group by a.doc_id, b.doc_id
          having 100 * count(*) >= 90 * ((select n from n where doc_id = a.doc_id) + (select n from n where doc_id = b.doc_id) - count(*))),
deg as (select x as doc_id, count(*) as n_links from links group by x),
reach as (select doc_id as x, doc_id as y from d union select r.x, l.y from reach r join links l on r.y = l.x)
select doc_id, coalesce(n, 0) as n_shingles, component_id, coalesce(n_links, 0) as n_links
from (select x as doc_id, min(y) as component_id from reach group by x) left join n using (doc_id) left join deg using (doc_id)
"""
