"""Vector compression by part codebooks (product quantisation), trained by member-resident Lloyd rounds.

Every vector becomes whole numbers floor(256 * x) and is cut into equal
consecutive parts. A part lives with the codebook entry that owns it: part rows
are a bucketed table by (position, entry, salt). In a round the owners sum
their resident members where they are (one row per position, entry and salt
leaves the task), the new entries go out to all tasks as a broadcast of fixed
size, and every part looks for its nearest entry in place. Only the parts whose
entry changed go through the next shuffle; the others stay in their bucket.

* Salts grow with the number of buckets, so the copies of one vector, be they a
  third of all rows, spread over as many tasks as there are.
* The broadcast codebooks hold parts x entries x dimensions / parts numbers,
  whatever the number of rows.
* Rounds are written tables in the shared checkpoint folder, so a lost executor
  repeats one round at most.

Defined cases: rows whose vector is null or holds null or non-finite components
are dropped. The vector length is that of the smallest kept id among lengths
that the parts divide; kept rows of another length stay, with null code and
error, and take no part in codebooks or label errors. Ids sort nulls last,
repeated rows count each, equal ids by their components. With fewer rows than
entries the codebook is shorter. Components beyond +-65536 count as +-65536, so
squared errors stay within a long. An empty table gives an empty table. Only
the id, vector and label columns are read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import cut, release, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 24
#: Buckets a salt stands for: the rows of a hot entry spread over buckets / this many of them.
BUCKETS_A_SALT = 16
#: Numbers in a block of distances of one task.
_BLOCK = 1 << 21
_AUTO = "spark.sql.sources.bucketing.autoBucketedScan.enabled"


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * component), null when the vector is null or holds null or non-finite components."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    near = lambda v: F.greatest(F.least(F.floor(v * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    bounded = lambda v: F.greatest(F.least(v, F.lit(LIMIT / scale)), F.lit(-LIMIT / scale))
    return F.when(vector.isNotNull() & finite, F.transform(x, lambda v: near(bounded(v))))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of the smallest squared distance for each row of x (the lowest on ties), and that distance; whole numbers throughout.

    The search is a matrix product in doubles where all of its sums stay below
    2^52 and hence are exact, and in 64-bit integers otherwise.
    """
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * max(book.shape[1], 1) * most * most < 1 << 52 else np.int64
    b = book.astype(kind)
    own, entry = (b * b).sum(axis=1), np.empty(len(x), np.int32)
    step = max(1, _BLOCK // max(len(book), 1))
    for i in range(0, len(x), step):
        entry[i:i + step] = (own - 2 * (x[i:i + step].astype(kind) @ b.T)).argmin(axis=1)
    diff = x.astype(np.int64) - book.astype(np.int64)[entry]
    return entry, (diff * diff).sum(axis=1)


def _rows(parts: pd.Series, width: int) -> np.ndarray:
    return np.concatenate(parts.to_numpy()).reshape(len(parts), width) if len(parts) and width else np.zeros((len(parts), width), np.int64)


def _nearest_udf(shared):
    """Pandas UDF (position, part) -> (entry, error) in the broadcast codebooks."""
    @F.pandas_udf("entry int, error long")
    def of(pos: pd.Series, part: pd.Series) -> pd.DataFrame:
        books = shared.value
        p, x = pos.to_numpy(), _rows(part, books.shape[2])
        entry, error = np.zeros(len(p), np.int32), np.zeros(len(p), np.int64)
        for k in np.unique(p):
            at = np.flatnonzero(p == k)
            entry[at], error[at] = nearest(x[at], books[k])
        return pd.DataFrame({"entry": entry, "error": error})
    return of


class Members:
    """Part rows (pos, entry, salt, part, ...) in buckets of (pos, entry, salt)."""

    KEY = ("pos", "entry", "salt")

    def __init__(self, spark):
        self.spark, self.buckets = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.salts = -(-self.buckets // BUCKETS_A_SALT)
        self.at, self.names = scratch_path(spark, "vector_codes", uuid.uuid4().hex), []
        # Spark reads buckets as plain files where it sees no join or grouping to gain; here each task shall hold one bucket always.
        self.auto = spark.conf.get(_AUTO)
        spark.conf.set(_AUTO, "false")

    def place(self, df: DataFrame) -> DataFrame:
        """`df` dealt to the owners of its rows."""
        return df.repartition(self.buckets, *self.KEY)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write rows that are dealt already as the members of the next round: tasks of stayers and of movers hold one bucket each,
        so a bucket gets one file of either and needs no further exchange."""
        name = f"members_{uuid.uuid4().hex}"
        df.write.format("parquet").option("path", f"{self.at}/{name}").bucketBy(self.buckets, *self.KEY).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def close(self) -> None:
        self.spark.conf.set(_AUTO, self.auto)
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def moved(members: DataFrame, near, place) -> DataFrame:
    """Members with the entry `near` finds: those that keep theirs stay where they are, the others are shuffled to their new owners."""
    now = members.withColumn("_new", near("pos", "part")["entry"])
    stay = now.where("_new = entry").select(*members.columns)
    go = now.where("_new <> entry").select(*[F.col("_new").alias("entry") if c == "entry" else F.col(c) for c in members.columns])
    return stay.union(place(go))


def updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after the owners' update: floor of the mean of the resident members, unused entries as they were.

    Sums are taken per (pos, entry, salt) in place; salts then meet as one row
    each. The result has at most parts x entries rows.
    """
    width = books.shape[2]
    sums = members.groupBy("pos", "entry", "salt").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("part", F.lit(j)).cast("long")).alias(f"s{j}") for j in range(width)])
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = books.copy()
    for r in sums.groupBy("pos", "entry").agg(whole("n"), *[whole(f"s{j}") for j in range(width)]).collect():
        out[r["pos"], r["entry"]] = [int(r[f"s{j}"]) // int(r["n"]) for j in range(width)]
    return out


def _first_books(kept: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """(parts, entries, width) from the vectors of the smallest ids; None without a vector to cut."""
    fit = kept.where((F.size("_v") > 0) & (F.size("_v") % parts == 0))
    order = [F.col("_id").asc_nulls_last(), F.col("_v")]
    first = fit.orderBy(*order).limit(1).collect()
    if not first:
        return None
    size = len(first[0]["_v"])
    rows = fit.where(F.size("_v") == size).orderBy(*order).limit(entries).collect()
    return np.array([r["_v"] for r in rows], np.int64).reshape(len(rows), parts, size // parts).swapaxes(0, 1).copy()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """(codes, codebooks): codes has one row per kept vector, id, label, codes array<int>, error long; codebooks (parts, entries, width)."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label"),
                          whole_numbers(F.col(f"`{vector_col}`"), scale).alias("_v")).where("_v is not null")
    books = _first_books(kept, parts, entries)
    if books is None:
        none = kept.select(F.col("_id").alias("id"), F.col("_label").alias("label"), F.lit(None).cast("array<int>").alias("codes"),
                           F.lit(None).cast("long").alias("error"))
        return none, None
    m = Members(spark)
    try:
        return _rounds(kept, books, m, parts, rounds)
    finally:
        m.close()


def _rounds(kept: DataFrame, books: np.ndarray, m: Members, parts: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    spark, width, shared = kept.sparkSession, books.shape[2], []

    def near():
        shared.append(spark.sparkContext.broadcast(books))
        return _nearest_udf(shared[-1])

    rows = kept.withColumn("row", F.monotonically_increasing_id())
    fit = rows.where(F.size("_v") == parts * width)
    cut_up = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(
        i.alias("pos"), F.slice("_v", i * width + 1, F.lit(width)).alias("part"),
        # the id and label travel with one part of each vector
        F.when(i == 0, F.struct(F.col("_id").alias("id"), F.col("_label").alias("label"))).alias("own")))
    members = fit.select("row", F.inline(cut_up)).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(m.salts)).cast("int"))
    members = m.keep(m.place(members.withColumn("entry", near()("pos", "part")["entry"])))
    for k in range(rounds):
        books = updated(members, books)
        if k < rounds - 1:
            members = m.keep(moved(members, near(), m.place))
    final = members.withColumn("_near", near()("pos", "part"))
    final = final.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("pos", "_near.entry"))).alias("codes"),  # `parts` of them
        F.sum("_near.error").alias("error"), F.max("own").alias("own"))
    codes = final.select("own.id", "own.label", F.transform("codes", lambda x: x["entry"]).alias("codes"), "error")
    other = rows.where(F.size("_v") != parts * width)
    codes = cut(codes.unionByName(other.select(F.col("_id").alias("id"), F.col("_label").alias("label"),
                                               F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))))
    for s in shared:
        s.unpersist()
    release(spark)
    return codes, books


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """The vectors that the codes stand for: id, vector (centre of each whole number's range, array<double>)."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(code: pd.Series) -> pd.Series:
        b = shared.value
        at = np.arange(b.shape[0])
        return pd.Series([None if c is None else ((b[at, np.asarray(c)].ravel() + 0.5) / scale).tolist() for c in code])

    return codes.select("id", of("codes").alias("vector"))


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    text = "" if books is None else ",".join(map(str, books.ravel().tolist()))
    digest = hashlib.sha256(text.encode()).hexdigest()
    # Spark's own measure decides whether the label sums are broadcast; a hot label is split otherwise.
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    code = F.array_join(F.transform("codes", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """DuckDB: the rounds unrolled, every part against every entry."""
    first = f"""
with k as (select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select rid, pos, list_slice(v, pos * (len(v) // {PARTS}) + 1, (pos + 1) * (len(v) // {PARTS})) as x from k, (select unnest(range({PARTS})) as pos)),
c0 as (select pos, n - 1 as e, x as c from p join (select rid, row_number() over (order by vec_id) as n from k) using (rid) where n <= {ENTRIES})"""
    assign = lambda k: f""",
a{k} as (select rid, pos, arg_min(e, d * 1000 + e) as e, min(d) as d
         from (select rid, p.pos as pos, e, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint as d
               from p join c{k} on p.pos = c{k}.pos) group by rid, pos)"""  # noqa: E731
    update = lambda k: f""",
s{k} as (select pos, e, list(m order by j) as c from (
           select pos, e, j, (s - ((s % n) + n) % n) // n as m from (
             select pos, e, j, sum(x[j])::bigint as s, count(*)::bigint as n
             from (select pos, e, x, unnest(range(1, len(x) + 1)) as j from a{k} join p using (rid, pos)) group by pos, e, j)) group by pos, e),
c{k + 1} as (select pos, e, coalesce(s{k}.c, c{k}.c) as c from c{k} left join s{k} using (pos, e))"""  # noqa: E731
    rounds = "".join(assign(k) + update(k) for k in range(ROUNDS)) + assign(ROUNDS)
    return first + rounds + f""",
r as (select rid, string_agg(lpad(lower(hex(e)), 2, '0'), '' order by pos) as code, sum(d)::bigint as error from a{ROUNDS} group by rid),
h as (select sha256(coalesce(string_agg(array_to_string(c, ','), ',' order by pos, e), '')) as codebooks_sha256 from c{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from k join r using (rid), h
"""


ORACLE_SQL = _oracle()
