"""Secret scans over a trigram inverted index.

Each rule is a regular expression. A Boolean query over trigrams that every
match must contain is derived from it: an AND of segments, each an OR of
literal strings, each the AND of its trigrams. The index holds, for the
trigrams that the rules ask for, the documents that contain them (text
lower-cased A-Z); postings are intersected per rule, and only candidates are
verified with the regular expression itself. A rule without mandatory
trigrams (the hex rule) scans every text.

SQL functions only: postings come from `contains`, intersections are grouped
counts, spans come from `split` and `regexp_extract_all`. Of the texts only
those are shuffled that contain, for some rule, the rarest trigram of one of
its strings; the index says which trigram that is.

Defined cases: a null text counts as empty and has no spans; repeated rows
have one result row each; an empty table gives an empty table; positions are
code points of the whole text, ends exclusive. Only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

try:
    from re import _constants as rc
    from re import _parser as rp
except ImportError:  # Python before 3.11
    import sre_constants as rc
    import sre_parse as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """`regex` finds, leftmost non-overlapping; a match counts if `group` of it has `least` characters or more."""
    kind: str
    regex: str
    group: int = 0
    least: int = 0


# The formats of the three base kinds, then public token formats.
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)


# --- from a regular expression to a Boolean trigram query -------------------------------

def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def _one(op, arg) -> set[str] | None:
    """The strings an element can match, lower-cased, if they are few; else None."""
    if op is rc.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}
    if op is rc.IN:
        out: set[str] = set()
        for kind, x in arg:
            chars = [x] if kind is rc.LITERAL else range(x[0], x[1] + 1) if kind is rc.RANGE else None
            if chars is None or len(chars) > MAX_STRINGS:
                return None
            out |= {chr(c).lower() if c < 128 else chr(c) for c in chars}
        return out if len(out) <= 8 else None
    if op is rc.SUBPATTERN:
        return _strings(arg[-1])
    if op is rc.BRANCH:
        found = [_strings(b) for b in arg[1]]
        return None if any(f is None for f in found) else set().union(*found)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] != rc.MAXREPEAT and arg[1] <= 4:
        each = _strings(arg[2])
        if each is None:
            return None
        out = {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(each, repeat=n)}
        return out if len(out) <= MAX_STRINGS else None
    return None


def _strings(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        one = _one(op, arg)
        if one is None or len(out) * len(one) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def _segments(items) -> list[set[str]]:
    """Sets of strings, one of each of which must stand in every match."""
    out, run = [], {""}
    for op, arg in items:
        one = _one(op, arg)
        if one is not None and len(run) * len(one) <= MAX_STRINGS:
            run = {a + b for a in run for b in one}
            continue
        out.append(run)
        run = {""}
        if one is not None:
            run = one
        elif op is rc.SUBPATTERN:
            out += _segments(arg[-1])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
            out += _segments(arg[2])
    return [*out, run]


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """AND of OR of AND of trigrams, true of every (lower-cased) text with a match; empty if nothing is mandatory."""
    query = []
    for strings in _segments(rp.parse(regex)):
        alts = {trigrams(s) for s in strings}
        if all(alts):  # a string below three characters makes the segment void
            query.append(sorted((a for a in alts if not any(b < a for b in alts)), key=sorted))
    return query


# --- index, intersection, verification --------------------------------------------------

def _low(text: str = "_text") -> Column:
    return ascii_lower(F.col(text))


def build_index(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Postings (tri, _id, _key) of the wanted trigrams; `rows` has _id, _key, _text."""
    low = rows.select("_id", "_key", _low().alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in wanted]))
    return low.select("_id", "_key", F.explode(held).alias("tri")).distinct()


def candidates(spark, postings: DataFrame, queries: dict[str, list[list[frozenset[str]]]]) -> DataFrame:
    """(_id, _key, kinds): the documents in the intersected postings of each rule."""
    q = [(kind, s, a, t, len(alt), len(query)) for kind, query in queries.items() for s, alts in enumerate(query) for a, alt in enumerate(alts) for t in sorted(alt)]
    rows = spark.createDataFrame(q, "kind string, seg int, alt int, tri string, need int, segs int")  # the rule table, fixed in size
    return (postings.join(F.broadcast(rows), "tri")
            .groupBy("_id", "_key", "kind", "seg", "alt", "need", "segs").count().where("count = need")
            .groupBy("_id", "_key", "kind", "segs").agg(F.count_distinct("seg").alias("got")).where("got = segs")
            .groupBy("_id", "_key").agg(F.collect_set("kind").alias("kinds")))


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, end, no>>: the rule's matches, in order."""
    rx = F.lit(rule.regex)
    pieces, found = F.split(text, rule.regex, -1), F.regexp_extract_all(text, rx, F.lit(0))
    held = F.regexp_extract_all(text, rx, F.lit(rule.group))
    step = F.arrays_zip(pieces.alias("p"), found.alias("m"), held.alias("g"))
    no = F.lit(place)
    empty = F.array().cast("array<struct<start:int,end:int,no:int,held:int>>")

    def add(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), no.alias("no"), F.length(x["g"]).alias("held")))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    spans = F.aggregate(step, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])
    return F.when(F.size(found) == 0, empty).otherwise(F.filter(spans, lambda s: s["held"] >= rule.least))


def _with_spans(rows: DataFrame, rules: tuple[Rule, ...], full: list[Rule], indexed: list[Rule]) -> DataFrame:
    """Add `_spans` of the full-scan rules, and of the indexed rules whose kind is in the column `kinds`."""
    text = F.col("_text")
    empty = F.array().cast("array<struct<start:int,end:int,no:int,held:int>>")
    parts = [F.when(text.rlike(r.regex), _spans(text, r, rules.index(r))).otherwise(empty) for r in full]
    parts += [F.when(F.array_contains("kinds", r.kind), _spans(text, r, rules.index(r))).otherwise(empty) for r in indexed]
    order = lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"))
    return rows.select("_id", F.sort_array(F.transform(F.concat(*parts), order)).alias("_spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and `spans`, array<struct<start, no, end>>, no the rule's place in `rules`, by start, then rule."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    full, indexed = [r for r in rules if r.kind not in queries], [r for r in rules if r.kind in queries]
    if not indexed:
        return _with_spans(rows.withColumn("kinds", F.array().cast("array<string>")), rules, full, []).withColumnsRenamed({"_id": id_col, "_spans": "spans"})
    wanted = sorted({t for q in queries.values() for alts in q for alt in alts for t in alt})
    postings = cut(build_index(rows, wanted))
    n = {r["tri"]: r["count"] for r in postings.groupBy("tri").count().collect()}  # one row per wanted trigram
    may = set()
    for q in queries.values():
        rarest = [{min(alt, key=lambda t: (n.get(t, 0), t)) for alt in alts} for alts in q]
        may |= min(rarest, key=lambda ts: sum(n.get(t, 0) for t in ts))
    # one pass over the text for all of them; (?i) folds A-Z only
    rows = rows.withColumn("_may", F.col("_text").rlike("(?i)" + "|".join(rf"\Q{t}\E" for t in sorted(may))))
    cands = candidates(spark, postings, queries).withColumnsRenamed({"_id": "_i", "_key": "_k"})
    some = rows.where("_may").join(cands, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    some = some.withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    out = _with_spans(some, rules, full, indexed).unionByName(_with_spans(rows.where("not _may"), rules, full, []))
    return out.withColumnsRenamed({"_id": id_col, "_spans": "spans"})


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    said = lambda s: F.concat_ws(":", F.get(kinds, s["no"]), s["start"], s["end"])
    of = lambda no: F.size(F.filter("spans", lambda s: s["no"] == no)).cast("long")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *[of(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda s: s["no"] < len(BASE_KINDS)), said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"))


def _oracle() -> str:
    """DuckDB: every rule scans every text; match starts are sums of the pieces before them."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    one = [f"""select rid, {i} as no, '{r.kind}' as kind, unnest(range(1, len(m) + 1)) as k, p, m, g from
      (select rid, string_split_regex(t, {quote(r.regex)}) as p, regexp_extract_all(t, {quote(r.regex)}) as m,
              regexp_extract_all(t, {quote(r.regex)}, {r.group}) as g from d where regexp_matches(t, {quote(r.regex)}))""" for i, r in enumerate(RULES)]
    least = " ".join(f"when {i} then {r.least}" for i, r in enumerate(RULES))
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
f as ({" union all ".join(one)}),
s as (select rid, no, kind, length(array_to_string(p[1:k], '') || array_to_string(m[1:k - 1], '')) as a, length(m[k]) as n
      from f where length(g[k]) >= case no {least} end),
j as (select rid, count(*) filter (where no = 0) as n_assign, count(*) filter (where no = 1) as n_access, count(*) filter (where no = 2) as n_hex,
             string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, no) filter (where no < {len(BASE_KINDS)}) as base,
             string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, no) as spans from s group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join j using (rid)
"""


ORACLE_SQL = _oracle()
