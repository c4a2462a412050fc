"""URL filters: allow and block rules on hosts and path prefixes.

Every URL is expanded into host-suffix and path-prefix expressions, as
blocklists of hash prefixes are queried: the expressions' short hash prefixes
are joined with those of the rules, hits are confirmed by the full digests, and
the longest confirmed rule decides. An expression is only made in the shapes
(host length, path length) that some rule has, so their number depends on the
rules, never on the length of a URL, and no fitting rule is missed.

* The host is what follows the first "://" up to "/", "?", "#" or the end, A-Z
  lower-cased; the path goes on up to "?", "#" or the end.
* A rule fits its host and all subdomains if the path starts with the rule's.
  The longest host + path wins, then the longer host, then block.
* Rules are broadcast only when measured below `BROADCAST_BYTES`; larger ones
  are joined by shuffle, the URLs of a hot prefix spread over `SALTS` tasks.

Only SQL functions; page rows carry a number of their own through the joins,
so equal or null ids never meet in one task.

Defined cases: a null URL and one without "://" have an empty host and path;
where no rule fits, `rule` is null and the verdict is `default`. A null rule
host or path counts as empty; an empty host is a suffix of empty hosts and of
hosts that end in a dot. Equal rules count once, block before allow. Repeated
pages are judged alike, one result row each; an empty table gives an empty
table, no rules leave every page to `default`. `judge` reads the id and URL
columns only; `keep` returns the columns it was given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

#: (verdict, host, path) of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BROADCAST_BYTES = 32 << 20
SALTS = 32
#: Hex digits of the short hash prefix (32 bits).
SHORT = 8

_SHAPES = "array<struct<host:int,paths:array<int>>>"


def rules_frame(spark, rules=RULES) -> DataFrame:
    """The rules (verdict, host, path) as a frame."""
    lit = lambda v: F.lit(v).cast("string")
    rows = [F.struct(lit(v).alias("verdict"), lit(h).alias("host"), lit(p).alias("path")) for v, h, p in rules]
    made = F.array(*rows) if rows else F.array().cast("array<struct<verdict:string,host:string,path:string>>")
    return spark.range(1).select(F.inline(made))


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def _digest(host: Column, path: Column) -> Column:
    """Digest of one expression; the host's length keeps host and path apart."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def _listed(rules: DataFrame) -> DataFrame:
    """Rules ready to be joined: short, digest, and `won`, a struct whose greatest is the winner."""
    host, path = ascii_lower(F.coalesce(F.col("host"), F.lit(""))), F.coalesce(F.col("path"), F.lit(""))
    r = rules.select(host.alias("h"), path.alias("p"), "verdict")
    won = F.struct((F.length("h") + F.length("p")).alias("size"), F.length("h").alias("host_size"),
                   (F.col("verdict") == "block").alias("blocks"), F.concat("h", "p").alias("rule"))
    r = r.select("h", "p", won.alias("won")).groupBy("h", "p").agg(F.max("won").alias("won"))
    return r.select("h", "p", _digest(F.col("h"), F.col("p")).alias("digest"), "won")


def _shapes(listed: DataFrame) -> Column:
    """The lengths that rules have, as a literal: a row per host length, each with its path lengths (texts are no part of it)."""
    rows = (listed.groupBy(F.length("h").alias("host")).agg(F.sort_array(F.collect_set(F.length("p"))).alias("paths"))
            .orderBy("host").collect())
    made = [F.struct(F.lit(r["host"]).alias("host"), F.array(*[F.lit(n) for n in r["paths"]]).alias("paths")) for r in rows]
    return F.array(*made).cast(_SHAPES) if made else F.array().cast(_SHAPES)


def _expressions(host: Column, path: Column, shapes: Column) -> Column:
    """Digests of all host-suffix and path-prefix expressions in the shapes of the rules."""
    size = F.length(host)
    whole_label = lambda s: (s["host"] == size) | ((s["host"] < size) & (F.substr(host, size - s["host"], F.lit(1)) == "."))
    suffix = lambda n: F.substr(host, size - n + 1, n)
    each = lambda s: F.transform(F.filter(s["paths"], lambda n: n <= F.length(path)),
                                 lambda n: _digest(suffix(s["host"]), F.substr(path, F.lit(1), n)))
    return F.flatten(F.transform(F.filter(shapes, whole_label), each))


def _winners(urls: DataFrame, key: list[str], rules: DataFrame, broadcast_bytes: int) -> DataFrame:
    """`key` columns and `won` of the rows of `urls` (key, host, path) that a rule fits, one row for each distinct key."""
    listed = cut(_listed(rules))
    size = listed.agg(F.sum(F.octet_length("h") + F.octet_length("p") + 200)).first()[0] or 0
    found = urls.select(*key, F.explode(_expressions(F.col("host"), F.col("path"), _shapes(listed))).alias("_digest"))
    found = found.withColumn("_short", F.substring("_digest", 1, SHORT))
    listed = listed.select(F.substring("digest", 1, SHORT).alias("short"), "digest", "won")
    on = (F.col("_short") == F.col("short")) & (F.col("_digest") == F.col("digest"))
    if size <= broadcast_bytes:
        hits = found.join(F.broadcast(listed), on)
    else:
        salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = found.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")).join(
            salted, on & (F.col("_salt") == F.col("salt")))
    return hits.groupBy(*key).agg(F.max("won").alias("won"))


def _verdict(default: str) -> Column:
    return F.when(F.col("won").isNull(), F.lit(default)).when(F.col("won.blocks"), F.lit("block")).otherwise(F.lit("allow"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: id, host, path, rule (host + path of the one that decides, else null), verdict."""
    host, path = host_path(F.col(f"`{url_col}`"))
    urls = cut(pages.select(F.col(f"`{id_col}`").alias("_id"), host.alias("host"), path.alias("path"))
               .withColumn("_row", F.monotonically_increasing_id()))
    won = _winners(urls.select(F.col("_row").alias("_hit"), "host", "path"), ["_hit"], rules, broadcast_bytes)
    return (urls.join(won, F.col("_row") == F.col("_hit"), "left")
            .select(F.col("_id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"), _verdict(default).alias("verdict")))


def keep(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
         broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The pages whose verdict is allow, with the columns they came with.

    Verdicts are found once for each distinct address (host and path); the
    pages are joined with the short side of them, blocked or allowed by a rule.
    """
    names = pages.columns
    rows = pages.toDF(*[f"_c{i}" for i in range(len(names))])
    host, path = host_path(F.col(f"_c{names.index(url_col)}"))
    rows = rows.withColumns({"_host": host, "_path": path})
    urls = rows.select(F.col("_host").alias("host"), F.col("_path").alias("path")).distinct()
    won = _winners(urls, ["host", "path"], rules, broadcast_bytes).withColumn("verdict", _verdict(default))
    decided = won.where("verdict = 'block'" if default == "allow" else "verdict = 'allow'").select("host", "path")
    on = (F.col("_host") == F.col("host")) & (F.col("_path") == F.col("path"))
    rows = rows.join(decided, on, "left_anti" if default == "allow" else "left_semi")
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def op11_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules_frame(spark))


_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

#: DuckDB: every URL against every rule by its definition, no hashes.
ORACLE_SQL = rf"""
with r as (select * from (values {_RULES_SQL}) t(v, h, p)),
u as (select row_number() over () as rid, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
a as (select rid, page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
b as (select rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from a),
f as (select rid, h || p as rule, v, row_number() over (partition by rid order by length(h || p) desc, length(h) desc, v desc) as n
      from b join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from b left join (select * from f where n = 1) using (rid)
"""
