"""Quality rules: a threshold table compiled into one Spark projection.

No user function and no shuffle: every text is measured and judged in its own
row with SQL functions, so the plan is a scan and projections at any size.

Defined cases: a null text counts as empty (no words, fails `min_words`); an
empty table gives an empty table; repeated rows are judged alike, one result
row each; a text of any length is measured whole. 3-word windows are compared
by a 64-bit hash within one text. `measure` reads the id and text columns
only, so other columns of any name cannot clash; `keep` returns the columns it
was given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD

SYMBOLS = "[#*$%&|<>]"
LATIN_WORD = "[A-Za-z]" + WORD.removesuffix("+") + "*"  # from a word's first Latin letter to its end: one match for each such word
BLANKS = " \t\n\x0b\x0c\r"

# Frequent function words of English, French, German and Spanish; then of Italian, Portuguese, Dutch, Scandinavian
# languages, Finnish, Polish, Czech, Hungarian, Romanian, Turkish, Indonesian and Vietnamese.
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "for", "it",
              "le", "la", "les", "de", "des", "et", "en", "un", "une", "que",
              "der", "die", "das", "und", "zu", "den", "mit", "von", "ist",
              "el", "los", "las", "y", "con", "por", "se", "del",
              "il", "di", "che", "non", "per", "os", "em", "um", "uma", "para", "het", "een", "van", "niet", "och", "att", "som", "og", "det", "er",
              "ja", "on", "ei", "nie", "na", "jest", "do", "je", "v", "az", "egy", "nem", "și", "cu", "ve", "bir", "bu", "yang", "dan", "ini", "là", "của", "không")


@dataclass(frozen=True)
class Rule:
    """Reject when 100 * metric is beyond `percent` * per (`per` None: beyond `percent` itself)."""
    name: str
    metric: str
    beyond: str  # "<" or ">"
    percent: int
    per: str | None
    base: bool = False

    def sql(self) -> str:
        return (f"{self.metric} {self.beyond} {self.percent}" if self.per is None
                else f"100 * {self.metric} {self.beyond} {self.percent} * {self.per}")


#: The threshold table. All comparisons are between whole numbers.
RULES = (
    Rule("min_words", "n_words", "<", 50, None, base=True),
    Rule("repeated_words", "n_repeat_words", ">", 50, "n_words", base=True),
    Rule("symbols", "n_symbols", ">", 25, "n_words"),
    Rule("short_words", "word_chars", "<", 200, "n_words"),
    Rule("long_words", "word_chars", ">", 2000, "n_words"),
    Rule("stop_words", "n_stop_words", "<", 1, "n_latin_words"),  # other scripts have no such words and pass
    Rule("letter_words", "n_letter_words", "<", 60, "n_words"),
    Rule("duplicate_lines", "n_dup_lines", ">", 60, "n_lines"),
)
METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_latin_words", "n_letter_words", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """`body` of a value computed once (a lambda variable, so it is not computed again for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(windows: Column) -> Column:
    """Words inside the 3-word windows whose hash occurs twice or more; windows in text order."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s):
        at = lambda k: F.get(s, k)["h"]
        same = lambda x, k: F.coalesce(at(k - 1) == x["h"], F.lit(False)) | F.coalesce(at(k + 1) == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def total(p):
        steps = F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
        _let(_let(placed, repeated), total))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the metrics, `failed` (names of the rules it breaks), base_failed, kept."""
    return _judged(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), [id_col])


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with the columns they came with."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    judged = _judged(docs.select(row, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")), ["_row"])
    # The number keeps Catalyst from pushing the filter below the projection, where it would compute the
    # metrics again for every mention of one.
    judged = judged.select("_row", "kept", F.monotonically_increasing_id().alias("_at"))
    return judged.where("kept and _at >= 0").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def _judged(df: DataFrame, own: list[str]) -> DataFrame:
    text, w = F.col("_text"), F.col("_words")
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    df = df.select(*own, "_text", words.alias("_words"), lines.alias("_lines"))
    n = F.size(w)
    windows = F.when(n < 3, F.array().cast("array<long>")).otherwise(F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    count = lambda c, name: c.cast("long").alias(name)
    df = df.select(
        *own, count(n, "n_words"), count(F.length(F.array_join(w, "")), "word_chars"),
        count(F.regexp_count(text, F.lit(SYMBOLS)), "n_symbols"),
        count(F.size("_lines"), "n_lines"), count(F.size("_lines") - F.size(F.array_distinct("_lines")), "n_dup_lines"),
        count(F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))), "n_stop_words"),
        count(F.regexp_count(text, F.lit(LATIN_WORD)), "n_latin_words"),
        count(F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))), "n_letter_words"),
        windows.alias("_windows"))
    df = df.select(*own, *METRICS[:-1], _covered(F.col("_windows")).alias("n_repeat_words"))
    broken = F.filter(F.array(*[F.when(F.expr(r.sql()), F.lit(r.name)) for r in RULES]), lambda x: x.isNotNull())
    base = F.arrays_overlap(F.col("failed"), F.array(*[F.lit(r.name) for r in RULES if r.base]))
    return df.select("*", broken.alias("failed")).select("*", base.alias("base_failed"), (F.size("failed") == 0).alias("kept"))


_RULES_SQL = " or ".join(f"({r.sql()})" for r in RULES)
_BASE_SQL = " or ".join(f"({r.sql()})" for r in RULES if r.base)

#: DuckDB: the same metrics by another road (words and windows as rows).
ORACLE_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, unnest(range(1, len(l) + 1)) as i, unnest(l) as word
      from (select rid, regexp_extract_all(t, '[^ 	-
]+') as l from d)),
v as (select rid, i, word, lead(word, 1) over o as b, lead(word, 2) over o as c from w window o as (partition by rid order by i)),
g as (select rid, i, count(*) over (partition by rid, word, b, c) as n from v where c is not null),
r as (select rid, count(distinct i + k) as n_repeat_words from g, (select unnest([0, 1, 2]) as k) where n > 1 group by rid),
s as (select rid, count(*) as n_words, sum(length(word)) as word_chars,
             count(*) filter (where lower(word) in ({", ".join(f"'{x}'" for x in STOP_WORDS)})) as n_stop_words,
             count(*) filter (where regexp_matches(word, '[A-Za-z]')) as n_latin_words,
             count(*) filter (where regexp_matches(word, '\pL')) as n_letter_words from w group by rid),
l as (select rid, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines
      from (select rid, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^ 	-
]') group by rid),
m as (select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0)::bigint as word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines,
             coalesce(n_stop_words, 0) as n_stop_words, coalesce(n_latin_words, 0) as n_latin_words, coalesce(n_letter_words, 0) as n_letter_words, coalesce(n_repeat_words, 0) as n_repeat_words
      from d left join s using (rid) left join l using (rid) left join r using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_BASE_SQL}) as base_failed, not ({_RULES_SQL}) as kept from m
"""


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
