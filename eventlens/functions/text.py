"""String cleaning expressions (all built-in Spark functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

# Fixed values of the source cleaning rules: the null token, the label for a
# token-valued stage, the country prefix whose trailing dot is stripped, the
# category prefix collapsed to one label, and the invisible characters
# (no-break space, carriage return, line feed) removed from numeric text.
NULL_TOKEN = "NULL"
UNKNOWN = "Unknown"
COUNTRY_PREFIX = "united state"
COLLAPSE_RULES = {"crypto": "Crypto"}
INVISIBLE = "\u00a0\r\n"


def is_token(c, tokens=(NULL_TOKEN,)) -> Column:
    """Case-insensitive match against literal null tokens ('NULL', 'Null', ...)."""
    u = F.upper(col(c))
    return u.isin([t.upper() for t in tokens])


def null_token(c, tokens=(NULL_TOKEN,)) -> Column:
    """Token or real NULL -> NULL."""
    c = col(c)
    return F.when(c.isNull() | is_token(c, tokens), F.lit(None).cast("string")).otherwise(c)


def token_to_label(c, label=UNKNOWN, tokens=(NULL_TOKEN,)) -> Column:
    """Token -> label; a real NULL stays NULL (three-valued CASE)."""
    c = col(c)
    return F.when(is_token(c, tokens), F.lit(label)).otherwise(c)


def strip_suffix_on_prefix(c, prefix=COUNTRY_PREFIX, chars=".") -> Column:
    """If c starts with ``prefix`` (case-insensitive) strip trailing ``chars``
    only; otherwise trim spaces."""
    c = col(c)
    return F.when(F.lower(c).startswith(prefix.lower()), F.rtrim(c, F.lit(chars))).otherwise(F.trim(c))


def collapse(c, rules=None) -> Column:
    """Values starting with a rule's prefix (case-insensitive) -> its label."""
    rules = COLLAPSE_RULES if rules is None else rules
    c = col(c)
    expr = None
    for prefix, label in rules.items():
        cond = F.lower(c).startswith(prefix.lower())
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return c if expr is None else expr.otherwise(c)


def strip_chars(c, chars=INVISIBLE) -> Column:
    """Remove every listed character in one pass (translate to nothing)."""
    return F.translate(col(c), chars, "")
