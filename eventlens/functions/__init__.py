"""Column-expression helpers (built-in Spark functions only)."""

from .labels import (  # noqa: F401
    SEGMENT_THRESHOLD,
    direction,
    relation,
    segment,
    segment_labels,
    severity,
    strength,
    trend,
)
from .numeric import col, decimal_ratio, idiv, int_avg, pct_ratio, percent, ratio, safe_div, scaled  # noqa: F401
from .text import collapse, is_token, null_token, strip_chars, strip_suffix_on_prefix, token_to_label  # noqa: F401
