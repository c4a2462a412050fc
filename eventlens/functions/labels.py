"""Label expressions: segments, severity bands, trends, correlation strength."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

# Fixed values that must equal the source analysis for identical results:
# segment cut-off and its two labels, severity labels (strongest first) for
# |z| >= 4, 3, 2, 1, trend labels, correlation-strength cut-offs and labels.
SEGMENT_THRESHOLD = 3000
SEVERITY_LABELS = ("Extreme Outlier", "Strong Outlier", "Unusual", "Above Average", "Normal")
SEVERITY_BANDS = (4, 3, 2, 1)
TREND_LABELS = ("Escalating", "Declining", "Stable")
STRENGTH_CUTS = (0.3, 0.6)
STRENGTH_LABELS = ("weak", "moderate", "strong")


def segment_labels(threshold) -> tuple[str, str]:
    """(small, huge) labels for a numeric cut-off, e.g. 'Small (<3,000)'."""
    if isinstance(threshold, (int, float)):
        t = f"{threshold:,.0f}" if float(threshold).is_integer() else f"{threshold:,}"
        return f"Small (<{t})", f"Huge (≥{t})"
    return "Small", "Huge"


def segment(total, threshold=SEGMENT_THRESHOLD) -> Column:
    """'Huge (>=t)' when total >= threshold, else 'Small (<t)'.

    ``threshold`` may be a number or a Column (e.g. a scalar-subquery
    percentile, see `adaptive_threshold`). A NULL total falls to 'Small' like
    the source's CASE; callers filter NULL totals first.
    """
    small, huge = segment_labels(threshold)
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(col(total) >= t, F.lit(huge)).otherwise(F.lit(small))


def severity(z, bands=SEVERITY_BANDS, labels=SEVERITY_LABELS) -> Column:
    """Severity of |z|; NULL z (zero or undefined spread) is the last label."""
    a = F.abs(col(z))
    expr = None
    for b, lab in zip(bands, labels):
        expr = F.when(a >= b, lab) if expr is None else expr.when(a >= b, lab)
    return expr.otherwise(labels[len(bands)])


def direction(x) -> Column:
    """'above' / 'below' / 'at' the reference point by sign; NULL stays NULL."""
    x = col(x)
    return F.when(x > 0, "above").when(x < 0, "below").when(x == 0, "at")


def trend(first, last) -> Column:
    """Escalating when last > first, Declining when last < first, else Stable."""
    f, l = col(first), col(last)
    esc, dec, stable = TREND_LABELS
    return F.when(l > f, esc).when(l < f, dec).otherwise(stable)


def strength(r, cuts=STRENGTH_CUTS, labels=STRENGTH_LABELS) -> Column:
    a = F.abs(col(r))
    return F.when(a < cuts[0], labels[0]).when(a < cuts[1], labels[1]).when(a.isNotNull(), labels[2])


def relation(r) -> Column:
    r = col(r)
    return F.when(r > 0, "positive").when(r < 0, "inverse").when(r == 0, "none")
