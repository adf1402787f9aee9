"""Drift bands and advice (F7-F11) as CASE expressions.

Each policy is a list of (upper bound, text): a value below the first bound
gets the first text, and so on, bounds half-open (``value < bound``).  The
last entry has bound ``None`` (no upper limit).  NULL scores give NULL text,
except where a policy says a missing score counts as 0 (D36).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from windrift.functions.columns import qcol

Policy = list[tuple[float | None, str]]

# Band texts for the loading-based score (dP), cuts 10/30/50/70.
DP_BANDS: Policy = [
    (10.0, "Very Low Drift - Covariance structure highly similar"),
    (30.0, "Low Drift - Minor changes in covariance structure"),
    (50.0, "Moderate Drift - Noticeable changes detected"),
    (70.0, "High Drift - Significant structural changes"),
    (None, "Very High Drift - Major version update recommended"),
]

# Band texts for the reconstruction scores (dE_PCA, dE_AE).
DE_BANDS: Policy = [
    (10.0, "Very Low Drift - Data highly similar"),
    (30.0, "Low Drift - Minor changes in distribution"),
    (50.0, "Moderate Drift - Data still recognizable"),
    (70.0, "High Drift - Substantial differences"),
    (None, "Very High Drift - Data drastically different (like random noise)"),
]

# Version advice from dE_PCA, cuts 30/70 (report printer).
VERSION_PRINTER: Policy = [
    (30.0, "Minor version update (0.X.0)"),
    (70.0, "Consider minor version update, review changes"),
    (None, "Major version update recommended (X.0.0)"),
]

# Version advice of the written guide, cuts 30/50.
VERSION_GUIDE: Policy = [
    (30.0, "minor update"),
    (50.0, "review: minor or major update"),
    (None, "major update"),
]

# Action list, cuts 10/30/50.
ACTIONS: Policy = [
    (10.0, "very low drift: no action needed"),
    (30.0, "low to moderate drift: minor version update, monitor trends, document changes"),
    (50.0, "moderate drift: review data quality, consider retraining, update documentation"),
    (None, "high drift: major version update, investigate causes, retrain models, update data jobs"),
]

# Verdict on dE_PCA, cuts 30/50.
VERDICT: Policy = [
    (30.0, "confirmed"),
    (50.0, "medium"),
    (None, "high"),
]

POLICIES: dict[str, Policy] = {
    "dp": DP_BANDS, "de": DE_BANDS, "printer": VERSION_PRINTER,
    "guide": VERSION_GUIDE, "actions": ACTIONS, "verdict": VERDICT,
}


def band(value: Column | str, policy: Policy | str, missing_as_zero: bool = False) -> Column:
    """Map a 0-100 score to the text of its band."""
    pol = POLICIES[policy] if isinstance(policy, str) else policy
    v = qcol(value) if isinstance(value, str) else value
    if missing_as_zero:
        v = F.coalesce(v, F.lit(0.0))
    expr = None
    for bound, text in pol:
        if bound is None:
            expr = expr.otherwise(F.lit(text)) if expr is not None else F.lit(text)
            break
        cond = v < F.lit(bound)
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(expr)


def metric_band(metric: Column | str, value: Column | str) -> Column:
    """band by metric type: ``dP`` uses the loading texts, others the
    reconstruction texts."""
    m = F.col(metric) if isinstance(metric, str) else metric
    return F.when(m == F.lit("dP"), band(value, DP_BANDS)).otherwise(band(value, DE_BANDS))
