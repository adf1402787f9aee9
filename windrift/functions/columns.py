"""Column helpers: quoting awkward names (P5), null defaults (P12) and
timestamp parsing (F1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qcol(name: str) -> Column:
    """P5: reference a column whose name may hold dots, ``%`` or ``-``.

    Backticks make the whole string one identifier, so ``L.UL.Interference.Avg``
    is not read as a struct path (D10).
    """
    return F.col("`" + name.replace("`", "``") + "`")


def or_zero(c: Column | str) -> Column:
    """NULL aggregate → 0.0 (and only NULL: a real 0.0 stays 0.0, D19)."""
    col = qcol(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("double"), F.lit(0.0))


def parse_timestamp(c: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """string → timestamp by pattern; malformed text gives NULL, not an error."""
    col = qcol(c) if isinstance(c, str) else c
    return F.try_to_timestamp(col, F.lit(fmt))
