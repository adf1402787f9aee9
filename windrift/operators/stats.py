"""Per-feature comparison of a reference and a current dataset
(A10-A13, J3, F5, F6, F12).

Both sides are one aggregate over the table that holds them, by a flag; its single
row is turned to one row per feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrift.functions.columns import qcol
from windrift.functions.scalar import change_pct, mean_change_flag, round2


_STATS = {"mean": F.avg, "std": F.stddev_samp}


def _stacked(df: DataFrame, cols: Sequence[str], made: dict) -> DataFrame:
    """One aggregate row of ``made[name](column)`` per column, turned to one row
    per feature: ``(j, feature, *made)``."""
    wide = df.agg(*[fn(qcol(c)).alias(f"_{name}{j}") for j, c in enumerate(cols) for name, fn in made.items()])
    rows = [F.struct(F.lit(j).alias("j"), F.lit(c).alias("feature"), *[F.col(f"_{n}{j}").alias(n) for n in made])
            for j, c in enumerate(cols)]
    return wide.select(F.inline(F.array(*rows)))


def _both_sides(df: DataFrame, is_ref: Column, cols: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """``(j, feature, ref_<stat>, cur_<stat>)``: both sides in one aggregate over the table that holds them."""
    sides = df.select(*[qcol(c) for c in cols], is_ref.alias("_ref"))

    def on(side, fn):
        return lambda c: fn(F.when(F.col("_ref") == F.lit(side), c))

    made = {f"{name}_{stat}": on(side, _STATS[stat]) for stat in stats for name, side in (("ref", True), ("cur", False))}
    return _stacked(sides, cols, made)


def two_sides(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Two datasets as one table with ``is_ref``; a single table that has both needs only its flag."""
    return ref.select(*[qcol(c) for c in cols], F.lit(True).alias("is_ref")).unionByName(
        cur.select(*[qcol(c) for c in cols], F.lit(False).alias("is_ref")))


def compare_stat(df: DataFrame, cols: Sequence[str], stat: str = "mean", rounded: bool = True, is_ref: str = "is_ref") -> DataFrame:
    """A10 (``mean``) / A11 (``std``, sample std, D38): reference, current and
    change % per feature (J3 aligns the two sides by feature)."""
    both = _both_sides(df, F.col(is_ref), cols, [stat])
    out = both.select("j", "feature", F.col(f"ref_{stat}").alias("reference"), F.col(f"cur_{stat}").alias("current"))
    out = out.withColumn("change_pct", change_pct("current", "reference"))
    if rounded:
        out = out.select("j", "feature", *[round2(x).alias(x) for x in ("reference", "current", "change_pct")])
    return out


def align_stats(df: DataFrame, cols: Sequence[str], is_ref: str = "is_ref") -> DataFrame:
    """Mean and std of both sides in one table, by feature."""
    return _both_sides(df, F.col(is_ref), cols, ["mean", "std"]).select(
        "feature", "j", "ref_mean", "cur_mean", "ref_std", "cur_std")


def mean_flags(df: DataFrame, cols: Sequence[str], threshold: float = 10.0, is_ref: str = "is_ref") -> DataFrame:
    """features whose mean moved by more than ``threshold`` percent."""
    cmp = compare_stat(df, cols, "mean", False, is_ref)
    return cmp.select("j", "feature", "change_pct", mean_change_flag("change_pct", threshold).alias("flagged"))


def scaler_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(j, feature, mean, std)`` with the population std."""
    return _stacked(df, cols, {"mean": F.avg, "std": F.stddev_pop}).select("j", "feature", "mean", "std")


def dataset_shape(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(n_rows, n_features)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_features", F.lit(len(cols)))
