"""Reshaping, imputation and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrift.functions.columns import qcol
from windrift.operators.ordering import row_hash, take_first_by_hash


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
            var: str = "feature", val: str = "value") -> DataFrame:
    """P14 (forward): columns → rows, ``(ids…, feature, value)``."""
    return df.unpivot(list(ids), list(values), var, val)


def to_wide(long: DataFrame, ids: Sequence[str], features: Sequence[str],
            var: str = "feature", val: str = "value") -> DataFrame:
    """P14 (back): rows → columns; the feature list is given so the pivot
    needs no extra pass to discover its values."""
    return long.groupBy(*ids).pivot(var, list(features)).agg(F.first(val))


def row_mean_impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P15 (D39): a missing cell takes the mean of the non-missing cells of its
    own row; a row with none stays NULL.  Pure array expressions."""
    arr = F.array(*[qcol(c).cast("double") for c in cols])
    present = F.filter(arr, lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.when(F.size(present) > 0, total / F.size(present))
    out = df.withColumn("_row_mean", mean)
    for c in cols:
        out = out.withColumn(c, F.coalesce(qcol(c).cast("double"), F.col("_row_mean")))
    return out.drop("_row_mean")


def hash_split(df: DataFrame, keys: Sequence[str], train_share: float = 0.8, seed: int = 42,
               flag: str = "is_train") -> DataFrame:
    """Stable seeded split: a row is in training when its key hash falls
    in the first ``train_share`` of 10 000 buckets.  Unlike ``randomSplit``
    it does not depend on partitioning, so retries give the same split."""
    bucket = F.pmod(row_hash(seed, *keys), F.lit(10_000))
    return df.withColumn(flag, bucket < F.lit(int(round(train_share * 10_000))))


def keep_first_share(df: DataFrame, share: float, keys: Sequence[str], seed: int = 42,
                     n: int | None = None) -> DataFrame:
    """Exactly ``int(n·share)`` rows, first in seeded hash order."""
    total = df.count() if n is None else n
    return take_first_by_hash(df, int(total * share), seed, keys)


def first_columns(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """P19 (columns): the first ``k`` of ``cols``."""
    return df.select(*[qcol(c) for c in list(cols)[:k]])
