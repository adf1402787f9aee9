"""Grouped moments (G1) and reconstruction error from moments.

G1 is the one pass over the data every drift score needs.  Each task turns
its Arrow batches into NumPy blocks and keeps, per group key, the count, the
mean and the centred scatter ``M2 = Σ(x-mean)(x-mean)ᵀ`` of the rows it has
read.  Partial results are merged with the pairwise formula of Chan, Golub
and LeVeque (``M2 = M2a + M2b + na·nb/n · δδᵀ``), which stays exact for data
with large means: no raw cross product of big values is ever formed.

The merge has three levels, none of which moves data rows:

1. inside each task (one packed array per group it saw);
2. salted: arrays hash-partitioned by (group, task id mod ⌈√tasks⌉);
3. per group: the ≤ ⌈√tasks⌉ arrays of each group in one task.

So a group holding a third of all rows costs no more than any other: its rows
are reduced in the tasks that read them.  The driver receives one array of
``2 + d + d(d+1)/2`` doubles per group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.functions.columns import qcol

GROUP_ALL = "__all__"


def _pack(n: float, mean: np.ndarray, m2: np.ndarray, sums: np.ndarray, iu, ju) -> np.ndarray:
    return np.concatenate([[n], mean, m2[iu, ju], sums])


def _unpack(vec: np.ndarray, d: int, iu, ju) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    n = float(vec[0])
    mean = np.asarray(vec[1:1 + d], dtype=np.float64)
    m2 = np.zeros((d, d))
    m2[iu, ju] = vec[1 + d:1 + d + len(iu)]
    m2[ju, iu] = m2[iu, ju]
    return n, mean, m2, np.asarray(vec[1 + d + len(iu):], dtype=np.float64)


def _combine(a, b):
    """Chan et al. pairwise update of (n, mean, M2, plain sums)."""
    na, ma, sa, da = a
    nb, mb, sb, db = b
    if na == 0:
        return nb, mb, sb, da + db
    if nb == 0:
        return na, ma, sa, da + db
    n = na + nb
    delta = mb - ma
    mean = ma + delta * (nb / n)
    m2 = sa + sb + np.outer(delta, delta) * (na * nb / n)
    return n, mean, m2, da + db


def _block_moments(x: np.ndarray, more=None):
    """Moments of the complete rows; sums: how many rows have a missing feature, then what ``more`` sums over the rest."""
    whole = x[~np.isnan(x).any(axis=1)]
    sums = np.append(float(len(x) - len(whole)), [] if more is None else more(whole))
    d = x.shape[1]
    if not len(whole):
        return 0.0, np.zeros(d), np.zeros((d, d)), sums
    mean = whole.mean(axis=0)
    c = whole - mean
    return float(len(whole)), mean, c.T @ c, sums


#: Groups that a task holds before it puts its partial moments out; the later levels merge partials anyway.
FLUSH_GROUPS = 4096


def _rows(acc: dict, salt: int, iu, ju) -> pd.DataFrame:
    return pd.DataFrame({"grp": list(acc), "salt": salt, "g": [_pack(*m, iu, ju) for m in acc.values()]})


def _task_moments(d: int, has_group: bool, more=None, variants=None):
    iu, ju = np.triu_indices(d)

    def run(batches):
        acc: dict[str, tuple] = {}
        salt = 0

        def add(g, x):
            part = _block_moments(x, more)
            acc[g] = _combine(acc[g], part) if g in acc else part

        for pdf in batches:
            if pdf.empty:
                continue
            salt = int(pdf["_pid"].iloc[0])
            first = 2 if has_group else 1
            x = pdf.iloc[:, first:first + d].to_numpy(dtype=np.float64, copy=False)
            if variants is not None:
                for name, changed in variants(x, pdf.iloc[:, first + d:]):
                    add(name, changed)
            elif has_group:
                code, names = pd.factorize(pdf["grp"], use_na_sentinel=False)
                order = np.argsort(code, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                    g = names[code[rows[0]]]
                    add(g if isinstance(g, str) else None, x[rows])  # the NULL group is a group
                if len(acc) >= FLUSH_GROUPS:
                    yield _rows(acc, salt, iu, ju)
                    acc.clear()
            else:
                add(GROUP_ALL, x)
        if acc:
            yield _rows(acc, salt, iu, ju)

    return run


def _merge(d: int):
    iu, ju = np.triu_indices(d)

    def run(batches):
        acc: dict[str, tuple] = {}
        for pdf in batches:
            for g, vec in zip(pdf["grp"], pdf["g"]):
                g = g if isinstance(g, str) else None
                m = _unpack(np.asarray(vec, dtype=np.float64), d, iu, ju)
                acc[g] = _combine(acc[g], m) if g in acc else m
        if acc:
            yield pd.DataFrame({"grp": list(acc), "g": [_pack(*m, iu, ju) for m in acc.values()]})

    return run


def moments_table(df: DataFrame, cols: Sequence[str], group: str | None = None,
                  merge_width: int | None = None, more=None, variants=None, given: Sequence[Column] = ()) -> DataFrame:
    """G1 as ``(grp, g)``: one packed ``(n, mean, upper(M2), dropped, *sums)`` per group.

    Rows with a NULL feature are left out of the moments (complete cases) and
    counted in ``dropped``; a NULL group key is a group of its own.  ``more`` sums
    further numbers over the same rows (a block of complete rows → an array), in the
    same pass.  ``variants`` makes the groups inside the task: (block, its ``given``
    columns) → (group, changed block) pairs, so each row is sent once."""
    d = len(cols)
    feats = [qcol(c).cast("double").alias(f"x{j}") for j, c in enumerate(cols)]
    sel = df.select(F.spark_partition_id().alias("_pid"),
                    *([F.col(group).cast("string").alias("grp")] if group else []), *feats, *given)
    width = merge_width or max(1, math.ceil(math.sqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    packed = T.StructType([T.StructField("grp", T.StringType()), T.StructField("salt", T.IntegerType()),
                           T.StructField("g", T.ArrayType(T.DoubleType()))])
    out = "grp string, g array<double>"
    level1 = sel.mapInPandas(_task_moments(d, group is not None, more, variants), packed)
    level2 = level1.repartition(width, "grp", F.pmod(F.col("salt"), F.lit(width))).mapInPandas(_merge(d), out)
    return level2.repartition(width, "grp").mapInPandas(_merge(d), out)


@dataclass
class Moments:
    """Count, mean and centred scatter of one group, as NumPy on the driver."""
    n: float
    mean: np.ndarray      # d
    scatter: np.ndarray   # d×d, Σ (x-mean)(x-mean)ᵀ
    sums: np.ndarray | tuple = (0.0,)  # rows with a missing feature, not in n; then what else was summed

    @property
    def dropped(self) -> float:
        return float(self.sums[0])

    @property
    def cov(self) -> np.ndarray:
        return self.scatter / max(self.n - 1.0, 1.0)

    @property
    def std_pop(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.scatter) / self.n, 0.0, None))

    def second_moment_about(self, mu: np.ndarray) -> np.ndarray:
        """``(1/n) Σ (x-mu)(x-mu)ᵀ``."""
        delta = self.mean - mu
        return self.scatter / self.n + np.outer(delta, delta)

    def scaled(self, mean: np.ndarray, std: np.ndarray) -> Moments:
        """Moments of ``(x - mean) / std`` (std 0 → 1), without another pass."""
        s = np.where(std == 0, 1.0, std)
        return Moments(self.n, (self.mean - mean) / s, self.scatter / np.outer(s, s), self.sums)

    def raw_sums(self) -> np.ndarray:
        """``[1, x]ᵀ[1, x]`` summed over rows: n, Σx and Σxxᵀ."""
        d = len(self.mean)
        g = np.zeros((d + 1, d + 1))
        g[0, 0] = self.n
        g[0, 1:] = g[1:, 0] = self.n * self.mean
        g[1:, 1:] = self.scatter + self.n * np.outer(self.mean, self.mean)
        return g


def collect_moments(table: DataFrame, d: int) -> dict[str, Moments]:
    """Bring the per-group packed moments to the driver (one small array each)."""
    iu, ju = np.triu_indices(d)
    out = {}
    for r in table.collect():
        n, mean, m2, sums = _unpack(np.asarray(r["g"], dtype=np.float64), d, iu, ju)
        if n > 0:
            out[r["grp"]] = Moments(n, mean, m2, sums)
    return out


def unpack_moments(vec, d: int) -> Moments:
    iu, ju = np.triu_indices(d)
    return Moments(*_unpack(np.asarray(vec, dtype=np.float64), d, iu, ju))


def group_moments(df: DataFrame, cols: Sequence[str], group: str | None = None) -> dict[str, Moments]:
    return collect_moments(moments_table(df, cols, group), len(cols))


def reconstruction_mse(m2: np.ndarray, loadings: np.ndarray) -> float:
    """Mean squared error of projecting onto the ``k×d`` loadings,
    from the second-moment matrix about the PCA mean:
    ``(tr M − tr PMPᵀ) / d`` — no row is reconstructed."""
    d = m2.shape[0]
    p = np.asarray(loadings)
    return float((np.trace(m2) - np.trace(p @ m2 @ p.T)) / d)


def _sum_packed(batches):
    acc: dict[str, np.ndarray] = {}
    for pdf in batches:
        for g, vec in zip(pdf["grp"], pdf["g"]):
            v = np.asarray(vec, dtype=np.float64)
            acc[g] = acc[g] + v if g in acc else v.copy()
    if acc:
        yield pd.DataFrame({"grp": list(acc), "g": list(acc.values())})


def tree_sum(parts: DataFrame, width: int) -> DataFrame:
    """Element-wise sum of packed ``(grp, salt, g array<double>)`` rows per
    ``grp`` in two salted levels (no row per element, no single reducer
    receiving every task's array)."""
    out = "grp string, g array<double>"
    level2 = parts.repartition(width, "grp", F.pmod(F.col("salt"), F.lit(width))).mapInPandas(_sum_packed, out)
    return level2.repartition(width, "grp").mapInPandas(_sum_packed, out)
