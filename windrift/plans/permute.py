"""Cell permutation (M7) and permutation-based calibration curves (M8).

The reference permutes a share ``p`` of all cells of the scaled matrix
(across rows *and* columns, D31) and measures how badly the reference PCA
reconstructs the permuted data.  On Spark the
whole reference is permuted, and every level is a prefix of one random order of
the cells per repetition: of the first ``m = int(N·p)`` cells, number ``r`` takes the
value of number ``r+1`` and the last takes the first one's, a uniformly random
cyclic permutation of the chosen values.

Cells are ordered by a seeded bijection that is computed both ways, so each cell
knows without any sort where its value goes.

* M7 (one frame, one level) sends the chosen values to the rows that take them.
* M8 (ten repetitions, ten levels) lets values travel once a repetition, without their
  places, in packed arrays, and each task sums the squared reconstruction error per (repetition, level).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.functions.columns import qcol
from windrift.session import scratch_path

LEVELS = [0.01 + 0.1 * i for i in range(10)]


def _runs(row: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of the stretches of consecutive numbers."""
    cut = [0, *(np.flatnonzero(np.diff(row) != 1) + 1).tolist(), len(row)]
    return [(i, j) for i, j in zip(cut[:-1], cut[1:], strict=True) if i < j]


def permute_cells(df: DataFrame, cols: Sequence[str], keys: Sequence[str], pct: float, seed: int = 42) -> DataFrame:
    """M7: the frame with exactly ``int(n·d·pct)`` cells moved (same keys, same columns, NULLs are values); the multiset of
    cell values is unchanged.

    The cells' order is the bijection that M8 uses, so a cell knows without any sort where its value goes: only the
    chosen values travel, to the row that takes them."""
    d = len(cols)
    rows, n_rows = _numbered(df, cols, keys, whole=False)
    m = int(n_rows * d * pct)
    names = {f"x{j}": c for j, c in enumerate(cols)}
    if m < 2:
        return rows.select(*[qcol(k) for k in keys], *[F.col(x).alias(c) for x, c in names.items()])
    order = CellOrder(n_rows * d, seed * 1000)

    def send(batches):
        for pdf in batches:
            cells = (pdf["row"].to_numpy(dtype=np.int64)[:, None] * d + np.arange(d)).ravel()
            rank = order.rank(cells)
            chosen = rank < m
            to = order.cell(np.where(rank[chosen] > 0, rank[chosen] - 1, m - 1))  # number r+1 to r, the first to the last
            vals = pdf[list(names)].to_numpy(dtype=np.float64).ravel()[chosen]
            yield pd.DataFrame({"row": to // d, "j": (to % d).astype(np.int32), "v": vals})

    sent = rows.select("row", *names).mapInPandas(send, "row long, j int, v double")
    takes = sent.groupBy("row").agg(*[F.count(F.when(F.col("j") == j, 1)).alias(f"t{j}") for j in range(d)],
                                    *[F.max(F.when(F.col("j") == j, F.col("v"))).alias(f"y{j}") for j in range(d)])
    both = rows.join(takes, "row", "left")
    out = [F.when(F.col(f"t{j}") > 0, F.col(f"y{j}")).otherwise(F.col(f"x{j}")).alias(c) for j, c in enumerate(cols)]
    return both.select(*[qcol(k) for k in keys], *out)


_SUM_SCHEMA = T.StructType([T.StructField("rep", T.IntegerType()), T.StructField("level", T.IntegerType()),
                            T.StructField("sse", T.DoubleType()), T.StructField("cells", T.DoubleType())])
_PUSH = "part long, rep int, lo long, n int, vals binary"
#: Cells of one repetition that one part of the reassembly holds in memory at a time, and those of a small table's part.
PART_CELLS, LEAST_CELLS = 1 << 20, 1 << 16
#: Cells that a sending task gathers before it deals them out to the parts, so that its messages stay long.
SEND_CELLS = 1 << 20
#: Rows that a reconstruction takes at a time, and cells that the bijection does, so that their arrays stay in the cache.
BLOCK_ROWS, BLOCK_CELLS = 2048, 1 << 16


class CellOrder:
    """A seeded bijection of ``[0, n)``, forwards (cell to rank) and backwards:
    four additive Feistel rounds over pairs ``(c // b, c % b)``, repeated until the
    result lies below ``n``.  It needs no sort, and of each round's function a table of
    about √n numbers, which is made where it is used and never sent."""

    def __init__(self, n: int, seed: int):
        self.n, self.a = n, max(1, int(np.ceil(np.sqrt(n))))
        self.b = max(1, -(-n // self.a))
        self.keys = np.random.default_rng(seed).integers(1, 1 << 62, 4, dtype=np.uint64)
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def _mix(self, x: np.ndarray, i: int, mod: int) -> np.ndarray:
        h = x.astype(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += self.keys[i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h -= (h // np.uint64(mod)) * np.uint64(mod)  # NumPy divides by a scalar with multiplications, which % does not
        return h

    def _rounds(self) -> list[np.ndarray]:
        """What each round adds, for every number that it can be asked for."""
        if self._tables is None:
            halves = [(self.b, self.a), (self.a, self.b)]  # of a round: the numbers it is asked for, those it adds
            self._tables = [self._mix(np.arange(halves[i % 2][0]), i, halves[i % 2][1]) for i in range(4)]
        return self._tables

    def _turn(self, x: np.ndarray, back: bool) -> np.ndarray:
        """One turn of the rounds, forwards or ``back``.  In unsigned numbers the lesser of y and y - m is y reduced by m, where that
        does not pass 0, and of y and y + m it is y taken back into [0, m)."""
        tables, b = self._rounds(), np.uint64(self.b)
        x = x.view(np.uint64)
        left = x // b
        work = left * b
        right = x - work
        for i in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            changed, by, m = (right, left, b) if i % 2 else (left, right, np.uint64(self.a))
            np.take(tables[i], by.view(np.int64), out=work, mode="clip")  # with "raise", take would copy what it fills
            if back:
                changed -= work
                np.add(changed, m, out=work)
            else:
                changed += work
                np.subtract(changed, m, out=work)
            np.minimum(changed, work, out=changed)
        left *= b
        left += right
        return left.view(np.int64)

    def _in_blocks(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        for i in range(0, len(x), BLOCK_CELLS):
            block = self._turn(np.ascontiguousarray(x[i:i + BLOCK_CELLS]), back)
            while (far := np.flatnonzero(block >= self.n)).size:
                block[far] = self._turn(block[far], back)
            out[i:i + BLOCK_CELLS] = block
        return out

    def rank(self, cells: np.ndarray) -> np.ndarray:
        return self._in_blocks(cells, False)

    def cell(self, ranks: np.ndarray) -> np.ndarray:
        return self._in_blocks(ranks, True)


def _numbered(scaled: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), whole: bool = True) -> tuple[DataFrame, int]:
    """Rows (``whole``: complete ones) as ``(row, keys, x0, x1, ...)`` with a dense row number, and how many.

    The rows are written to the shared folder once; a row's number is its file's
    offset plus its index there, so a repeated task numbers them as before."""
    x = [qcol(c).cast("double").alias(f"x{j}") for j, c in enumerate(cols)]
    path = os.path.join(scratch_path(scaled.sparkSession, "calibration"), uuid.uuid4().hex[:12])
    taken = scaled.select(*[qcol(k) for k in keys], *x)
    (taken.dropna() if whole else taken).write.parquet(path)
    names = [*[f"`{k}`" for k in keys], *[f"x{j}" for j in range(len(cols))]]
    rows = scaled.sparkSession.read.schema(taken.schema).parquet(path)
    rows = rows.select("_metadata.file_name", "_metadata.row_index", *names)
    sizes = sorted((r["file_name"], r["n"]) for r in rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for name, n in sizes:
        offsets.append((name, total))
        total += n
    table = scaled.sparkSession.createDataFrame(offsets or [("", 0)], "file_name string, off long")
    return rows.join(F.broadcast(table), "file_name").select(
        (F.col("off") + F.col("row_index")).alias("row"), *names), total


def calibration_table_generic(scaled: DataFrame, cols: Sequence[str], keys: Sequence[str],
                              reconstruct: Callable[[np.ndarray], np.ndarray], repetitions: int = 10,
                              seed: int = 42, levels: Sequence[float] = LEVELS) -> DataFrame:
    """``(rep, perm_pct, mse)`` for any row-wise reconstruction
    (PCA or autoencoder): error between the original scaled rows and the
    reconstruction of their permuted version, over the whole reference.

    Each repetition orders the cells by a bijection, so a cell knows the cell
    that takes its value - the one before it in that order - and sends the
    value there: one shuffle of packed arrays, keyed by ranges of rows.  Only the
    values travel: the part that takes them runs the bijection the other way, so it
    knows which cells they come from, and both sides put them in the order of
    (run of rows, column, row).  All
    levels are prefixes of the order; at each, the last chosen cell takes
    the first one's value, and a row is reconstructed anew only where a level
    changes one of its cells.  ``keys`` is kept for callers; rows are numbered by
    their place in a written table.
    """
    d, n_lv = len(cols), len(levels)
    rows, n_rows = _numbered(scaled, cols)
    n_cells = n_rows * d
    ms = np.array([int(n_cells * p) for p in levels], dtype=np.int64)
    top = int(ms.max(initial=0))
    n_tasks = 4 * scaled.sparkSession.sparkContext.defaultParallelism
    span = max(1, min(PART_CELLS, max(LEAST_CELLS, n_cells // n_tasks)) // d)
    n_parts = max(1, -(-n_rows // span))
    orders = [CellOrder(max(1, n_cells), seed * 1000 + r) for r in range(repetitions)]

    def dealt(lo, block):
        """Messages of the rows ``block``, numbered from ``lo``."""
        row = np.arange(lo, lo + len(block))
        cells = (row * d + np.arange(d)[:, None]).ravel()  # by column: like values stand together
        vals = np.ascontiguousarray(block.T).ravel()
        for rep in range(-1, repetitions):  # -1: the rows themselves
            to, v = cells, vals
            if rep >= 0:
                rank = orders[rep].rank(cells)
                keep = (rank > 0) & (rank < top)  # the first goes to the last chosen cell, another at each level
                to, v = orders[rep].cell(rank[keep] - 1), vals[keep]
            part = to // (span * d)
            short = next((t for t in (np.uint8, np.uint16) if n_parts <= np.iinfo(t).max + 1), np.int64)  # short numbers are sorted by digits
            v = v[np.argsort(part.astype(short), kind="stable")]
            cut = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=n_parts))]).tolist()
            yield pd.DataFrame([(p, rep, lo, 8 * (j - i), pa.compress(v[i:j].tobytes(), codec="zstd", asbytes=True))
                                for p, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j],
                               columns=["part", "rep", "lo", "n", "vals"])

    def push(batches):
        lo, held, n = 0, [], 0
        for pdf in batches:
            row = pdf["row"].to_numpy(dtype=np.int64)
            x = pdf.iloc[:, 1:].to_numpy(dtype=np.float64)
            for i, j in _runs(row):
                if held and (row[i] != lo + n or n * d >= SEND_CELLS):
                    yield from dealt(lo, np.concatenate(held))
                    held, n = [], 0
                if not held:
                    lo = int(row[i])
                held.append(x[i:j])
                n += j - i
        if held:
            yield from dealt(lo, np.concatenate(held))

    pushed = rows.mapInPandas(push, _PUSH)
    # values of the first cell of each order: one small row each
    firsts = [0.0] * repetitions
    if n_cells:
        head = np.array([o.cell(np.zeros(1, np.int64))[0] for o in orders])
        wanted = rows.filter(F.col("row").isin([int(c) // d for c in head])).collect()
        by_row = {r["row"]: r for r in wanted}
        firsts = [float(by_row[int(c) // d][f"x{int(c) % d}"]) for c in head]

    def placed(cells, sent, size, to):
        """The values of ``sent`` (lo, values), which come from ``cells``, put where ``to`` says in an array of ``size``."""
        row = cells // d
        bits = max(1, len(cells)).bit_length()
        key = row * -d
        key += cells
        key *= n_rows
        key += row
        key <<= bits
        key |= np.arange(len(cells))
        key.sort()  # by column, then row
        sent = sorted(sent, key=lambda x: x[0])
        first = np.arange(d)[:, None] * n_rows + np.array([x[0] for x in sent], dtype=np.int64)
        first = np.append(np.searchsorted(key, first.ravel() << bits), len(key))
        vals, taken = np.empty(len(cells)), 0
        for k, (_, v) in enumerate(sent):
            at = 0
            for i in range(k, d * len(sent), len(sent)):  # one stretch for each column
                n = first[i + 1] - first[i]
                vals[first[i]:first[i + 1]] = v[at:at + n]
                at += n
            taken += at
            if at != len(v):
                raise RuntimeError(f"{len(v)} values came for {at} cells")
        if taken != len(cells):
            raise RuntimeError(f"{taken} values came for {len(cells)} cells")
        out = np.zeros(size)
        out[to[key & ((1 << bits) - 1)]] = vals
        return out

    def errors(u, w, rows, out):
        x, y = np.empty((2, min(BLOCK_ROWS, len(rows)), d))
        ones = np.ones(d)
        for i in range(0, len(rows), BLOCK_ROWS):
            at = rows[i:i + BLOCK_ROWS]
            e, changed = x[:len(at)], y[:len(at)]
            np.take(u, at, axis=0, out=e, mode="clip")
            np.take(w, at, axis=0, out=changed, mode="clip")
            e -= reconstruct(changed)
            e *= e
            out[at] = e @ ones

    def changed_rows(moved):
        """The numbers of the rows with a cell in ``moved``, column by column: rows are short."""
        by_row = moved.reshape(-1, d)
        some = by_row[:, 0].copy()
        for j in range(1, d):
            some |= by_row[:, j]
        return np.flatnonzero(some)

    def sums(batches):
        acc = np.zeros((repetitions, n_lv, 2))
        now, held, u, first_errors = None, [], None, None

        def flush():
            nonlocal u, first_errors
            part, rep = now
            base = part * span * d
            size = min(span * d, n_cells - base)
            ids = np.arange(base, base + size)
            sent = [(lo, np.frombuffer(pa.decompress(v, n, codec="zstd", asbytes=True), np.float64)) for lo, n, v in held]
            if rep < 0:
                u = placed(ids, sent, size, ids - base).reshape(-1, d)
                first_errors = np.empty(len(u))
                errors(u, u, np.arange(len(u)), first_errors)
                return
            r = orders[rep].rank(ids)
            to = np.flatnonzero(r < top - 1)
            vals = placed(orders[rep].cell(r[to] + 1), sent, size, to)
            level = np.zeros(size, np.uint8)  # the level from which a cell takes its value for good
            for m in ms:
                level += (r >= m - 1).view(np.uint8)
            w, err = u.copy(), first_errors.copy()
            flat = w.reshape(-1)
            for lv in range(n_lv):
                moved = level == lv
                np.copyto(flat, vals, where=moved)
                if ms[lv]:  # the last chosen cell takes the first one's value, at this level only
                    at = int(orders[rep].cell(ms[lv:lv + 1] - 1)[0]) - base
                    if 0 <= at < size:
                        flat[at], moved[at] = firsts[rep], True
                errors(u, w, changed_rows(moved), err)
                acc[rep, lv, 0] += float(err.sum())
                acc[rep, lv, 1] += size

        for pdf in batches:
            for part, rep, lo, n, v in zip(pdf["part"], pdf["rep"], pdf["lo"], pdf["n"], pdf["vals"], strict=True):
                if now is not None and (part, rep) != now:
                    flush()
                    held = []
                now = (part, rep)
                held.append((lo, n, v))
        if now is not None:
            flush()
        out = [(r, i, float(acc[r, i, 0]), float(acc[r, i, 1]))
               for r in range(repetitions) for i in range(n_lv) if acc[r, i, 1] > 0]
        if out:
            yield pd.DataFrame(out, columns=["rep", "level", "sse", "cells"])

    parts = pushed.repartition(n_parts, "part").sortWithinPartitions("part", "rep")
    tot = parts.mapInPandas(sums, _SUM_SCHEMA).groupBy("rep", "level") \
        .agg(F.sum("sse").alias("sse"), F.sum("cells").alias("cells"))
    pct_map = F.element_at(F.array(*[F.lit(float(p * 100)) for p in levels]), F.col("level") + 1)
    return tot.select("rep", pct_map.alias("perm_pct"), (F.col("sse") / F.col("cells")).alias("mse"))


def calibration_table(scaled: DataFrame, cols: Sequence[str], keys: Sequence[str], components: np.ndarray,
                      pca_mean: np.ndarray, repetitions: int = 10, seed: int = 42,
                      levels: Sequence[float] = LEVELS) -> DataFrame:
    """M8 for the reference PCA: reconstruction ``(w − μ)·PᵀP + μ``."""
    q = components.T @ components
    mu = np.asarray(pca_mean, dtype=float)
    centre = np.tile(mu - mu @ q, (BLOCK_ROWS, 1))  # as a block, for adding a short row to many is slow

    def rec(w: np.ndarray) -> np.ndarray:
        out = w @ q
        out += centre[:len(w)] if len(w) <= BLOCK_ROWS else centre[0]
        return out

    return calibration_table_generic(scaled, cols, keys, rec, repetitions, seed, levels)
