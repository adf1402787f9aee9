"""Denoising autoencoder for the dE_AE score (M11-M13), trained
data-parallel on Spark.

Network: d → hidden… (relu) → mirrored hidden (relu) → d (linear), mean
squared error, Adam, mini-batches of 32, input noise 0.1·N(0,1).

Training is parameter mixing: every epoch the driver broadcasts the weights,
each task runs one epoch of mini-batch Adam over its own rows, and the task
results are averaged (weighted by rows): each task emits one packed array,
summed in two salted levels, so only one parameter vector reaches the driver
per epoch.  The same pass measures the loss of the epoch's weights on the training
rows and on those held out (``history``: epoch, training loss, held-out loss).
This is not the single-process trajectory of a Keras fit; only the score
behaviour (bands over scenarios) can be compared.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.functions.columns import qcol
from windrift.functions.scalar import gaussian
from windrift.plans.moments import tree_sum
from windrift.session import scratch_path

#: One row in so many is held out of training; its loss is measured in the same passes.
HELD_OUT = 10

#: Bytes of a row group of the written training rows.
ROW_GROUP = 4 << 20

#: Blocks of training rows (an Arrow batch of the session each) that a pass takes over at a time.
PASS_BLOCKS = 8

#: Rows that a forward pass takes through the layers at a time, so that their activations stay in the cache.
FORWARD_ROWS = 2048

DEFAULTS = {"hidden_layers": [64, 32], "epochs": 20, "batch_size": 32, "noise_factor": 0.1,
            "learning_rate": 0.001}


def layer_sizes(d: int, hidden: Sequence[int]) -> list[int]:
    hidden = list(hidden)
    return [d] + hidden + list(reversed(hidden[:-1])) + [d]


def init_params(sizes: Sequence[int], seed: int) -> list[np.ndarray]:
    """Glorot-uniform weights, zero biases; flat list [W0, b0, W1, b1, …]."""
    rng = np.random.default_rng(seed)
    params = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        lim = np.sqrt(6.0 / (a + b))
        params += [rng.uniform(-lim, lim, size=(a, b)), np.zeros(b)]
    return params


def flatten(params: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params])


def unflatten(vec: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    out, pos = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append(vec[pos:pos + a * b].reshape(a, b))
        pos += a * b
        out.append(vec[pos:pos + b].copy())
        pos += b
    return out


def forward(params: Sequence[np.ndarray], x: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), params[-1].shape[0]))
    n_layers = len(params) // 2
    for start in range(0, len(x), FORWARD_ROWS):
        h = x[start:start + FORWARD_ROWS]
        for i in range(n_layers):
            h = h @ params[2 * i]
            h += params[2 * i + 1]
            if i < n_layers - 1:
                np.maximum(h, 0.0, out=h)
        out[start:start + FORWARD_ROWS] = h
    return out


def _grads(layers, grads, x_in, y, acts, deltas):
    """The gradients of the layers ``[weights; biases]``, written into the arrays ``grads``.  A batch's rows are columns here: an
    input ``acts[i]`` ends in a row of ones, so that one product takes in the biases, forwards and backwards."""
    last = len(layers) - 1
    acts[0][:-1] = x_in
    for i, layer in enumerate(layers):
        h = np.dot(layer.T, acts[i], out=acts[i + 1][:-1] if i < last else deltas[last])
        if i < last:
            np.maximum(h, 0.0, out=h)
    delta = deltas[last]
    delta -= y
    delta *= 2.0 / y.size
    for i in range(last, -1, -1):
        np.dot(acts[i], delta.T, out=grads[i])
        if i > 0:
            delta = np.dot(layers[i][:-1], delta, out=deltas[i - 1])
            np.copyto(delta, 0.0, where=acts[i][:-1] <= 0)


def _views(vec: np.ndarray, shapes) -> list[np.ndarray]:
    out, pos = [], 0
    for s in shapes:
        n = math.prod(s)
        out.append(vec[pos:pos + n].reshape(s))
        pos += n
    return out


def train_epoch(params, x_noisy, x_clean, batch_size, lr, rng):
    """One epoch of Adam (fresh moments) over the rows of one task.  Weights, gradients and moments are one array each, so
    that a step is a few operations in place however many layers there are."""
    sizes = [params[0].shape[0]] + [p.shape[1] for p in params[::2]]
    shapes = [(a + 1, b) for a, b in zip(sizes[:-1], sizes[1:])]  # a layer's biases follow its weights
    w = flatten(params)
    g, m, v = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    a, b = np.empty_like(w), np.empty_like(w)
    layers, grads = _views(w, shapes), _views(g, shapes)
    b1, b2, eps = 0.9, 0.999, 1e-7
    order = rng.permutation(len(x_clean))
    x_noisy, x_clean = np.ascontiguousarray(x_noisy[order].T), np.ascontiguousarray(x_clean[order].T)
    size, acts, deltas = 0, [], []
    for t, start in enumerate(range(0, len(order), batch_size), 1):
        x_in, y = x_noisy[:, start:start + batch_size], x_clean[:, start:start + batch_size]
        if y.shape[1] != size:  # the first batch, and a shorter last one
            size = y.shape[1]
            acts, deltas = [np.ones((k + 1, size)) for k in sizes[:-1]], [np.empty((k, size)) for k in sizes[1:]]
        _grads(layers, grads, x_in, y, acts, deltas)
        # m = b1 m + g;  v = b2 v + g²;  w -= lr m̂ / (√v̂ + eps), the factors of m̂ and v̂ taken out of the arrays
        m *= b1
        m += g
        v *= b2
        v += np.multiply(g, g, out=a)
        root = math.sqrt((1 - b2) / (1 - b2 ** t))
        np.sqrt(v, out=a)
        a += eps / root
        np.divide(m, a, out=b)
        b *= lr * (1 - b1) / (1 - b1 ** t) / root
        w -= b
    return _views(w, [p.shape for p in params])


def _packed(batches):
    """Blocks of rows as bytes, column by column."""
    for pdf in batches:
        if len(pdf):
            yield pd.DataFrame({"block": [np.ascontiguousarray(pdf.to_numpy(dtype=np.float64).T).tobytes()]})


def _blocks(batches, width: int):
    """(partition, block of ``width`` columns) of what ``_packed`` has written, without a copy."""
    for batch in batches:
        for pid, value in zip(batch.column("_pid").to_pylist(), batch.column("block"), strict=True):
            yield pid, np.frombuffer(value.as_buffer(), np.float64).reshape(width, -1)


def fit_autoencoder(scaled: DataFrame, cols: Sequence[str], model, ae_params: dict, seed: int = 42,
                    row_key: Sequence[str] | None = None) -> dict:
    """M11 (+ M12 when a row key allows the permutation calibration)."""
    cfg = {**DEFAULTS, **(ae_params or {})}
    d = len(cols)
    sizes = layer_sizes(d, cfg["hidden_layers"])
    params = init_params(sizes, seed)
    keys = list(row_key or [])
    noise_keys = keys if keys else None
    x_cols = [qcol(c).cast("double").alias(f"x{j}") for j, c in enumerate(cols)]
    if noise_keys:
        n_cols = [(qcol(c) + F.lit(cfg["noise_factor"]) * gaussian(seed, *noise_keys, F.lit(j))).alias(f"n{j}")
                  for j, c in enumerate(cols)]
    else:
        n_cols = [(qcol(c) + F.lit(cfg["noise_factor"]) * F.randn(seed + j)).alias(f"n{j}")
                  for j, c in enumerate(cols)]
    spark = scaled.sparkSession
    path = os.path.join(scratch_path(spark, "autoencoder"), uuid.uuid4().hex[:12])
    held = (F.pmod(F.xxhash64(*(keys or cols), F.lit(seed)), F.lit(HELD_OUT)) == 0).alias("held")
    # scaled and noisy rows, once for all epochs, a block of them as one value, which a pass reads without taking it apart; in
    # short row groups: with two rounds of tasks a pass waits for no long one
    rows = scaled.select(*x_cols, *n_cols, held).dropna().mapInPandas(_packed, "block binary")
    rows.write.options(**{"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": False,
                          "compression": "zstd"}).parquet(path)
    side = spark.newSession()
    side.conf.set("spark.sql.files.minPartitionNum", str(2 * spark.sparkContext.defaultParallelism))
    side.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PASS_BLOCKS))
    train = side.read.schema("block binary").parquet(path).withColumn("_pid", F.spark_partition_id())
    width = max(1, math.ceil(math.sqrt(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    schema = T.StructType([T.StructField("grp", T.StringType()), T.StructField("salt", T.IntegerType()),
                           T.StructField("g", T.ArrayType(T.DoubleType()))])
    arrow = pa.schema([("grp", pa.string()), ("salt", pa.int32()), ("g", pa.list_(pa.float64()))])
    history = []
    for epoch in range(cfg["epochs"] + 1):  # the last pass only measures the final weights
        flat, last = flatten(params), epoch == cfg["epochs"]
        bc = scaled.sparkSession.sparkContext.broadcast(flat)
        ep_seed = seed * 1000 + epoch

        def run(batches, bc=bc, ep_seed=ep_seed, last=last):
            p0 = unflatten(np.asarray(bc.value), sizes)
            p1, seen, salt, loss = p0, 0, 0, np.zeros(4)  # squared error and cells of training rows, then of held-out ones
            for salt, block in _blocks(batches, 2 * d + 1):  # a task holds a few blocks at a time
                xc, xn, out = block[:d].T, block[d:2 * d].T, block[-1] > 0
                err = ((xc - forward(p0, xc)) ** 2).sum(axis=1)
                loss += [err[~out].sum(), d * (~out).sum(), err[out].sum(), d * out.sum()]
                xc, xn = xc[~out], xn[~out]
                rng = np.random.default_rng([ep_seed, salt, seen])
                if not last and len(xc):
                    p1 = train_epoch(p1, xn, xc, cfg["batch_size"], cfg["learning_rate"], rng)
                seen += len(xc)
            if loss[1] + loss[3] > 0:
                # one packed row per task: rows-weighted weights, the row count, and the losses of the weights it began with
                packed = np.concatenate([flatten(p1) * seen, [float(seen)], loss])
                yield pa.RecordBatch.from_pydict({"grp": ["w"], "salt": [salt], "g": [packed]}, schema=arrow)

        rows = tree_sum(train.mapInArrow(run, schema), width).collect()
        bc.unpersist()
        if rows:
            total = np.asarray(rows[0]["g"], dtype=np.float64)
            weights, seen, loss = total[:-5], total[-5], total[-4:]
            history.append((epoch, float(loss[0] / max(loss[1], 1.0)), float(loss[2] / max(loss[3], 1.0))))
            if seen > 0 and not last:
                params = unflatten(weights / seen, sizes)
    out = {"sizes": sizes, "params": flatten(params).tolist(), "curves": [], "history": history}
    if keys:
        from windrift.plans.detector import REPETITIONS, Curve
        from windrift.plans.permute import calibration_table_generic
        prm = params

        def rec(w):
            return forward(prm, w)

        table = calibration_table_generic(scaled, cols, keys, rec, repetitions=REPETITIONS, seed=seed + 7)
        reps: dict[int, list] = {}
        for r in table.collect():
            reps.setdefault(r["rep"], []).append((r["perm_pct"], r["mse"]))
        out["curves"] = [Curve([m for _, m in sorted(v)], [p for p, _ in sorted(v)]) for _, v in sorted(reps.items())]
    return out


def error_sums(model):
    """M13 for ``moments_table``: a block of raw rows → (sum of squared errors, cells), after the model's scaling."""
    params = unflatten(np.asarray(model.ae["params"]), model.ae["sizes"])
    mean, std = model.mean, np.where(model.std == 0, 1.0, model.std)

    def sums(x):
        z = (x - mean) / std
        return np.array([float(np.sum((z - forward(params, z)) ** 2)), float(z.size)])

    return sums


def ae_score(model, mse: float) -> float | None:
    """dE_AE from the autoencoder curves (NULL without curves)."""
    from windrift.plans.detector import curve_scores
    curves = model.ae.get("curves") if model.ae else None
    if not curves:
        return None
    score, _ = curve_scores(curves, mse)
    return score
