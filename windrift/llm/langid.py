"""Language identification: averaged hashed subword embeddings, a linear softmax,
and a calibrated rejection.

Subwords are the 1- to 4-grams of the text's bytes (A-Z folded, everything but
letters a-z and non-ASCII bytes read as a blank), hashed into ``BUCKETS``
embeddings.  A text is the mean of its embeddings; a linear layer gives one logit a
language.  Both layers are trained on the driver, in numpy, by stochastic gradient
descent on a bounded sample of labelled rows; one part of the sample is held back to
fit the temperature of the scores and the rejection threshold.  For prediction the
two layers fold into one table of logits per bucket, and whole texts are summed in
vectorised tasks.

Edge cases: a text that is null or has no letter gets ``und`` with score 0; without
labelled rows, every text does; ties go to the first language by name; repeated
rows are predicted each; an empty table gives no rows; other columns are kept but
for those named like an output.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrift.llm import textvec as tv
from windrift.llm.common import without

BUCKETS = 1 << 16
DIM = 16
GRAMS = (1, 2, 3, 4)
#: The bound of the training sample: rows for each language, and bytes of a row.
TRAIN_ROWS, TRAIN_BYTES = 500, 200_000
EPOCHS, BATCH, RATE = 12, 32, 8.0
#: Precision that accepted predictions are to have on the part held back.
PRECISION = 0.995
UNKNOWN = "und"

_MAP = np.full(256, 32, np.uint32)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits by bucket and language
    bias: np.ndarray
    temperature: float
    threshold: float


def _grams(data: np.ndarray, offsets: np.ndarray):
    """For each n: (bucket of every n-gram inside a row, n-grams of each row)."""
    b = _MAP[data]
    size = np.diff(offsets)
    left = np.repeat(offsets[1:], size) - np.arange(len(b))  # bytes from here to the row's end
    packed = np.zeros(len(b), np.uint32)
    blank = np.ones(len(b), bool)
    for n in range(1, max(GRAMS) + 1):
        shifted = np.concatenate([b[n - 1:], np.full(min(n - 1, len(b)), 32, np.uint32)])[:len(b)]
        packed = packed | (shifted << np.uint32(8 * (n - 1)))
        blank &= shifted == 32
        if n in GRAMS:
            h = (packed + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0xC2B2AE35)
            inside = (left >= n) & ~blank
            total = np.concatenate([[0], np.cumsum(inside)])
            yield (h[inside] >> np.uint32(16)).astype(np.int32), total[offsets[1:]] - total[offsets[:-1]]


def _features(texts: list[str]):
    """Sparse rows: (buckets, shares of each row's n-grams, entries of each row)."""
    idx, val, sizes = [], [], []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        every = np.concatenate([h for h, _ in _grams(raw, np.array([0, len(raw)]))]) if len(raw) else np.zeros(0, np.int32)
        k, n = np.unique(every, return_counts=True)
        idx.append(k)
        val.append(n / max(1, len(every)))
        sizes.append(len(k))
    return idx, val, np.array(sizes)


def train(texts: list[str], labels: list[str], seed: int = 11) -> Model:
    """Fit both layers by stochastic gradient descent; a fifth of the rows is held
    back for the temperature and the threshold."""
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    rng = np.random.default_rng(seed)
    idx, val, _ = _features(texts)
    order = rng.permutation(len(y))
    held, used = order[:len(y) // 5], order[len(y) // 5:]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)

    def mean(i):
        return val[i].astype(np.float32) @ emb[idx[i]]

    def softmax(z):
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(used), BATCH):
            rows = used[at:at + BATCH]
            hidden = np.stack([mean(i) for i in rows])
            grad = softmax(hidden @ out + bias)
            grad[np.arange(len(rows)), y[rows]] -= 1
            grad /= len(rows)
            back = grad @ out.T
            out -= rate * 0.1 * (hidden.T @ grad)
            bias -= rate * 0.01 * grad.sum(0)
            for i, g in zip(rows, back, strict=True):
                emb[idx[i]] -= rate * len(rows) * val[i].astype(np.float32)[:, None] * g
    table = emb @ out
    check = held if len(held) else used
    logits = np.stack([val[i].astype(np.float32) @ table[idx[i]] for i in check]) + bias
    heats = np.geomspace(0.05, 5, 60)
    losses = [-np.log(softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-9).mean() for t in heats]
    heat = float(heats[int(np.argmin(losses))])
    prob = softmax(logits / heat)
    sure, right = prob.max(1), prob.argmax(1) == y[check]
    levels = np.sort(sure)
    fine = [t for t in levels if right[sure >= t].mean() >= PRECISION]
    return Model(languages, table.astype(np.float32), bias, heat, float(fine[0]) if fine else 1.0)


def _predicting(shared, names: list[str]):
    def run(batches):
        model = shared.value
        for batch in batches:
            has = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
            for at, data, offsets in tv.slices(batch.column(len(names) + 1)):
                rows = len(offsets) - 1
                total, n = np.zeros((rows, len(model.languages))), np.zeros(rows)
                for h, counts in _grams(data, offsets):
                    some = counts > 0
                    first = (np.cumsum(counts) - counts)[some]
                    n += counts
                    for k in range(len(model.languages) if len(first) else 0):
                        total[some, k] += np.add.reduceat(model.table[:, k][h], first, dtype=np.float64)
                z = (total / np.maximum(n, 1)[:, None] + model.bias) / model.temperature
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                best, sure = z.argmax(1), z.max(1)
                known = has[at:at + rows]
                lang = np.where(known, np.array(model.languages, object)[best], UNKNOWN)
                score = np.where(known, sure, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, rows) for i in range(len(names))), pa.array(lang, pa.string()),
                     pa.array(score), pa.array(known & (score >= model.threshold))],
                    [*names, "lang_pred", "score", "accepted"])
    return run


def sample(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
           rows: int = TRAIN_ROWS) -> tuple[list[str], list[str]]:
    """Texts and labels of about ``rows`` rows a language, chosen by a hash of doc_id."""
    rows_of = labelled.select(F.col(doc_id).alias("i"), F.col(text).cast("string").alias("t"), F.col(lang).alias("l")).filter("l IS NOT NULL")
    able = rows_of.filter(F.col("t").rlike(r"\p{L}") & (F.octet_length("t") <= TRAIN_BYTES))
    share = F.pmod(F.xxhash64(F.lit("train"), F.col("i")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = rows_of.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    got = able.join(F.broadcast(counts), "l").filter(share * F.col("n") < rows).select("i", "t", "l").collect()
    got = sorted(got, key=lambda r: (r.l, str(r.i), r.t))
    return [r.t for r in got], [r.l for r in got]


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` (less the text) with lang_pred, score and accepted."""
    docs = without(docs, "lang_pred", "score", "accepted", "_has", "_text")
    names = [c for c in docs.columns if c != text]
    if model is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != text)
    ready = docs.select(*names, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_has"),
                        F.col(text).cast("string").alias("_text"))
    return ready.mapInArrow(_predicting(shared, names), f"{fields}lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, learn_from, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the labelled rows where ``learn_from`` holds, predict all rows."""
    texts, labels = sample(docs.filter(learn_from), doc_id, text, lang)
    model = train(texts, labels) if texts else None
    return predict(docs, model, text)
