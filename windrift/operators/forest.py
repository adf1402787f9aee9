"""Random forest (M19) over counts in place of rows: the trees of ``RandomForestClassifier``, by fewer steps a row.

Spark ML walks every row through every tree at every level.  Here a row is taken once: its features become bins, Spark's
own bagging draws how often each tree takes it, and the rows of a block that share all bins and the class become one
cell with those numbers added up.  A level then walks cells, as arrays, and sums what each tree's nodes need to choose
their splits.  No more cells than rows are kept, whatever the values are.

Thresholds, draws, feature subsets, gains, ties and pruning follow Spark ML with its default parameters, so the model is
the one that it fits (tests hold the two together).  What the cells cannot hold - categorical features, a single tree,
codes over 53 bits, labels or features that Spark refuses - is left to Spark ML.
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.plans.moments import tree_sum
from windrift.session import scratch_path

#: Spark ML's default parameters.
MAX_BINS, MAX_DEPTH, MAX_MEMORY = 32, 5, 256 << 20
#: Rows whose draws a task gathers before it adds them up to cells, and blocks of cells that a pass takes over at a time.
BLOCK_ROWS, PASS_BLOCKS = 1 << 17, 4
#: Bits of a whole number that a double holds.
CODE_BITS = 53
INVALID = -float(np.finfo(np.float64).max)


def fit_forest(train: DataFrame, features_col: str, label: str, trees: int = 100, seed: int = 42) -> RandomForestClassificationModel:
    model = _fit_cells(train, features_col, label, trees, seed)
    if model is None:
        model = RandomForestClassifier(featuresCol=features_col, labelCol=label, numTrees=trees, seed=seed).fit(train)
    return model


def _fit_cells(train: DataFrame, features_col: str, label: str, trees: int, seed: int) -> RandomForestClassificationModel | None:
    attributes = train.schema[features_col].metadata.get("ml_attr", {}).get("attrs", {})
    if trees < 2 or {"nominal", "binary"} & set(attributes):
        return None
    x, y = F.col("x"), F.col("y")
    rows = train.select(vector_to_array(features_col).alias("x"), F.col(label).cast("double").alias("y"))
    one = rows.select(F.size("x").alias("d")).first()
    if one is None or one["d"] < 1:
        return None
    d = one["d"]
    odd = (F.size("x") != d) | y.isNull() | (y < 0) | (y != F.floor(y)) | (y >= 100)
    for j in range(d):
        odd = odd | F.isnan(x[j])
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("y"), F.max(F.coalesce(odd, F.lit(True))).alias("odd")).first()
    if about["odd"]:
        return None
    n, classes = about["n"], int(about["y"]) + 1
    splits = _thresholds(rows, n, d, seed)
    n_bins = [len(s) + 1 for s in splits]
    if classes * math.prod(n_bins) > 1 << CODE_BITS:
        return None
    cells = _cells(rows, splits, trees, seed)
    return _model(train, (_grow(cells, splits, classes, trees, seed), splits), features_col, label, trees, seed, d, classes)


# --------------------------------------------------------------------------- generators
class _JavaRandom:
    """``java.util.Random``."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def next(self, bits: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        out = self.state >> 48 - bits
        return out - (1 << 32) if bits == 32 and out >> 31 else out

    def next_long(self) -> int:
        out = (self.next(32) << 32) + self.next(32)
        return (out + (1 << 63)) % (1 << 64) - (1 << 63)

    def next_double(self) -> float:
        return ((self.next(26) << 27) + self.next(27)) * 2.0 ** -53


class _XorShift(_JavaRandom):
    """Spark's ``XORShiftRandom``; its seed is hashed by MurmurHash3 twice."""

    def __init__(self, seed: int):
        data = struct.pack(">q", seed)
        low = _murmur(data, 0x3C074A61)
        self.state = _murmur(data, low) << 32 | low

    def next(self, bits: int) -> int:
        x = self.state
        x = (x ^ x << 21) & (1 << 64) - 1
        x ^= x >> 35
        self.state = x = (x ^ x << 4) & (1 << 64) - 1
        out = x & (1 << bits) - 1
        return out - (1 << 32) if bits == 32 and out >> 31 else out


def _murmur(data: bytes, h: int) -> int:
    m = (1 << 32) - 1
    for (k,) in struct.iter_unpack("<I", data):
        k = k * 0xCC9E2D51 & m
        k = (k << 15 | k >> 17) & m
        h ^= k * 0x1B873593 & m
        h = (h << 13 | h >> 19) & m
        h = (h * 5 + 0xE6546B64) & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


# --------------------------------------------------------------------------- thresholds
def _thresholds(rows: DataFrame, n: int, d: int, seed: int) -> list[list[float]]:
    """The candidate thresholds of each feature, from Spark ML's sample of some 10,000 rows."""
    needed = max(MAX_BINS * MAX_BINS, 10_000)
    share, spark = min(1.0, needed / n), rows.sparkSession
    x = rows.select("x")
    if share < 1:
        drawn = x._jdf.toJavaRDD().sample(False, share, _XorShift(seed).next(32))
        x = DataFrame(spark._jsparkSession.createDataFrame(drawn, x._jdf.schema()), spark)
    sample = np.array([r["x"] for r in x.collect()], dtype=np.float64).reshape(-1, d)
    return [_feature_thresholds(sample[:, j], share * float(n), min(MAX_BINS, n) - 1) for j in range(d)]


def _feature_thresholds(values: np.ndarray, n_expected: float, n_splits: int) -> list[float]:
    values = values[values != 0.0]
    if not len(values):
        return []
    at, counts = np.unique(values, return_counts=True)
    known = dict(zip(at.tolist(), counts.astype(float).tolist(), strict=True))
    if n_expected - len(values) > 2.0 ** -52 * len(values) * 100:
        known[0.0] = n_expected - len(values)  # zeros are not counted but inferred
    at = sorted(known)
    if len(at) - 1 <= n_splits:
        return [(a + b) / 2.0 for a, b in zip(at[:-1], at[1:], strict=True)]
    stride = n_expected / (n_splits + 1)
    out, seen, target = [], known[at[0]], stride
    for a, b in zip(at[:-1], at[1:], strict=True):
        before, seen = seen, seen + known[b]
        if abs(before - target) < abs(seen - target):
            out.append((a + b) / 2.0)
            target += stride
    return out


# --------------------------------------------------------------------------- cells
def _bin(x: Column, thresholds: Sequence[float], first: int = 0) -> Column:
    """How many of the thresholds lie below ``x``, by halves."""
    if not thresholds:
        return F.lit(float(first))
    at = len(thresholds) // 2
    return F.when(x <= F.lit(thresholds[at]), _bin(x, thresholds[:at], first)).otherwise(_bin(x, thresholds[at + 1:], first + at + 1))


def _cells(rows: DataFrame, splits: list[list[float]], trees: int, seed: int) -> DataFrame:
    """Blocks of cells in a table: code (class, then bins as digits) and how often each tree takes it, as bytes."""
    spark = rows.sparkSession
    code = F.col("y")
    for j, s in enumerate(splits):
        code = code * F.lit(float(len(s) + 1)) + _bin(F.col("x")[j], s)
    jvm, codes = spark.sparkContext._jvm, rows.select(code.alias("value"))
    encoders = jvm.org.apache.spark.sql.Encoders
    weight = getattr(getattr(jvm.scala.collection.immutable, "Map$"), "MODULE$").empty().withDefaultValue(1.0)  # of any row: 1
    bagged = jvm.org.apache.spark.ml.tree.impl.BaggedPoint.convertToBaggedRDD(
        getattr(codes._jdf, "as")(encoders.DOUBLE()).rdd(), 1.0, trees, True, weight, seed)
    kind = jvm.java.lang.Class.forName("org.apache.spark.ml.tree.impl.BaggedPoint")
    drawn = DataFrame(spark._jsparkSession.createDataset(bagged, encoders.kryo(kind)).toDF(), spark)
    path = os.path.join(scratch_path(spark, "forest"), uuid.uuid4().hex[:12])
    drawn.mapInArrow(_added_up(trees), "codes binary, width int, counts binary").write.options(
        **{"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": False,
           "compression": "zstd"}).parquet(path)
    side = spark.newSession()
    side.conf.set("spark.sql.files.minPartitionNum", str(2 * spark.sparkContext.defaultParallelism))
    side.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PASS_BLOCKS))
    return side.read.schema("codes binary, width int, counts binary").parquet(path)


def _draws(batch, trees: int):
    """(codes, draws by tree) of a batch of serialized bagged points.  All have one length: the code and the weight 1 as
    doubles, then the length of the array and the draws."""
    column = batch.column(0)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    size = int(ends[1] - ends[0])
    raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(len(column), size)
    first, tail = raw[0].tobytes(), size - 4 * trees
    for order in "<>":
        for at in range(tail - 1, tail - 6, -1):
            if first[at - 8:at] == struct.pack(order + "d", 1.0):
                codes = np.ascontiguousarray(raw[:, at - 16:at - 8]).view(order + "f8").ravel()
                draws = np.ascontiguousarray(raw[:, tail:]).view(order + "i4")
                return codes.astype(np.float64), draws.astype(np.uint8 if draws.max(initial=0) < 256 else np.int32)
    raise RuntimeError("bagged points are serialized in another way than expected")


def _added_up(trees: int):
    schema = pa.schema([("codes", pa.binary()), ("width", pa.int32()), ("counts", pa.binary())])

    def flush(held):
        codes, draws = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        counts = np.add.reduceat(draws[order], starts, axis=0, dtype=np.int32)
        width = next(w for w in (1, 2, 4) if counts.max(initial=0) < 1 << 8 * w - (w == 4))
        return pa.RecordBatch.from_pydict({"codes": [codes[starts].tobytes()], "width": [width], "counts": [
            np.ascontiguousarray(counts.T, dtype=f"<u{width}").tobytes()]}, schema=schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(_draws(batch, trees))
                n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


# --------------------------------------------------------------------------- trees
class _Node:
    """A node as it grows: ``counts`` by class, and of a split the feature, the bin that still goes left and the children."""

    def __init__(self, depth: int, counts: np.ndarray | None = None):
        self.depth, self.counts, self.valid = depth, counts, True
        self.gain, self.feature, self.cut, self.left, self.right = -1.0, -1, 0, None, None


def _gini(counts: np.ndarray) -> np.ndarray:
    """Impurity of the columns of ``counts``, by the operations of Spark ML in their order."""
    total = counts.sum(axis=0)
    out, some = np.ones(counts.shape[1:]), np.where(total == 0, 1.0, total)
    for c in counts:
        share = c / some
        out -= share * share
    return np.where(total == 0, 0.0, out)


def _best_split(node: _Node, bins: list[np.ndarray], features: Sequence[int]):
    """(gain, feature, cut, counts left, counts right) of the best split, gain INVALID where there is none.  ``bins`` has
    the counts (class, bin) of each feature; the first of equal gains is taken."""
    if node.counts is None:
        node.counts = bins[features[0]].sum(axis=1)
    impurity, best = float(_gini(node.counts[:, None])[0]), (INVALID, -1, 0, None, None)
    found = False
    for f in features:
        if bins[f].shape[1] < 2:
            continue
        left = np.cumsum(bins[f], axis=1)
        total, left = left[:, -1:], left[:, :-1]
        right = total - left
        n_left, n_right = left.sum(axis=0), right.sum(axis=0)
        n = np.where(n_left + n_right == 0, 1.0, n_left + n_right)
        gain = impurity - n_left / n * _gini(left) - n_right / n * _gini(right)
        gain = np.where((n_left < 1) | (n_right < 1) | (gain < 0.0), INVALID, gain)
        at = int(np.argmax(gain))
        if not found or gain[at] > best[0]:
            found, best = True, (float(gain[at]), f, at, left[:, at].copy(), right[:, at].copy())
    return best


def _hash_order(keys: Sequence[int], shift: int = 0) -> list[int]:
    """Small numbers in the order of an immutable Scala hash map: entries of a trie node by five bits, then its sub-nodes."""
    if shift == 0 and len(keys) < 5:
        return sorted(keys)

    def improved(k):
        h = (k + (~(k << 9) & 0xFFFFFFFF)) & 0xFFFFFFFF
        h ^= h >> 14
        h = (h + (h << 4)) & 0xFFFFFFFF
        return h ^ h >> 10

    at: dict[int, list[int]] = {}
    for k in keys:
        at.setdefault(improved(k) >> shift & 31, []).append(k)
    return [at[m][0] for m in sorted(at) if len(at[m]) == 1] + \
        [k for m in sorted(at) if len(at[m]) > 1 for k in _hash_order(at[m], shift + 5)]


def _grow(cells: DataFrame, splits: list[list[float]], classes: int, trees: int, seed: int) -> list[_Node]:
    rng, d = _JavaRandom(seed), len(splits)
    n_bins, k = [len(s) + 1 for s in splits], math.ceil(math.sqrt(d))
    roots = [_Node(0) for _ in range(trees)]
    stack = list(enumerate(roots))  # the last one is taken first

    def subset() -> list[int]:
        """Features that a node may split by: Spark ML's reservoir, with its generator."""
        taken = list(range(k))
        if k < d:
            draw = _XorShift(rng.next_long())
            for f in range(k, d):
                at = int(draw.next_double() * (f + 1))
                if at < k:
                    taken[at] = f
        return taken

    while stack:
        group: dict[int, list[tuple[_Node, list[int]]]] = {}
        used = 0
        while stack:
            features = subset()
            size = 8 * classes * sum(n_bins[f] for f in features)
            if used and used + size > MAX_MEMORY:
                break
            tree, node = stack.pop()
            group.setdefault(tree, []).append((node, features))
            used += size
        bins = _histograms(cells, roots, {t: [node for node, _ in nodes] for t, nodes in group.items()}, n_bins, classes)
        for tree in _hash_order(list(group)):
            for (node, features), counts in zip(group[tree], bins[tree], strict=True):
                gain, feature, cut, left, right = _best_split(node, counts, features)
                if gain <= 0 or node.depth == MAX_DEPTH:
                    node.valid, node.gain = gain > INVALID, gain
                    continue
                node.gain, node.feature, node.cut = gain, feature, cut
                node.left, node.right = (_Node(node.depth + 1, c) for c in (left, right))
                for child in (node.left, node.right):
                    if child.depth < MAX_DEPTH and abs(float(_gini(child.counts[:, None])[0])) >= 2.0 ** -52:
                        stack.append((tree, child))
    return roots


def _arrays(root: _Node, wanted: list[_Node]):
    """(feature, cut, left, right, place in ``wanted``) of a tree's nodes; what is not wanted has the place after the last."""
    nodes, out = [root], []
    for node in nodes:  # grows as it is walked
        here, place = len(out), next((i for i, w in enumerate(wanted) if w is node), len(wanted))
        if node.left is None:
            out.append((0, 1 << 14, here, here, place))
        else:
            out.append((node.feature, node.cut, len(nodes), len(nodes) + 1, place))
            nodes += [node.left, node.right]
    return np.array(out, dtype=np.int64).T.copy(), max(w.depth for w in wanted)


def _histograms(cells: DataFrame, roots: list[_Node], wanted: dict[int, list[_Node]], n_bins: list[int], classes: int):
    """For each tree, for each wanted node, the counts (class, bin) of every feature.  One pass over the cells."""
    spark = cells.sparkSession
    shapes = {t: len(nodes) for t, nodes in wanted.items()}
    sent = spark.sparkContext.broadcast({t: _arrays(roots[t], nodes) for t, nodes in wanted.items()})
    arrow = pa.schema([("grp", pa.string()), ("salt", pa.int32()), ("g", pa.list_(pa.float64()))])

    def run(batches):
        sums, pid = {}, 0
        for batch in batches:
            for pid, codes, width, counts in zip(*(batch.column(c).to_pylist() for c in ("_pid", "codes", "width", "counts")), strict=True):
                code = np.frombuffer(codes, np.float64).astype(np.int64)
                counts = np.frombuffer(counts, f"<u{width}").reshape(-1, len(code))
                bins = np.empty((len(n_bins), len(code)), np.int64)
                for j in range(len(n_bins) - 1, -1, -1):
                    code, bins[j] = np.divmod(code, n_bins[j])
                base = [code * n + bins[j] for j, n in enumerate(n_bins)]  # what is left of the code is the class
                flat, column = bins.ravel(), np.arange(len(code))
                for tree, ((feature, cut, left, right, place), depth) in sent.value.items():
                    at = np.zeros(len(code), np.int64)
                    for _ in range(depth):
                        at = np.where(flat[feature[at] * len(code) + column] <= cut[at], left[at], right[at])
                    at, weights = place[at], counts[tree].astype(np.float64)
                    found = np.concatenate([np.bincount(at * (classes * n) + base[j], weights, (shapes[tree] + 1) * classes * n)[
                        :shapes[tree] * classes * n] for j, n in enumerate(n_bins)])
                    sums[tree] = sums[tree] + found if tree in sums else found
        if sums:
            yield pa.RecordBatch.from_pydict({"grp": [str(t) for t in sums], "salt": [pid] * len(sums), "g": list(sums.values())}, schema=arrow)

    schema = T.StructType([T.StructField("grp", T.StringType()), T.StructField("salt", T.IntegerType()),
                           T.StructField("g", T.ArrayType(T.DoubleType()))])
    width = max(1, math.ceil(math.sqrt(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    summed = tree_sum(cells.withColumn("_pid", F.spark_partition_id()).mapInArrow(run, schema), width).collect()
    sent.unpersist()
    out = {}
    for r in summed:
        tree, vec, start = int(r["grp"]), np.asarray(r["g"], dtype=np.float64), 0
        nodes = [[] for _ in range(shapes[tree])]
        for n in n_bins:
            part = vec[start:start + shapes[tree] * classes * n].reshape(shapes[tree], classes, n)
            start += part.size
            for node, counts in zip(nodes, part, strict=True):
                node.append(counts)
        out[tree] = nodes
    return out


# --------------------------------------------------------------------------- model
def _pruned(node: _Node) -> bool:
    """Whether the node is a leaf once sub-trees whose leaves all predict one class are cut back."""
    if node.left is None:
        return True
    leaves = [_pruned(node.left), _pruned(node.right)]
    if all(leaves) and np.argmax(node.left.counts) == np.argmax(node.right.counts):
        node.left = node.right = None
        return True
    return False


def _node_rows(node: _Node, splits, out: list) -> int:
    """Rows of Spark ML's model table, parents before children; returns the node's number."""
    here, impurity = len(out), float(_gini(node.counts[:, None])[0])
    out.append(None)
    stats = [float(np.argmax(node.counts)), impurity, node.counts.tolist(), int(node.counts.sum())]
    if node.left is None:
        out[here] = (here, stats[0], impurity if node.valid else -1.0, *stats[2:], -1.0, -1, -1, (-1, [], -1))
    else:
        left, right = _node_rows(node.left, splits, out), _node_rows(node.right, splits, out)
        out[here] = (here, *stats, node.gain, left, right, (node.feature, [splits[node.feature][node.cut]], -1))
    return here


def _model(train: DataFrame, grown, features_col: str, label: str, trees: int, seed: int, d: int, classes: int):
    """The model of Spark ML, by its own reader of saved models."""
    roots, splits = grown
    spark = train.sparkSession
    path = os.path.join(scratch_path(spark, "forest"), uuid.uuid4().hex[:12])
    params = {"featuresCol": features_col, "labelCol": label, "seed": seed}

    def header(kind, **more):
        return json.dumps({"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": 0, "sparkVersion": spark.version,
                           "uid": f"{kind}_{uuid.uuid4().hex[:12]}", "defaultParamMap": {"impurity": "gini"}} | more)

    rows = []
    for tree, root in enumerate(roots):
        _pruned(root)
        nodes: list = []
        _node_rows(root, splits, nodes)
        rows += [(tree, node) for node in nodes]
    top = header("RandomForestClassificationModel", paramMap=params | {"numTrees": trees}, numFeatures=d, numClasses=classes, numTrees=trees)
    one = header("DecisionTreeClassificationModel", paramMap=params, numFeatures=d, numClasses=classes)
    spark.createDataFrame([(top,)], "value string").coalesce(1).write.text(os.path.join(path, "metadata"))
    spark.createDataFrame([(t, one, 1.0) for t in range(trees)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(
        os.path.join(path, "treesMetadata"))
    spark.createDataFrame(rows, "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,"
                          "rawCount:bigint,gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,"
                          "leftCategoriesOrThreshold:array<double>,numCategories:int>>").coalesce(1).write.parquet(os.path.join(path, "data"))
    return RandomForestClassificationModel.load(path)
