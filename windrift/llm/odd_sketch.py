"""MinHash near-duplicates verified through odd sketches.

A document's set of distinct word shingles gives ``BANDS * ROWS`` MinHash
values.  They are cut into bands, whose equal keys propose candidates, and folded
into an odd sketch: a bitmap of the parities of their hashes.  The XOR of two
sketches counts the values that differ, so that its population count estimates
high similarities closely; candidates far below the threshold go there, and the
others are confirmed on their full sets.

Equal sets are one class before any pairing.  Then each bucket links its members
to one hub.  Buckets whose members are still in different components are compared
again, in blocks of bounded size: a spanning forest of the sketches that agree
joins components into clusters, and in each cluster all members of different
components are compared on their full sets, again in blocks, which put out a
spanning forest of links.  So no bucket emits its pairs, and no link between
components is lost to a cap.

Edge cases: a text without words is linked with nothing; a text of fewer words than
a shingle is one shingle; rows with a null doc_id stay, alone, with a null
component; rows of one doc_id share a component; an empty table gives no rows;
extra columns are kept by ``keep_one`` but for working names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrift.llm import textvec as tv
from windrift.llm.common import join_salted, join_unique, materialize, without
from windrift.llm.components import components

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 32 bands of 4 miss a pair at similarity 0.75 once in 190,000.
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
#: Five standard deviations of the estimate below the threshold.
LEAST_ESTIMATE = 0.55
#: Members of a bucket, and of a cluster of up to this squared, that meet in one group (of two blocks).
BLOCK = 256
CLUSTER_BLOCK = 64

_SIG = "doc_id long, n long, s1 long, s2 long, bands array<long>, sketch binary"


def _minhashes(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(rows with a set, BANDS * ROWS) smallest hashes."""
    first = (np.cumsum(n) - n)[n > 0]
    factor = np.random.default_rng(75).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    return np.stack([np.minimum.reduceat(s * f, first) for f in factor], 1)


def _sketches(mins: np.ndarray) -> np.ndarray:
    k = mins.shape[1]
    bit = tv.mix(mins + np.arange(k, dtype=np.uint64) * tv.COEF[10]) % np.uint64(SKETCH_BITS)
    flat = np.arange(len(mins))[:, None] * SKETCH_BITS + bit.astype(np.int64)
    odd = np.bincount(flat.ravel(), minlength=len(mins) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(mins), SKETCH_BITS), axis=1)


def _signatures(batches):
    for batch in batches:
        ids, col = batch.column(0), batch.column(1)
        for at, data, offsets in tv.slices(col):
            hashes, _, _, counts = tv.words(data, offsets)
            s, n = tv.shingles(hashes, counts, SHINGLE)
            rows, some = len(counts), n > 0
            sums = np.zeros((2, rows), np.uint64)
            bands = np.zeros((rows, BANDS), np.uint64)
            sketch = np.zeros((rows, SKETCH_BITS // 8), np.uint8)
            if some.any():
                first = (np.cumsum(n) - n)[some]
                sums[0, some] = np.add.reduceat(tv.mix(s + tv.COEF[11]), first)
                sums[1, some] = np.add.reduceat(tv.mix(s ^ tv.COEF[12]), first)
                mins = _minhashes(s, n)
                sketch[some] = _sketches(mins)
                parts = (mins.reshape(-1, BANDS, ROWS) * tv.COEF[20:20 + ROWS]).sum(2, dtype=np.uint64)
                bands[some] = tv.mix(parts + np.arange(BANDS, dtype=np.uint64) * tv.COEF[13])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * BANDS + 1, BANDS, dtype=np.int32)),
                                             pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, rows).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)),
                 pa.array(sums[1].view(np.int64)), lists, tv.binary_column(sketch)],
                ["doc_id", "n", "s1", "s2", "bands", "sketch"])


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity from the sketches x and y (rows of bytes)."""
    odd = np.bitwise_count(np.bitwise_xor(x, y)).sum(1, dtype=np.int64)
    k = BANDS * ROWS
    return 1 + SKETCH_BITS / (4 * k) * np.log(np.maximum(1 - 2 * odd / SKETCH_BITS, 1e-9))


def _bytes_matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    w = SKETCH_BITS // 8
    return np.frombuffer(col.buffers()[2], np.uint8)[col.offset * w:(col.offset + len(col)) * w].reshape(len(col), w)


def _near_by_sketch(batches):
    for batch in batches:
        if batch.num_rows:
            good = estimate(_bytes_matrix(batch.column("sa")), _bytes_matrix(batch.column("sb"))) >= LEAST_ESTIMATE
            yield batch.select(["a", "b"]).filter(pa.array(good))


def _confirmed(batches):
    """Pairs a, b whose texts ta, tb have sets similar enough."""
    for batch in batches:
        where = 0
        while where < batch.num_rows:  # both texts of a pair within one slice
            part = batch.slice(where, 512)
            size = np.cumsum(sum(np.diff(tv.strings(part.column(c))[1]) for c in ("ta", "tb")))
            take = max(1, int(np.searchsorted(size, tv.SLICE_BYTES, "right")))
            part = part.slice(0, take)
            where += take
            s, r, counts = [], [], []
            for c in ("ta", "tb"):
                data, offsets = tv.strings(part.column(c))
                hashes, _, _, words = tv.words(data[offsets[0]:offsets[-1]], offsets - offsets[0])
                own, n = tv.shingles(hashes, words, SHINGLE)
                s.append(own)
                r.append(np.repeat(np.arange(len(n)), n))
                counts.append(n)
            s, r = np.concatenate(s), np.concatenate(r)
            order = np.lexsort((s, r))
            s, r = s[order], r[order]
            both = np.bincount(r[1:][(s[1:] == s[:-1]) & (r[1:] == r[:-1])], minlength=part.num_rows)
            union = counts[0] + counts[1] - both
            yield part.select(["a", "b"]).filter(pa.array((100 * both >= PERCENT * union) & (both > 0)))


def _grouped(batches, names: list[str], solve):
    """``solve`` for each run of rows that agree in ``names`` (sorted by them)."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not held.num_rows:
            held = None
            continue
        group = np.stack([held.column(c).to_numpy(zero_copy_only=False) for c in names])
        cuts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1
        if len(cuts):
            yield from solve(held.slice(0, int(cuts[-1])), cuts[:-1].tolist())
            held = held.slice(int(cuts[-1]))
    if held is not None:
        group = np.stack([held.column(c).to_numpy(zero_copy_only=False) for c in names])
        yield from solve(held, (np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist())


class _Forest:
    """Union of the components ``comp`` of some rows; tells which unions were new."""

    def __init__(self, comp: np.ndarray):
        _, self.label = np.unique(comp, return_inverse=True)

    def join(self, x: np.ndarray, y: np.ndarray) -> list[int]:
        """Positions of the pairs (x, y) that join two parts."""
        out = []
        for k in np.flatnonzero(self.label[x] != self.label[y]).tolist():
            a, b = self.label[x[k]], self.label[y[k]]
            if a != b:
                self.label[self.label == b] = a
                out.append(k)
        return out


def _linked_by_sketch(batches):
    """Pairs of components (a, b) with members in one bucket whose sketches agree: a
    spanning forest for each group (key, i, j), which has two blocks at most."""
    def solve(rows, cuts):
        i, j, block, comp = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "block", "comp"))
        sketch, found = _bytes_matrix(rows.column("sketch")), []
        for lo, hi in zip([0, *cuts], [*cuts, rows.num_rows], strict=True):
            forest = _Forest(comp[lo:hi])
            for lag in range(1, hi - lo):
                x = np.arange(lo, hi - lag)
                # a pair inside one block belongs to the group i = j
                x = x[(block[x] != block[x + lag]) | (i[lo] == j[lo])]
                x = x[forest.label[x - lo] != forest.label[x + lag - lo]]
                x = x[estimate(sketch[x], sketch[x + lag]) >= LEAST_ESTIMATE]
                found += [(comp[x[k]], comp[x[k] + lag]) for k in forest.join(x - lo, x + lag - lo)]
        yield _pairs(found)
    yield from _grouped(batches, ["key", "i", "j"], solve)


def _linked_by_sets(batches):
    """Links (a, b) between components, from the full sets of all members of a
    group (cluster, i, j): a spanning forest of them."""
    def solve(rows, cuts):
        i, j, block, rep, comp = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "block", "rep", "comp"))
        found = []
        for lo, hi in zip([0, *cuts], [*cuts, rows.num_rows], strict=True):
            if (comp[lo:hi] == comp[lo]).all():
                continue
            inter, n = _intersections(rows.column("text").slice(lo, hi - lo))
            near = 100 * inter >= PERCENT * (n[:, None] + n[None, :] - inter)
            near &= (inter > 0) & (comp[lo:hi, None] != comp[None, lo:hi])
            if i[lo] != j[lo]:
                near &= block[lo:hi, None] != block[None, lo:hi]
            x, y = np.nonzero(np.triu(near, 1))
            found += [(rep[lo + x[k]], rep[lo + y[k]]) for k in _Forest(comp[lo:hi]).join(x, y)]
        yield _pairs(found)
    yield from _grouped(batches, ["cluster", "i", "j"], solve)


def _pairs(found: list) -> pa.RecordBatch:
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _intersections(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the pairwise intersections, set sizes) of the texts' shingle sets."""
    sets, owners, sizes = [], [], []
    for at, data, offsets in tv.slices(col):
        hashes, _, _, counts = tv.words(data, offsets)
        s, n = tv.shingles(hashes, counts, SHINGLE)
        sets.append(s)
        owners.append(np.repeat(np.arange(len(n)) + at, n))
        sizes.append(n)
    s, r, n = np.concatenate(sets), np.concatenate(owners), np.concatenate(sizes)
    _, column, times = np.unique(s, return_inverse=True, return_counts=True)
    shared = times > 1
    keep = shared[column]
    column, r = (np.cumsum(shared) - 1)[column[keep]], r[keep]
    order = np.argsort(column, kind="stable")
    column, r = column[order], r[order]
    inter, width = np.zeros((len(n), len(n))), 8192
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        table = np.zeros((len(n), width), np.float32)
        table[r[a:b], column[a:b] - lo] = 1
        inter += table @ table.T
    return inter, n


def _verify(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; ``texts``: (doc_id, text)."""
    pairs = materialize(pairs, "candidates")
    heavy = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("w"))
    hubs = materialize(reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")).join(heavy, "a"), "hubs")
    signed = pairs.join(reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    pairs = materialize(join_unique(signed, hubs, ["a"], "w").select("a", "b", "sa", "sb").mapInArrow(
        _near_by_sketch, "a long, b long"), "near")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).groupBy(
        "doc_id").agg(F.count(F.lit(1)).alias("w"))
    ids = materialize(ids, "pair-ids")
    used = materialize(join_unique(texts, ids, ["doc_id"], "w", hot_keys=200_000), "pair-texts")
    first = pairs.join(used.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    whole = join_salted(first, used.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"), "w"), ["a"], "w", ["b"])
    return materialize(whole.select("a", "b", "ta", "tb").mapInArrow(_confirmed, "a long, b long").distinct(), "verified")


def _resolve(clusters: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the components of each cluster (v: component, c: cluster), all
    pairs of its members compared on their full sets, in blocks."""
    grown = clusters.toDF("comp", "cluster")
    member = reps.select("rep").join(labels.toDF("rep", "label"), "rep", "left").select(
        "rep", F.coalesce("label", "rep").alias("comp")).join(grown, "comp")
    member = materialize(member, "cluster-members")
    sizes = materialize(member.groupBy("cluster").agg(F.count(F.lit(1)).alias("w")), "cluster-sizes")
    ids = member.select(F.col("rep").alias("doc_id")).withColumn("w", F.lit(1))
    used = join_unique(texts, materialize(ids, "cluster-ids"), ["doc_id"], "w", hot_keys=200_000)
    blocks = F.ceil(F.col("w") / F.greatest(F.lit(CLUSTER_BLOCK), F.ceil(F.sqrt("w")))).cast("int")
    dealt = join_unique(member, sizes, ["cluster"], "w").withColumn(
        "block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("blocks", blocks)
    read = dealt.drop("w").join(used.select(F.col("doc_id").alias("rep"), "text"), "rep").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = read.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block",
                          "rep", "comp", "text").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return materialize(grouped.mapInArrow(_linked_by_sets, "a long, b long").distinct(), "resolved")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sig = materialize(rows.mapInArrow(_signatures, _SIG), "signatures")
    known = sig.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = known.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "sketch", "bands")).alias("r"),
                                                 F.count(F.lit(1)).alias("size"))
    classes = materialize(classes.select("s1", "s2", "n", "size", F.col("r.doc_id").alias("rep"),
                                         F.col("r.sketch").alias("sketch"), F.col("r.bands").alias("bands")), "classes")
    reps = classes.select("rep", "sketch")
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    buckets = materialize(keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("c"))
                          .filter(F.col("c") > 1), "buckets")
    members = materialize(join_unique(keyed, buckets, ["key"], "c"), "members")
    stars = members.filter(F.col("rep") != F.col("hub")).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    texts = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    links = _verify(stars, reps, texts)
    # rows of one doc_id with different sets are linked through it
    several = known.select("doc_id", "s1", "s2", "n").distinct().groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id")
    if several.limit(1).count():
        own = known.join(several, "doc_id").join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"])
        links = materialize(links.unionByName(own.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))), "links")
    labels = components(links)
    # buckets whose members are in different components, but for the hub's own pairs, which are verified
    open_ = members.filter((F.col("c") > 2) & (F.col("rep") != F.col("hub"))).join(
        labels.toDF("rep", "label"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("comp"))
    mixed = open_.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("w")).filter("lo < hi")
    mixed = materialize(mixed, "mixed")
    left = join_unique(open_, mixed, ["key"], "w")
    blocks = F.ceil(F.col("w") / F.lit(BLOCK)).cast("int")
    dealt = left.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block",
                         "rep", "comp").join(reps, "rep")
    grouped = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    close = grouped.select("key", "i", "j", "block", "rep", "comp", "sketch").mapInArrow(_linked_by_sketch, "a long, b long")
    close = materialize(close.distinct(), "close")
    if close.limit(1).count():
        links = materialize(links.unionByName(_resolve(components(close), labels, reps, texts)), "links")
        labels = components(links)
    final = classes.select("s1", "s2", "n", "size", "rep").join(labels.toDF("rep", "label"), "rep", "left").select(
        "s1", "s2", "n", "size", F.coalesce("label", "rep").alias("component_id"))
    final = materialize(final, "components")
    lean = sig.select("doc_id", "n", "s1", "s2")
    alone = lean.filter(F.col("doc_id").isNull() | (F.col("n") == 0)).withColumn("component_id", F.col("doc_id"))
    linked = join_unique(lean.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0)), final, ["s1", "s2", "n"], "size")
    out = linked.select("doc_id", "n", "component_id").unionByName(alone.select("doc_id", "n", "component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stand for their component, all columns kept."""
    docs = without(docs, "_gone_id")
    gone = near_duplicates(docs, doc_id, text).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(materialize(gone, "gone"), F.col(doc_id) == F.col("_gone_id"), "left_anti")
