"""The prefix trie of conversations, by ternary search trees over range shards.

A turn's key is the 128-bit digest of its role and text; a conversation is the string of its keys.  Equal
conversations are counted first, wherever they lie, so a group of copies is one string with a weight.  The strings
are dealt in ranges of their order.  A task numbers the turns of its shard by their order (its dictionary), enters the
strings into a ternary search tree, the middle one of each range first so that the tree is balanced, and walks the tree
without recursion, adding up members, leaves and savings.

Only the nodes on the path of a shard's first and last string can lie in another shard too.  They are put out apart, as
sums over the shard; once it is known how far neighbouring shards share a path, what was counted twice is taken off and
the sums of a node are added.  So the merge is one grouping of a few rows for each shard, whatever the depth.

Edge cases: a null conv_id is no conversation; null roles and texts are empty; turns of a conversation are ordered by
turn (null first), then role, then text, and repeated rows count each; a conversation without turns is a member of the
root alone; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrift.llm.common import join_unique, materialize

#: Turns that a rebuilt conversation may take from the first one of its hundred.
HEAD = 5
#: Conversations whose ids are hashed as one chunk.
CHUNK = 4096
#: Distinct conversations of a shard, about.
SHARD = 20_000
#: Bytes of a turn's key.
KEY = 16
NOTHING = hashlib.sha256(b"").hexdigest()


def head_size(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first one of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (HEAD + 1)).cast("int")


def _listed(turns: DataFrame) -> DataFrame:
    """(base, conv_id, keys, sizes) of the conversations as they are: the keys of their turns and their code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat_ws(":", F.char_length(role).cast("string"), role, text)))
    own = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"),
        F.char_length(text).alias("size"))
    # all rows of a hundred meet in one place, where both the grouping and the join below want them
    dealt = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).repartition("base")
    listed = F.sort_array(F.collect_list(F.struct("turn", "key", "size")))
    return dealt.groupBy("base", "conv_id").agg(listed.alias("t")).select(
        "base", "conv_id", F.transform("t", lambda x: x["key"]).alias("keys"), F.transform("t", lambda x: x["size"]).alias("sizes"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes) of the rebuilt conversations: the first turns come from the first conversation of the hundred;
    seq joins the keys of the turns, sizes has the code points of their texts."""
    own = _listed(turns)
    first = own.filter(F.col("conv_id") == F.col("base")).select(
        "base", F.slice("keys", 1, HEAD).alias("_keys"), F.slice("sizes", 1, HEAD).alias("_sizes"))
    both = own.join(first, "base", "left").withColumn("h", head_size(F.col("conv_id")))

    def built(name: str) -> Column:
        head = F.coalesce(F.slice(F.col(f"_{name}"), F.lit(1), F.col("h")), F.slice(F.col(name), 1, 0))
        return F.concat(head, F.slice(F.col(name), F.col("h") + 1, F.size(name) + 1))

    return both.select("conv_id", F.unhex(F.array_join(F.transform(built("keys"), F.hex), "")).alias("seq"), built("sizes").alias("sizes"))


def _chunks(batches):
    """Of rows sorted by (sid, conv_id): a row for each run of at most CHUNK ids of one sid, the string with the run."""
    def out(rows):
        return pa.RecordBatch.from_pylist(rows, _CHUNK_SCHEMA)

    rows, sid, ids, seq, sizes = [], None, [], None, None
    for batch in batches:
        for s, c, q, z in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), batch.column(3), strict=True):
            if s != sid or len(ids) == CHUNK:
                if ids:
                    rows.append({"sid": sid, "least": ids[0], "n": len(ids), "ids": ",".join(map(str, ids)), "seq": seq, "sizes": sizes})
                    seq = sizes = None
                if s != sid:
                    sid, seq, sizes = s, q.as_py(), z.as_py()
                ids = []
                if len(rows) >= 2000:
                    yield out(rows)
                    rows = []
            ids.append(c)
    if ids:
        rows.append({"sid": sid, "least": ids[0], "n": len(ids), "ids": ",".join(map(str, ids)), "seq": seq, "sizes": sizes})
    if rows:
        yield out(rows)


_CHUNK_SCHEMA = pa.schema([("sid", pa.binary()), ("least", pa.int64()), ("n", pa.int64()), ("ids", pa.string()),
                           ("seq", pa.binary()), ("sizes", pa.list_(pa.int32()))])
_STRING_SCHEMA = pa.schema([("seq", pa.binary()), ("sizes", pa.list_(pa.int32())), ("least", pa.int64()), ("n", pa.int64()),
                            ("ends", pa.string())])


def _weighed(batches):
    """Of chunks sorted by (sid, least): each string with its number of conversations and the digest of their ids."""
    rows, now, sid = [], None, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["sid"] != sid:
                if now:
                    rows.append(now | {"ends": digest.hexdigest()})
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, _STRING_SCHEMA)
                    rows = []
                sid, digest = r["sid"], hashlib.sha256()
                now = {"seq": r["seq"], "sizes": r["sizes"], "least": r["least"], "n": 0}
            else:
                digest.update(b",")
            digest.update(r["ids"].encode())
            now["n"] += r["n"]
    if now:
        rows.append(now | {"ends": digest.hexdigest()})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _STRING_SCHEMA)


def weighed(conversations: DataFrame) -> DataFrame:
    """(seq, sizes, least, n, ends): the distinct strings, their smallest conv_id, their number, and the SHA-256 of their
    conv_ids.  The ids of a string are dealt in ranges, joined there by the thousand, and hashed chunk after chunk."""
    own = conversations.select(F.unhex(F.md5("seq")).alias("sid"), "conv_id", "seq", "sizes")
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(parts, "sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    chunks = dealt.mapInArrow(_chunks, "sid binary, least long, n long, ids string, seq binary, sizes array<int>")
    return chunks.repartition("sid").sortWithinPartitions("sid", "least").mapInArrow(
        _weighed, "seq binary, sizes array<int>, least long, n long, ends string")


class SearchTree:
    """A ternary search tree over strings of turn numbers: below, equal and above links in growing arrays."""

    def __init__(self):
        self.key, self.below, self.equal, self.above, self.node = [], [], [], [], []
        # of trie nodes: parent, depth, key, weight and least id of the string that ends there, code points, end digest
        self.parent, self.depth, self.size, self.n, self.least, self.ends = [-1], [0], [0], [0], [None], [None]
        self.root = [-1]

    def _new(self, key, parent, size) -> int:
        self.key.append(key)
        for links in (self.below, self.equal, self.above):
            links.append(-1)
        self.node.append(len(self.parent))
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.size.append(size)
        self.n.append(0)
        self.least.append(None)
        self.ends.append(None)
        return len(self.key) - 1

    def insert(self, keys, sizes, n, least, ends) -> int:
        """Enters a string; returns its trie node."""
        links, slot, parent = self.root, 0, 0
        for key, size in zip(keys, sizes, strict=True):
            while (at := links[slot]) >= 0 and self.key[at] != key:
                links, slot = (self.below if key < self.key[at] else self.above), at
            if at < 0:
                at = links[slot] = self._new(key, parent, size)
            parent = self.node[at]
            links, slot = self.equal, at
        self.n[parent], self.least[parent], self.ends[parent] = n, least, ends
        return parent


def _median_order(n: int):
    """The middle of each range before its halves."""
    stack = [(0, n)]
    while stack:
        lo, hi = stack.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            stack += [(mid + 1, hi), (lo, mid)]


_NODE_SCHEMA = pa.schema([(c, pa.int64()) for c in ("shard", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                                    "saved_tokens", "down", "above")]
                         + [("ends_sha256", pa.string()), ("node", pa.binary()), ("parent", pa.binary()), ("on_first", pa.bool_()),
                            ("on_last", pa.bool_()), ("first", pa.binary()), ("last", pa.binary())])


def _prefixes(seq: bytes) -> list[bytes]:
    """A digest of every prefix, the empty one first."""
    run, out = hashlib.md5(), [hashlib.md5().digest()]
    for at in range(0, len(seq), KEY):
        run.update(seq[at:at + KEY])
        out.append(run.copy().digest())
    return out


def _nodes(batches):
    """The nodes of one shard, whose rows are sorted by seq.  Nodes on the paths of the first and last string carry a digest
    and sums over the shard; ``down`` and ``above`` are then the code points on the path with and without the node's own."""
    from pyspark import TaskContext
    shard = TaskContext.get().partitionId()
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    turns = sorted({r["seq"][k:k + KEY] for r in rows for k in range(0, len(r["seq"]), KEY)})
    number = {t: i for i, t in enumerate(turns)}
    tree, ends_at = SearchTree(), [0] * len(rows)
    for i in _median_order(len(rows)):
        r = rows[i]
        keys = [number[r["seq"][k:k + KEY]] for k in range(0, len(r["seq"]), KEY)]
        ends_at[i] = tree.insert(keys, r["sizes"], r["n"], r["least"], r["ends"])
    count = len(tree.parent)
    n, least, children, leaves, saved = list(tree.n), list(tree.least), [0] * count, [0] * count, [0] * count
    for v in range(count - 1, -1, -1):  # a node is made after its parent, so this meets children first
        leaves[v] = leaves[v] or 1
        saved[v] += (n[v] - 1) * tree.size[v]
        p = tree.parent[v]
        if p >= 0:
            n[p] += n[v]
            least[p] = least[v] if least[p] is None else min(least[p], least[v])
            children[p] += 1
            leaves[p] += leaves[v]
            saved[p] += saved[v]
    paths = {}  # node on a path -> (digest, digest of its parent, on the first path, on the last path, code points down to it)
    for which, row in ((0, 0), (1, len(rows) - 1)):
        v, path = ends_at[row], []
        while v >= 0:
            path.append(v)
            v = tree.parent[v]
        digests, down = _prefixes(rows[row]["seq"]), 0
        for d, v in enumerate(reversed(path)):
            down += tree.size[v]
            old = paths.get(v, (None, None, False, False, 0))
            paths[v] = (digests[d], digests[d - 1] if d else None, old[2] or which == 0, old[3] or which == 1, down)
    out = []
    for v in range(count):
        p = tree.parent[v]
        on = paths.get(v)
        above = paths.get(p)
        out.append({"shard": shard, "conv_id": least[v], "depth": tree.depth[v],
                    "parent_conv_id": least[p] if p >= 0 and not above else None, "n_convs": n[v], "n_children": children[v],
                    "n_leaves": leaves[v], "saved_tokens": saved[v], "down": on[4] if on else None, "above": on[4] - tree.size[v] if on else None, "ends_sha256": tree.ends[v],
                    "node": on[0] if on else None, "parent": above[0] if above else None,
                    "on_first": bool(on and on[2]), "on_last": bool(on and on[3]), "first": None, "last": None})
        if len(out) >= 5000:
            yield pa.RecordBatch.from_pylist(out, _NODE_SCHEMA)
            out = []
    out.append({"shard": shard, "first": rows[0]["seq"], "last": rows[-1]["seq"]})
    yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in _NODE_SCHEMA} for r in out], _NODE_SCHEMA)


def _shared(batches):
    """Turns that two strings begin with alike, and whether the first is a proper prefix of the second."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            x, y = r["before"], r["after"]
            k = min(len(x), len(y)) // KEY
            differ = np.flatnonzero((np.frombuffer(x[:k * KEY], np.uint8) != np.frombuffer(y[:k * KEY], np.uint8)).reshape(k, KEY).any(1))
            alike = int(differ[0]) if len(differ) else k
            out.append((alike, alike * KEY == len(x)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a for a, _ in out], pa.int64()), pa.array([p for _, p in out], pa.bool_())],
                                         ["shard", "alike", "goes_on"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = materialize(weighed(rebuilt(turns)), "conversations")
    n = found.count()
    shards = max(n // SHARD + 1, min(turns.sparkSession.sparkContext.defaultParallelism, n // 500 + 1))
    fields = ", ".join(f"{c} long" for c in _NODE_SCHEMA.names[:10])
    made = materialize(found.repartitionByRange(shards, "seq").sortWithinPartitions("seq").mapInArrow(
        _nodes, f"{fields}, ends_sha256 string, node binary, parent binary, on_first boolean, on_last boolean, first binary, last binary"),
        "nodes")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # how far the last string of a shard and the first of the next go together; a row for each shard
    edge = made.filter(F.col("first").isNotNull()).select("shard", "first", "last")
    beside = edge.select("shard", F.lag("last").over(Window.orderBy("shard")).alias("before"), F.col("first").alias("after"))
    met = beside.filter(F.col("before").isNotNull()).mapInArrow(_shared, "shard long, alike long, goes_on boolean")
    met = materialize(met, "edges")
    order = materialize(edge.select("shard", F.lead("shard").over(Window.orderBy("shard")).alias("next")), "shards")
    met = order.join(met, "shard", "left").join(met.select(F.col("shard").alias("next"), F.col("goes_on").alias("ends_on")), "next", "left")
    met = met.select("shard", F.coalesce("alike", F.lit(-1)).alias("alike"), F.coalesce("ends_on", F.lit(False)).alias("ends_on"))
    path = made.filter(F.col("node").isNotNull()).join(met, "shard")
    # of the nodes that an earlier shard has too, this shard's count of them goes: their code points, themselves as children
    was = F.col("on_first") & (F.col("depth") <= F.col("alike"))
    path = path.withColumn("deep", F.max(F.when(was, F.col("down"))).over(Window.partitionBy("shard")))
    merged = path.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") - (F.col("on_first") & (F.col("depth") < F.col("alike"))).cast("long")).alias("n_children"),
        F.sum(F.col("n_leaves") - (F.col("on_last") & F.col("ends_on")).cast("long")).alias("n_leaves"),
        F.sum(F.col("saved_tokens") + F.when(was, F.col("deep") - F.col("above")).otherwise(0)).alias("saved_tokens"),
        F.max("ends_sha256").alias("ends_sha256"))
    merged = materialize(merged, "merged")
    ups = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("_parent_conv"), F.col("n_children").alias("_weight"))
    inner = made.filter(F.col("node").isNull() & F.col("conv_id").isNotNull()).select(*columns, "parent")
    both = inner.filter(F.col("parent").isNotNull()).unionByName(merged.filter(F.col("parent").isNotNull()).withColumn(
        "parent_conv_id", F.lit(None).cast("long")).select(*columns, "parent"))
    joined = join_unique(both, ups, ["parent"], "_weight").withColumn("parent_conv_id", F.col("_parent_conv"))
    top = merged.filter(F.col("parent").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = joined.select(*columns).unionByName(top.select(*columns)).unionByName(
        inner.filter(F.col("parent").isNull()).select(*columns))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
