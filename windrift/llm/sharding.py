"""Shards of near-equal bytes by minimax contiguous partition.

Rows of equal text form an atomic group.  Groups are ordered by size, largest
first, then by the hash of their text.  The smallest capacity for which a greedy
pass needs no more than the wanted shards is found by binary search.  The order is cut
into shards of at most this capacity, each as near to the even share of what is
left as the capacity of the shards behind it allows.

The greedy check needs group sizes only, and in this order they are runs of equal
sizes: the driver holds (size, count) pairs, of which there are at most
sqrt(2 * total bytes), and checks a capacity in one pass over the runs.  The
few cuts that fall inside a run are placed by the hash order, in buckets.

Edge cases: a null text has no bytes and the crc of none, and groups with the empty
text; rows of one doc_id are rows of their own; a group larger than the even share
makes its own shard as large as itself; fewer groups than shards leave the last
shards empty; an empty table gives no rows; extra columns are kept but for those
named like an output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrift.llm.common import digest, join_unique, materialize, without

SHARDS = 40
#: Bytes that a row counts besides its text.
OVERHEAD = 16
#: Buckets of the slot numbering, per shard, and of the places inside a run of equal sizes.
BUCKETS = 256


def cuts_at(runs: list[tuple[int, int]], capacity: int, shards: int) -> list[tuple[int, int]] | None:
    """First (run, place in it) of every shard but the first in a greedy pass over
    ``runs`` (size, count); None if more than ``shards`` shards are needed."""
    cuts, room = [], capacity
    for r, (size, count) in enumerate(runs):
        if size > capacity:
            return None
        done = min(count, room // size)
        room -= done * size
        while done < count:
            cuts.append((r, done))
            if len(cuts) >= shards:
                return None
            take = min(count - done, capacity // size)
            done, room = done + take, capacity - take * size
    return cuts


def smallest_capacity(runs: list[tuple[int, int]], shards: int) -> int:
    """The least capacity whose greedy pass needs at most ``shards`` shards."""
    total = sum(s * c for s, c in runs)
    low = max([max((s for s, _ in runs), default=1), -(-total // shards)])
    high = low + max((s for s, _ in runs), default=0)
    while low < high:
        mid = (low + high) // 2
        if cuts_at(runs, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def level_cuts(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """Cuts within the smallest capacity, with the shards as even as it allows: each
    takes its share of what is left, or more where the rest would not fit."""
    capacity = smallest_capacity(runs, shards)
    left = sum(s * c for s, c in runs)
    rest, skipped, cuts = list(runs), 0, []
    # rest: the runs behind the last cut, the first of which began ``skipped`` groups earlier
    for k in range(shards - 1, 0, -1):
        share, fill, r, place = left / (k + 1), 0, 0, 0
        while r < len(rest):
            size, count = rest[r]
            take = min(count, int((share - fill) // size) + 1) if fill < share else 0
            if take and (fill + take * size > capacity or fill + take * size - share > share - fill - (take - 1) * size):
                take -= 1
                if not fill and not take:  # a single group above the share
                    take = 1
            fill, place = fill + take * size, take
            if take < count:
                break
            r, place = r + 1, 0
        behind = [(rest[r][0], rest[r][1] - place), *rest[r + 1:]] if r < len(rest) else []
        if behind and cuts_at(behind, capacity, k) is None:  # the greedy cut always leaves what fits
            r, place = cuts_at(rest, capacity, k + 1)[0]
            fill = sum(s * c for s, c in rest[:r]) + place * rest[r][0]
            behind = [(rest[r][0], rest[r][1] - place), *rest[r + 1:]]
        if not behind:
            break
        done = len(runs) - len(rest) + r
        cuts.append((done, place + (skipped if r == 0 else 0)))
        skipped = cuts[-1][1]
        rest, left = behind, left - fill
    return cuts


def _boundaries(groups: DataFrame, runs: list[tuple[int, int]], cuts: list[tuple[int, int]]) -> list[tuple]:
    """(size, h1, h2) of the first group of every shard but the first."""
    sizes = sorted({runs[r][0] for r, _ in cuts})
    inside = groups.filter(F.col("bytes").isin(sizes)).withColumn(
        "bucket", F.shiftright("h1", 56) + F.lit(128))  # in the order of the signed hash
    counts = inside.groupBy("bytes", "bucket").count().collect()  # at most BUCKETS for each cut
    wanted = []
    for r, place in cuts:
        size = runs[r][0]
        for bucket, n in sorted((x["bucket"], x["count"]) for x in counts if x["bytes"] == size):
            if place < n:
                wanted.append((size, bucket, place + 1))
                break
            place -= n
    some = groups.sparkSession.createDataFrame(wanted, "bytes long, bucket long, place int")
    near = inside.join(F.broadcast(some.select("bytes", "bucket").distinct()), ["bytes", "bucket"])
    order = Window.partitionBy("bytes", "bucket").orderBy("h1", "h2")
    ranked = near.withColumn("place", F.row_number().over(order)).join(F.broadcast(some), ["bytes", "bucket", "place"])
    return [(x["bytes"], x["h1"], x["h2"]) for x in ranked.select("bytes", "h1", "h2").collect()]


def _shard_of(size: Column, h1: Column, h2: Column, starts: list[tuple]) -> Column:
    out = F.lit(0)
    for s, a, b in starts:
        after = (h1 > a) | ((h1 == a) & (h2 >= b))
        out = out + ((size < s) | ((size == s) & after)).cast("int")
    return out


def assign(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot."""
    t = F.coalesce(F.col(text), F.lit(""))
    h1, h2 = digest(t)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + F.lit(OVERHEAD)).cast("long").alias("size"),
                       F.crc32(t.cast("binary")).alias("text_crc32"), h1.alias("h1"), h2.alias("h2"))
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    groups = materialize(groups, "shard-groups")
    runs = [(r["bytes"], r["count"]) for r in groups.groupBy("bytes").count().collect()]
    runs.sort(reverse=True)
    cuts = level_cuts(runs, shards)
    starts = _boundaries(groups, runs, cuts) if cuts else []
    # groups of one row need no join to know their size
    several = groups.filter(F.col("n") > 1)
    marked = join_unique(rows, materialize(several, "shard-copies"), ["h1", "h2"], "n", "left")
    placed = marked.withColumn("shard", _shard_of(F.coalesce("bytes", "size"), F.col("h1"), F.col("h2"), starts))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "bucket"), "shard-placed")
    sizes = placed.groupBy("shard", "bucket").count()  # at most shards * BUCKETS rows
    behind = sizes.withColumn("base", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("at", F.row_number().over(order) - 1)
    out = numbered.join(F.broadcast(behind.drop("count")), ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with its ``shard``; rows of one text share it."""
    docs = without(docs, "shard", "_id", "_crc", "_size")
    t = F.coalesce(F.col(text), F.lit(""))
    where = assign(docs, shards, doc_id, text).select(
        F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), "shard").distinct()
    met = docs.join(where, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.crc32(t.cast("binary")) == F.col("_crc"))
                    & (F.octet_length(t) + OVERHEAD == F.col("_size")))
    return met.drop("_id", "_crc", "_size")
