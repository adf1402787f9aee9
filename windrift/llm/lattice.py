"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into segments at the places that no piece spans (neither the blanks
nor a pair of neighbouring characters that occurs in a piece), the distinct
segments are counted, and each is encoded once: its substrings of bounded length are
exploded - those that rolling hashes of the table's prefixes let pass -, equi-joined to
the piece table, grouped by segment, and folded left to right by a Viterbi step in
``aggregate``.

The models in use are BPE models.  Their encoding is the path whose merges (priority,
place), compared smallest first, come first; a merge set that continues where another
ends is better.  A merge makes a piece, which is an edge of the lattice too, so the
merges of a segment are numbered by its edges and each is worth a power of two, the
first one most.  The score of a piece is the sum of its merges, the score of a path adds
up along it as log-probabilities would, and the best sum gives the library's ids.

Single characters cost nothing, so they take no part in the join: a step starts from the
character before its end, and the joined edges of two or more characters compete with it.

A score has ``MERGES`` bits, so segments with more edges of two or more characters, or of
more than ``LONGEST`` characters (runs without any break), are merged by a heap instead.

Edge cases: a null or empty text has no ids; characters outside the vocabulary are
encoded as their bytes; U+2581 in a text reads as a blank, as in the library;
repeated rows are encoded each; an empty table gives no rows; extra columns are
kept, but for those named like an output.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrift.llm import textvec as tv
from windrift.llm.common import let, materialize, without, write_table

BLANK = "▁"
#: Characters of the longest segment that the lattice takes, and its edges of two or more characters (bits of a score).
LONGEST = 40
MERGES = 63
#: Stands first among the places of a segment; its row carries what the segment has once.
NO_PLACE = -1
#: Entries of the segment dictionary that is broadcast (about 20 bytes each); rarer segments are joined by a shuffle.
DICTIONARY = 4_000_000
#: Distinct segments that a task counts before it puts them out.
HELD = 150_000
#: Segments whose edges a task groups in memory at a time, about 3 kB each.
GROUPED = 20_000
#: Ids that decoding takes at a time.
SLICE_IDS = 200_000


_STEP, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _char_hash(points: np.ndarray) -> np.ndarray:
    return tv.mix(points.astype(np.uint64) + np.uint64(0x51_7C_C1))


class Pieces:
    """The piece table of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte0 = model.piece_to_id("<0x00>")
        if not model.is_byte(self.byte0):
            raise ValueError("a model with byte fallback is needed")
        if n > 1 << 16:
            raise ValueError("a vocabulary of at most 65,536 pieces is needed")
        self.ids = {model.id_to_piece(i): i for i in range(n)
                    if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))}
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[model.get_score(i)] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.char_id = np.full(0x110000, -1, np.int32)
        singles = [p for p in self.ids if len(p) == 1]
        self.char_id[[ord(p) for p in singles]] = [self.ids[p] for p in singles]
        self.reach: list[tuple[np.ndarray, np.ndarray]] | None = None
        chars = sorted({c for p in self.ids if len(p) > 1 for c in p})
        self.char_class = np.zeros(0x110000, np.uint16)
        self.char_class[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joins = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.ids:
            k = self.char_class[[ord(c) for c in p]]
            self.joins[k[:-1], k[1:]] = True
        spelled = [b""] * n
        for p, i in self.ids.items():
            spelled[i] = p.replace(BLANK, " ").encode()
        for b in range(256):
            spelled[self.byte0 + b] = bytes([b])
        self.spelled_len = np.array([len(s) for s in spelled])
        self.spelled_at = np.cumsum(self.spelled_len) - self.spelled_len
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def _reach(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """By length in characters: the sorted hashes of all prefixes of reached pieces, and which of them are pieces."""
        heads: list[dict[int, bool]] = [{} for _ in range(self.longest)]
        chars = sorted({c for p in self.ids for c in p})
        own = dict(zip(chars, _char_hash(np.array([ord(c) for c in chars])).tolist(), strict=True))
        for p in self.ids:
            if len(self.merge(p)[0]) > 1:
                continue
            h = 0
            for k, c in enumerate(p):
                h = (h * _STEP + own[c]) & _MASK
                heads[k][h] = heads[k].get(h, False) or k == len(p) - 1
        out = []
        for found in heads:
            keys = np.array(sorted(found), np.uint64)
            out.append((keys, np.array([found[h] for h in keys.tolist()], bool)))
        return out

    def spans(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last + 1) of every substring that is a reached piece, by last, then first.  ``ends``: for each code
        point, where its segment ends."""
        if self.reach is None:
            self.reach = self._reach()
        own = _char_hash(points)
        start = np.arange(len(points))
        h = np.zeros(len(points), np.uint64)
        firsts, lasts = [], []
        for k, (keys, whole) in enumerate(self.reach):
            inside = start + k < ends[start]
            start, h = start[inside], h[inside]
            if not len(start) or not len(keys):
                break
            h = h * np.uint64(_STEP) + own[start + k]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[at] == h
            start, h, at = start[known], h[known], at[known]
            firsts.append(start[whole[at]])
            lasts.append(firsts[-1] + k + 1)
        first, last = np.concatenate(firsts), np.concatenate(lasts)
        order = np.lexsort((first, last))
        return first[order], last[order]

    def merge(self, segment: str) -> tuple[list[str], list[tuple[int, int]]]:
        """The pieces of a segment and its merges (priority, place), by a heap."""
        part = list(segment)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap, done = [], []

        def propose(i, j):
            if 0 <= i and j < n:
                r = self.rank.get(part[i] + part[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, j, part[i] + part[j]))

        for i in range(n - 1):
            propose(i, i + 1)
        while heap:
            r, i, j, whole = heapq.heappop(heap)
            if part[i] is None or part[j] is None or after[i] != j or part[i] + part[j] != whole:
                continue
            done.append((r, i))
            part[i], part[j] = whole, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            propose(before[i], i)
            propose(i, after[i])
        return [p for p in part if p is not None], done

    def encode_long(self, segment: str) -> list[int]:
        out = []
        for p in self.merge(segment)[0]:
            out.extend([self.ids[p]] if p in self.ids else [self.byte0 + b for b in p.encode()])
        return out


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _prepared(col: pa.Array) -> pa.Array:
    """Texts with the leading blank and visible blanks."""
    col = (col.fill_null("") if col.null_count else col).cast(pa.large_string())
    visible = pc.replace_substring(col, " ", BLANK)
    led = pc.binary_join_element_wise(pa.scalar(BLANK, pa.large_string()), visible, pa.scalar("", pa.large_string()))
    return pc.if_else(pc.equal(pc.binary_length(col), 0), col, led)


def _prepared_slices(col: pa.Array):
    """``textvec.slices`` of the prepared texts, prepared one slice at a time."""
    for at, _, offsets in tv.slices(col, limit=1 << 20):
        data, own = tv.strings(_prepared(col.slice(at, len(offsets) - 1)))
        yield at, data[own[0]:own[-1]], own - own[0]


def segment_starts(model: Pieces, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of every segment; the segments tile the texts."""
    if not len(data):
        return np.zeros(0, np.int64)
    points, lead = tv.code_points(data)
    kind = model.char_class[points].astype(np.int32)
    cut = np.ones(len(points), bool)
    cut[1:] = ~model.joins.ravel()[kind[:-1] * len(model.joins) + kind[1:]]
    cut[np.searchsorted(lead, offsets[:-1][np.diff(offsets) > 0])] = True
    return lead[cut]


def _counting(path: str):
    def run(batches):
        model, held, n = pieces(path), [], 0
        for batch in batches:
            for _, data, offsets in _prepared_slices(batch.column(0)):
                first = segment_starts(model, data, offsets)
                if not len(first):
                    continue
                held.append(_distinct(data, first))
                n += len(held[-1][0])
                if n > 2 * HELD:
                    held, n = [_together(held)], 0
                    if len(held[0][0]) > HELD:
                        yield _counted(held[0])
                        held = []
                    else:
                        n = len(held[0][0])
        if held:
            yield _counted(_together(held))
    return run


def _distinct(data: np.ndarray, first: np.ndarray, hashes: np.ndarray | None = None, counts: np.ndarray | None = None):
    """(hashes, counts, lengths, bytes) of the distinct segments of ``data``, which start at ``first``; ``counts``: how often
    each stands for."""
    known = tv.span_hashes(data, first) if hashes is None else hashes
    if counts is None:
        own, at, total = np.unique(known, return_index=True, return_counts=True)
    else:
        own, at, back = np.unique(known, return_index=True, return_inverse=True)
        total = np.bincount(back, counts, len(own)).astype(np.int64)
    lens = np.diff(np.append(first, len(data)))[at]
    return own, total, lens, data[tv.ranges(first[at], lens)]


def _together(held: list[tuple]):
    """Distinct segments of several slices as one such tuple."""
    if len(held) == 1:
        return held[0]
    hashes, counts, lens, data = (np.concatenate(x) for x in zip(*held, strict=True))
    return _distinct(data, np.cumsum(lens) - lens, hashes, counts)


def _counted(distinct: tuple) -> pa.RecordBatch:
    _, counts, lens, data = distinct
    ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    names = pa.Array.from_buffers(pa.string(), len(lens), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([names, pa.array(counts, pa.int64())], ["segment", "n"])


def segments(texts: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(segment, n): the distinct segments of all texts and how often they occur."""
    own = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(_counting(path), "segment string, n long")
    return own.groupBy("segment").agg(F.sum("n").alias("n"))


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, merges): merges are priority << 20 | place, sorted; the last one makes the piece.  As long as the
    model's vocabulary."""
    model = pieces(path)
    rows = []
    for p, i in model.ids.items():
        whole, merges = model.merge(p)
        if len(whole) == 1:  # others are never reached
            rows.append((p, i, sorted(r << 20 | at for r, at in merges)))
    return spark.createDataFrame(rows, "piece string, id int, merges array<long>")


def scored(edges):
    """(end, start, score) of ``edges``: (place, id, merges); the last of its merges makes a piece."""
    def start(e):
        return e["place"].bitwiseAND(F.lit(63))
    # descending: the first merge has the highest number
    order = F.sort_array(F.transform(edges, lambda e: F.element_at(e["merges"], -1) + start(e)), asc=False)
    return let(order, lambda made: F.transform(edges, lambda e: F.struct(
        F.shiftright(e["place"], 6).alias("end"), start(e).alias("start"), F.aggregate(
            e["merges"], F.lit(0).cast("long"), lambda a, m: a + F.call_function(
                "shiftleft", F.lit(1).cast("long"), (F.array_position(made, m + start(e)) - 1).cast("int"))).alias("score"))))


def viterbi(edges, singles):
    """Ids on the best path over ``edges`` and over ``singles``, the ids of the characters.

    One step for each end appends the best score, of an edge or of the character before it; plain longs, as making structs
    and looking up places is what an interpreted fold spends its time on.  Then the path is read from its end: there alone
    the edge that gave the score is looked for."""
    def sums(best, own):
        return F.transform(own, lambda e: F.get(best, e["start"]) + e["score"])

    def forward(lines):
        return F.aggregate(F.sequence(F.lit(1), F.size(singles)), F.array(F.lit(0).cast("long")), lambda best, end: F.concat(
            best, F.array(F.greatest(F.array_max(sums(best, F.filter(lines, lambda e: e["end"] == end))), F.element_at(best, -1)))))

    def back(lines, best, path, end):
        def through(k):
            e = F.get(edges, k)
            taken = F.when(k < 0, F.array(F.get(singles, end - 1), (end - 1).cast("long"))).otherwise(
                F.array(e["id"], e["place"].bitwiseAND(F.lit(63)).cast("long")))
            return F.concat(F.slice(path, 1, F.size(path) - 1), taken)
        worth = F.transform(lines, lambda e: F.when(e["end"] == end, F.get(best, e["start"]) + e["score"]))
        at = let(F.array_position(worth, F.get(best, end)).cast("int") - 1, through)
        return F.when(F.element_at(path, -1) == end, at).otherwise(path)

    n = F.size(singles)
    return let(scored(edges), lambda lines: let(forward(lines), lambda best: F.aggregate(
        F.sequence(n, F.lit(1), F.lit(-1)), F.array(n.cast("long")), lambda path, end: back(lines, best, path, end),
        lambda path: F.reverse(F.slice(path, 1, F.size(path) - 1))))).cast("array<int>")


def encode_segments(counted: DataFrame, path: str) -> DataFrame:
    """(segment, n, ids) for (segment, n), written.  The grouping of edges would fall back to sorting them after a few
    groups; in a session of its own it keeps to hashing, with ``GROUPED`` segments a task."""
    spark = counted.sparkSession
    schema = "segment string, n long, places array<short>, singles array<long>"
    at = write_table(counted.mapInArrow(_placing(path), schema), "segments-counted")
    parts = spark.read.parquet(at).count() // GROUPED + spark.sparkContext.defaultParallelism
    side = spark.newSession()
    side.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(8 * GROUPED))
    dealt = side.read.schema(schema).parquet(at).repartition(parts, "segment")
    done = write_table(_encoded(dealt, path), "segments")
    return spark.read.schema("segment string, n long, ids array<int>").parquet(done)


def _placing(path: str):
    """Segments with ``places``: NO_PLACE, then end * 64 + start of their substrings of two or more characters that the
    piece table has, found by rolling hashes of its prefixes; the join holds them against the table.  ``singles``: the ids
    of the characters.  Both are null for segments that the lattice does not take."""
    def run(batches):
        model = pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                part = batch.slice(at, 50_000)
                data, offsets = tv.strings(part.column(0))
                data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
                points, lead = tv.code_points(data)
                bounds = np.searchsorted(lead, offsets)
                size = np.diff(bounds)
                row = np.repeat(np.arange(len(size)), size)
                unknown = np.bincount(row[model.char_id[points] < 0], minlength=len(size)) > 0
                fits = (size >= 2) & (size <= LONGEST) & ~unknown
                taken = fits[row]
                owner = row[taken]
                inner = (np.arange(len(points)) - bounds[:-1].repeat(size))[taken]
                first = last = np.zeros(0, np.int64)
                if len(owner):
                    ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) + 1
                    first, last = model.spans(points[taken], ends.repeat(np.diff(np.concatenate([[0], ends]))))
                    first, last = first[last - first > 1], last[last - first > 1]
                place = (inner[last - 1] + 1) * 64 + inner[first]
                per = np.bincount(owner[first], minlength=len(size))
                fits &= per <= MERGES
                keep = fits[owner[first]]
                place, per = place[keep], np.where(fits, per, 0)
                marked = np.insert(place, (np.cumsum(per) - per)[fits], NO_PLACE)
                ids = model.char_id[points[fits[row]]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), _lists(per + fits, pa.array(marked, pa.int16()), ~fits),
                     _lists(np.where(fits, size, 0), pa.array(ids, pa.int64()), ~fits)],
                    ["segment", "n", "places", "singles"])
    return run


def _encoded(counted: DataFrame, path: str) -> DataFrame:
    """(segment, n, ids) for (segment, n, places, singles).  A character that no piece joins to another is a segment by
    itself, so those outside the vocabulary never meet the lattice."""
    table = piece_table(counted.sparkSession, path)
    fits = F.col("places").isNotNull()
    head = F.col("place") == NO_PLACE
    sub = counted.filter(fits).select("segment", "n", "singles", F.explode("places").alias("p")).withColumn(
        "place", F.col("p").cast("int"))
    sub = sub.select("segment", F.when(head, F.col("n")).alias("n"), F.when(head, F.col("singles")).alias("singles"), "place", F.expr(
        f"if(place = {NO_PLACE}, null, substring(segment, (place & 63) + 1, shiftright(place, 6) - (place & 63)))").alias("piece"))
    met = sub.join(F.broadcast(table), "piece", "left")
    # one list for each segment, its own row first: n and the ids of its characters stand where edges have id and merges
    entry = F.struct("place", F.when(head, F.col("n")).otherwise(F.col("id").cast("long")).alias("id"),
                     F.when(head, F.col("singles")).otherwise(F.col("merges")).alias("merges"))
    entries = met.groupBy("segment").agg(
        F.sort_array(F.collect_list(F.when(head | F.col("id").isNotNull(), entry))).alias("entries"))
    words = entries.select("segment", F.col("entries")[0]["id"].alias("n"), F.col("entries")[0]["merges"].alias("singles"),
                           F.slice("entries", 2, F.size("entries")).alias("edges"))
    folded = words.select("segment", "n", viterbi(F.col("edges"), F.col("singles")).alias("ids"))

    def merged(batches):
        own = pieces(path)
        for b in batches:
            ids = [own.encode_long(s) for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))],
                                             ["segment", "n", "ids"])

    long = counted.filter(~fits).select("segment", "n").mapInArrow(merged, "segment string, n long, ids array<int>")
    return folded.unionByName(long)


def _packed(batches):
    """(hash, ids as 16-bit numbers) of dictionary rows."""
    for b in batches:
        data, offsets = tv.strings(b.column(0))
        data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        ids = b.column(1)
        at = np.asarray(ids.offsets)
        flat = np.asarray(ids.values)[at[0]:at[-1]].astype(np.uint16)
        packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(
            ((at - at[0]) * 2).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(tv.span_hashes(data, offsets[:-1]).view(np.int64)), packed], ["h", "p"])


def _dictionary(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes, first id, number of ids, ids) of at most DICTIONARY rows."""
    rows = table.select("segment", "ids").mapInArrow(_packed, "h long, p binary").toArrow().combine_chunks()
    if not rows.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint16), np.zeros(1, np.uint16)
    h = rows.column("h").to_numpy().view(np.uint64)
    p = rows.column("p").combine_chunks()
    p = p.chunk(0) if isinstance(p, pa.ChunkedArray) else p
    at = np.frombuffer(p.buffers()[1], np.int32 if p.type == pa.binary() else np.int64)[p.offset:p.offset + len(p) + 1] // 2
    order = np.argsort(h, kind="stable")
    return (h[order], at[:-1][order].astype(np.int32), np.diff(at)[order].astype(np.uint16),
            np.frombuffer(p.buffers()[2], np.uint16))


def _applying(path: str, shared, names: list[str], spell: bool):
    """Rows with ids; a segment outside the dictionary stands as -1 - its place in ``missing``.  ``spell``: also the
    text that the ids spell, for a dictionary that holds all segments."""
    def run(batches):
        model = pieces(path)
        keys, at, size, flat = shared.value
        for batch in batches:
            for row, data, offsets in _prepared_slices(batch.column(len(names))):
                first = segment_starts(model, data, offsets)
                n = len(offsets) - 1
                per_row = np.diff(np.searchsorted(first, offsets))
                hashes = tv.span_hashes(data, first)
                known = np.zeros(len(first), bool)
                where = np.zeros(len(first), np.int64)
                if len(keys):
                    uniq, back = np.unique(hashes, return_inverse=True)
                    place = np.minimum(np.searchsorted(keys, uniq), len(keys) - 1)
                    where, known = place[back], (keys[place] == uniq)[back]
                lens = np.where(known, size[where] if len(keys) else 1, 1).astype(np.int64)
                ids = np.empty(int(lens.sum()), np.int32)
                begin = np.cumsum(lens) - lens
                ids[tv.ranges(begin[known], lens[known])] = flat[tv.ranges(at[where[known]], lens[known])]
                lost = np.flatnonzero(~known)
                owner = np.repeat(np.arange(n), per_row)[lost]
                lost_per_row = np.bincount(owner, minlength=n)
                ids[begin[lost]] = -1 - (np.arange(len(lost)) - np.repeat(np.cumsum(lost_per_row) - lost_per_row, lost_per_row))
                ids_per_row = np.bincount(np.repeat(np.arange(n), per_row), lens, n).astype(np.int64)
                last = np.append(first[1:], len(data))
                raw = data.tobytes() if len(lost) else b""
                missing = pa.array([raw[first[i]:last[i]].decode() for i in lost], pa.string())
                lists = _lists(ids_per_row, pa.array(ids))
                last_column = _spelled(model, lists) if spell else _lists(lost_per_row, missing)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(row, n) for i in range(len(names))), lists, last_column],
                    [*names, "ids", "decoded" if spell else "missing"])
    return run


def _lists(sizes: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values,
                                    mask=None if null is None else pa.array(null))


def encode(docs: DataFrame, path: str, text: str = "text", dictionary: int = DICTIONARY,
           spell: bool = False) -> DataFrame:
    """``docs`` (less the text) with ``ids``: array<int>; with ``spell`` also ``decoded``, as ``decode`` gives it, from
    the same task where that can be."""
    docs = without(docs, "ids", "missing", "decoded", "_row", "_place", "segment")
    spark = docs.sparkSession
    table = encode_segments(segments(docs, path, text), path)
    # the most frequent segments, as many as the bound allows: at most total / n of them occur n times
    steps = table.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().orderBy(F.desc("n")).collect()
    least, taken = 10_001, 0
    for r in steps:
        if taken + r["count"] > dictionary:
            break
        taken, least = taken + r["count"], r["n"]
    cold = taken < sum(r["count"] for r in steps)
    shared = spark.sparkContext.broadcast(_dictionary(table.filter(F.col("n") >= least)))
    names = [c for c in docs.columns if c != text]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != text)
    out = docs.select(*names, F.col(text).cast("string").alias("_text")).mapInArrow(
        _applying(path, shared, names, spell and not cold),
        f"{fields}ids array<int>, " + ("decoded string" if spell and not cold else "missing array<string>"))
    if not cold:
        return out.drop("missing")
    out = materialize(out.withColumn("_row", F.expr("uuid()")), "encoded")
    asked = out.filter(F.size("missing") > 0).select("_row", F.posexplode_outer("missing").alias("_place", "segment"))
    found = asked.join(table.filter(F.col("n") < least).select("segment", F.col("ids").alias("_ids")), "segment")
    found = found.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_place", "_ids"))).alias("_found"))
    joined = out.join(found, "_row", "left")
    filled = F.flatten(F.transform("ids", lambda i: F.when(i >= 0, F.array(i)).otherwise(
        F.get(F.col("_found"), -1 - i)["_ids"])))
    done = joined.withColumn("ids", F.when(F.size("missing") > 0, filled).otherwise(F.col("ids"))).drop(
        "_row", "missing", "_found")
    return decode(done, path) if spell else done


def _spelled(model: Pieces, col: pa.ListArray) -> pa.Array:
    """The texts that lists of ids spell."""
    if col.null_count:
        col = pc.if_else(col.is_null(), pa.scalar([], col.type), col)
    at = np.asarray(col.offsets).astype(np.int64)
    ids = np.asarray(col.values)[at[0]:at[-1]]
    row = np.repeat(np.arange(len(col)), np.diff(at))
    lens = model.spelled_len[ids]
    data = model.spelled[tv.ranges(model.spelled_at[ids], lens)]
    sizes = np.bincount(row, lens, len(col)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    lead = np.flatnonzero(sizes > 0)  # the blank that was put in front goes
    keep = np.ones(len(data), bool)
    keep[ends[lead]] = data[ends[lead]] != 32
    sizes[lead] -= ~keep[ends[lead]]
    data = data[keep]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.large_string(), len(col), [None, pa.py_buffer(ends.tobytes()),
                                                               pa.py_buffer(data.tobytes())]).cast(pa.string())


def _spelling(path: str, names: list[str]):
    def run(batches):
        model = pieces(path)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(len(names))), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:  # some 200,000 ids at a time
                done = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + SLICE_IDS, "right")))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))),
                                                  _spelled(model, part.column(len(names)))], [*names, "decoded"])
                lo = hi
    return run


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text that the ids spell; null ids spell nothing."""
    encoded = without(encoded, "decoded")
    names = encoded.columns
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.schema.fields)
    return encoded.select(*names, F.col(ids).alias("_ids")).mapInArrow(_spelling(path, names), f"{fields}decoded string")
