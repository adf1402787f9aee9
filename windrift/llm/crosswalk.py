"""Alignment of two tokenizers, A (byte-level BPE) and B (SentencePiece BPE), over the bytes of blank + text.

A task encodes a batch of texts with both, lays the tokens' ends on one line of bytes, and advances one NumPy
vector of pointer pairs over it in lockstep: every step links the A and the B token under each pair, marks a cut
where both end, moves on whichever ends first, and drops the pairs that are done.  A long text is walked by several
pairs, each over a stretch of ``LANE`` tokens of A, so the number of steps has a bound.

``align`` gives the links and cuts of each text, ``link_counts`` how often the corpus links each pair of ids, and
``score`` holds each text against those counts.

Edge cases: null and empty texts, and texts that the tokens of either side do not spell byte for byte (U+2581 in a
text reads as a blank in B), have no tokens: all numbers are 0 and ``groups`` is ''.  Strings of special tokens are
plain text.  Repeated rows count each; an empty table gives no rows; extra columns are kept, but for those named like
an output; nulls in other columns do not matter.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrift.llm import fst, lattice
from windrift.llm import textvec as tv
from windrift.llm.common import materialize, without
from windrift.llm.memo import Memo

#: Tokens of A that one pair of pointers walks.
LANE = 256
#: Bytes of a text that the library of B takes at a time, cut where no piece can span.
PART = 1 << 18
#: Pairs of ids whose counts are broadcast (13 bytes each); rarer pairs are joined by a shuffle.
DICTIONARY = 4_000_000
#: Distinct pairs that a task counts before it puts them out.
HELD = 1_000_000


class SideA:
    """Ids of byte-level BPE pre-tokens and the bytes that each id stands for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.counter = fst._counter(path)  # checks that the file is a plain byte-level BPE
        self.model = Tokenizer.from_file(path).model
        symbol = {b: c for c, b in fst._byte_symbols().items()}
        self.symbols = {b: symbol[b] for b in range(256)}
        back = fst._byte_symbols()
        vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
        spelled = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            if all(c in back for c in t):
                spelled[i] = bytes(back[c] for c in t)
        self.spelling = Spelling(spelled)
        self.memo = Memo()

    def encode_one(self, run: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(run.decode("latin-1").translate(self.symbols))]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text) of the texts that ``offsets`` cut from ``data``."""
        first, last, _ = fst.pre_tokens(data, offsets, [])
        at, size = self.memo.look_up(tv.span_hashes(data, first), first, last, data.tobytes(), self.encode_one)
        ends = np.concatenate([[0], np.cumsum(size)])
        per_text = np.diff(ends[np.searchsorted(first, offsets)])
        return self.memo.flat[tv.ranges(at, size)], per_text


class Spelling:
    """The bytes of every id."""

    def __init__(self, spelled: list[bytes]):
        self.size = np.array([len(s) for s in spelled], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(spelled), np.uint8)
        self.names = [str(i).encode() for i in range(len(spelled))]
        self.name_size = np.array([len(s) for s in self.names], np.int64)
        self.name_at = np.cumsum(self.name_size) - self.name_size
        self.name_data = np.frombuffer(b"".join(self.names), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[tv.ranges(self.at[ids], self.size[ids])]


class SideB:
    """Ids by the SentencePiece library and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = lattice.pieces(path)
        n = self.library.get_piece_size()
        spelled = [b""] * n
        for i in range(n):
            if self.library.is_byte(i):
                spelled[i] = bytes([int(self.library.id_to_piece(i)[3:-1], 16)])
            elif not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)):
                spelled[i] = self.library.id_to_piece(i).replace(lattice.BLANK, " ").encode()
        self.spelling = Spelling(spelled)

    def parts(self, text: str) -> list[str]:
        """The text cut at single blanks that no piece spans; the library puts the blank of each cut back."""
        kind, joins = self.table.char_class, self.table.joins
        to, out, at, seek = kind[ord(lattice.BLANK)], [], 0, PART
        while len(text) - at > PART:
            cut = text.find(" ", max(seek, at + 1))
            if cut < 0 or cut + 1 >= len(text):
                break
            before = text[cut - 1]
            if before not in (" ", lattice.BLANK) and text[cut + 1] not in (" ", lattice.BLANK) and not joins[kind[ord(before)], to]:
                out.append(text[at:cut])
                at, seek = cut + 1, cut + 1 + PART
            else:
                seek = cut + 1
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.parts(t) if len(t) > PART else [t] for t in texts]
        ids = self.library.encode([p for own in parts for p in own], num_threads=1) if parts else []
        size = np.array([len(x) for x in ids], np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        bounds = np.concatenate([[0], np.cumsum([len(own) for own in parts])]).astype(np.int64)
        return np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])), np.diff(ends[bounds])


@lru_cache(2)
def _sides(path_a: str, path_b: str) -> tuple[SideA, SideB]:
    a, b = SideA(path_a), SideB(path_b)
    if max(len(a.spelling.size), len(b.spelling.size)) > 1 << 16:
        raise ValueError("vocabularies of at most 65,536 ids are needed")
    return a, b


def lockstep(a_end: np.ndarray, b_end: np.ndarray, starts: np.ndarray, lane: int = LANE):
    """(A token, B token) of every link, and whether each A and each B token ends a group.  ``a_end`` and ``b_end`` are
    the tokens' ends on one line of bytes; ``starts`` are the A tokens that begin a text."""
    cut_a, cut_b = np.zeros(len(a_end), bool), np.zeros(len(b_end), bool)
    if not len(a_end):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), cut_a, cut_b
    size = np.diff(np.append(starts, len(a_end)))
    lanes = -(-size // lane)
    a = np.repeat(starts, lanes) + lane * tv.ranges(np.zeros(len(lanes), np.int64), lanes)
    stop = np.append(a[1:], len(a_end))
    begin = np.where(a > 0, a_end[a - 1], 0)
    b = np.searchsorted(b_end, begin, "right")
    links_a, links_b = [], []
    while len(a):
        links_a.append(a)
        links_b.append(b)
        at_a, at_b = a_end[a], b_end[b]
        both = at_a == at_b
        cut_a[a[both]] = True
        cut_b[b[both]] = True
        a, b = a + (at_a <= at_b), b + (at_b <= at_a)
        live = a < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    return np.concatenate(links_a), np.concatenate(links_b), cut_a, cut_b


def _groups(side_a, side_b, a, b, cut_a, cut_b, text_a, text_b, n) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of each text) of `a1,a2|b1;a3|b2,b3`."""
    group_a = np.cumsum(cut_a) - cut_a
    group_b = np.cumsum(cut_b) - cut_b
    # the tokens in order of group, those of A first
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    total = len(a) + len(b)
    size, source, mark, text = (np.zeros(total, np.int64) for _ in range(4))
    size[place_a], size[place_b] = side_a.spelling.name_size[a], side_b.spelling.name_size[b]
    shift = len(side_a.spelling.name_data)
    source[place_a], source[place_b] = side_a.spelling.name_at[a], side_b.spelling.name_at[b] + shift
    text[place_a], text[place_b] = text_a, text_b
    mark[place_a] = np.where(cut_a, ord("|"), ord(","))
    mark[place_b] = np.where(cut_b, ord(";"), ord(","))
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True)) if total else np.zeros(0, np.int64)
    with_mark = size + 1
    with_mark[last] -= 1
    end = np.cumsum(with_mark)
    out = np.zeros(int(end[-1]) if total else 0, np.uint8)
    names = np.concatenate([side_a.spelling.name_data, side_b.spelling.name_data])
    out[tv.ranges(end - with_mark, size)] = names[tv.ranges(source, size)]
    marked = np.ones(total, bool)
    marked[last] = False
    out[end[marked] - 1] = mark[marked]
    return out, np.bincount(text, with_mark, n).astype(np.int64) if total else np.zeros(n, np.int64)


def _same(spelling: Spelling, ids, per_text, data, offsets) -> np.ndarray:
    """Whether the ids of each text spell its bytes."""
    n = len(per_text)
    row = np.repeat(np.arange(n), per_text)
    size = np.bincount(row, spelling.size[ids], n).astype(np.int64)
    same = size == np.diff(offsets)
    keep = np.repeat(same, per_text)
    got = spelling.spell(ids[keep])
    own = np.repeat(same, np.diff(offsets))
    bad = np.flatnonzero(got != data[own])
    if len(bad):
        ends = np.cumsum(size[same])
        same[np.flatnonzero(same)[np.unique(np.searchsorted(ends, bad, "right"))]] = False
    return same


def _binary(values: np.ndarray, per_text: np.ndarray) -> pa.Array:
    """A binary column with the 32-bit numbers of each text."""
    ends = np.concatenate([[0], np.cumsum(per_text) * 4]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(per_text), [None, pa.py_buffer(ends.tobytes()),
                                                              pa.py_buffer(values.astype(np.uint32).tobytes())])


def _lists(values: np.ndarray, per_text: np.ndarray, kind) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _aligning(path_a: str, path_b: str, names: list[str], detail: bool):
    def run(batches):
        side_a, side_b = _sides(path_a, path_b)
        for batch in batches:
            col = batch.column(len(names)).cast(pa.large_string()).fill_null("")
            led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), col, pa.scalar("", pa.large_string()))
            led = pc.if_else(pc.equal(pc.binary_length(col), 0), col, led)
            for at, data, offsets in tv.slices(led):
                n = len(offsets) - 1
                out = _aligned(side_a, side_b, data, offsets, col.slice(at, n).to_pylist(), detail)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, n) for i in range(len(names))), *out.values()],
                                                 [*names, *out])
    return run


def _aligned(side_a: SideA, side_b: SideB, data, offsets, texts, detail: bool) -> dict[str, pa.Array]:
    n = len(offsets) - 1
    a, per_a = side_a.encode(data, offsets)
    b, per_b = side_b.encode(texts)
    same = _same(side_a.spelling, a, per_a, data, offsets) & _same(side_b.spelling, b, per_b, data, offsets)
    a, b = a[np.repeat(same, per_a)], b[np.repeat(same, per_b)]
    per_a, per_b = per_a * same, per_b * same
    text_a, text_b = np.repeat(np.arange(n), per_a), np.repeat(np.arange(n), per_b)
    a_end, b_end = np.cumsum(side_a.spelling.size[a]), np.cumsum(side_b.spelling.size[b])
    starts = (np.cumsum(per_a) - per_a)[per_a > 0]
    link_a, link_b, cut_a, cut_b = lockstep(a_end, b_end, starts)
    owner = text_a[link_a]
    pairs, times = np.unique((owner << 32) | (a[link_a].astype(np.int64) << 16) | b[link_b], return_counts=True)
    per_pair = np.bincount(pairs >> 32, minlength=n)
    text, size = _groups(side_a, side_b, a, b, cut_a, cut_b, text_a, text_b, n)
    ends = np.concatenate([[0], np.cumsum(size)])
    groups = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends.astype(np.int64).tobytes()),
                                                          pa.py_buffer(text.tobytes())]).cast(pa.string())
    per_link = np.bincount(owner, minlength=n)
    out = {"n_a": pa.array(per_a), "n_b": pa.array(per_b), "n_groups": pa.array(np.bincount(text_a[cut_a], minlength=n)),
           "n_links": pa.array(per_link), "groups": groups, "pairs": _binary(pairs & 0xFFFFFFFF, per_pair),
           "pair_times": _binary(times, per_pair)}
    if detail:
        order = np.lexsort((link_b, link_a))
        link_a, link_b = link_a[order], link_b[order]
        own = np.concatenate([[0], np.cumsum(side_a.spelling.size[a])])[(np.cumsum(per_a) - per_a)]
        out |= {"a_ids": _lists(a, per_a, pa.int32()), "b_ids": _lists(b, per_b, pa.int32()),
                "link_a": _lists(link_a - (np.cumsum(per_a) - per_a)[text_a[link_a]], per_link, pa.int32()),
                "link_b": _lists(link_b - (np.cumsum(per_b) - per_b)[text_b[link_b]], per_link, pa.int32()),
                "cuts": _lists(a_end[cut_a] - own[text_a[cut_a]], np.bincount(text_a[cut_a], minlength=n), pa.int64())}
    return out


_COUNTED = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, pair_times binary"
_DETAIL = ", a_ids array<int>, b_ids array<int>, link_a array<int>, link_b array<int>, cuts array<long>"


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", detail: bool = True) -> DataFrame:
    """``docs`` (less the text) with n_a, n_b, n_groups, n_links, ``groups`` (`a1,a2|b1;a3|b2,b3`), and the text's distinct
    pairs of ids as 32-bit numbers a << 16 | b (``pairs``, ``pair_times``).  ``detail``: also both ids, the links as
    token places (``link_a``, ``link_b``) and ``cuts``, byte offsets in blank + text where tokens of both end."""
    docs = without(docs, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "pair_times", "a_ids", "b_ids", "link_a",
                   "link_b", "cuts", "_text")
    names = [c for c in docs.columns if c != text]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != text)
    return docs.select(*names, F.col(text).cast("string").alias("_text")).mapInArrow(
        _aligning(path_a, path_b, names, detail), f"{fields}{_COUNTED}{_DETAIL if detail else ''}")


def _numbers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit numbers, how many in each row) of a binary column."""
    col = col.cast(pa.large_binary())
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    return np.frombuffer(data.tobytes(), np.uint32), np.diff(at) // 4


def _folded(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back.ravel(), times, len(keys)).astype(np.int64)


def _pair_counting(batches):
    def out():
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(times)], ["pair", "n"])

    keys, times = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            more, n = _numbers(part.column(0))[0], _numbers(part.column(1))[0]
            keys, times = _folded(np.concatenate([keys, more]), np.concatenate([times, n.astype(np.int64)]))
            if len(keys) > HELD:
                yield out()
                keys, times = keys[:0], times[:0]
    if len(keys):
        yield out()


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, pair, n, best): how many links of the corpus join the ids, and whether no id of A has more with that id of
    B; written.  The join below is with a table no longer than B's vocabulary."""
    counted = aligned.select("pairs", "pair_times").mapInArrow(_pair_counting, "pair long, n long")
    counted = materialize(counted.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFF)).cast("int")
    counted = counted.select(F.shiftright("pair", 16).cast("int").alias("a"), b.alias("b"), "pair", "n")
    top = counted.groupBy("b").agg(F.max("n").alias("top"))
    return counted.join(F.broadcast(top), "b").select("a", "b", "pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _scoring(shared, names: list[str]):
    def run(batches):
        keys, counts, best = shared.value
        for batch in batches:
            pairs, per = _numbers(batch.column(len(names)))
            times = _numbers(batch.column(len(names) + 1))[0].astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), per)
            known, where = np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64)
            if len(keys):
                where = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                known = keys[where] == pairs
            got = np.where(known, times * counts[where], 0) if len(keys) else np.zeros(len(pairs), np.int64)
            top = np.where(known & best[where], times, 0) if len(keys) else np.zeros(len(pairs), np.int64)
            ends = np.concatenate([[0], np.cumsum(per)])

            def total(x, ends=ends):
                return np.diff(np.concatenate([[0], np.cumsum(x)])[ends])

            lost = np.bincount(row[~known], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(total(top)), pa.array(total(got)),
                 _lists(pairs[~known].astype(np.int64), lost, pa.int64()), _lists(times[~known], lost, pa.int64())],
                [*names, "n_best", "count_sum", "_lost", "_times"])
    return run


def score(aligned: DataFrame, dictionary: int = DICTIONARY) -> DataFrame:
    """``aligned``, a written table of ``align`` (read twice), with n_best, the links whose count is the highest of their
    id of B, and count_sum, the counts summed over the links.  The counts of the most frequent pairs are broadcast, as
    many as ``dictionary`` allows; the others are joined by a shuffle, where none is frequent."""
    spark = aligned.sparkSession
    counts = materialize(link_counts(aligned), "counts")
    steps = counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().orderBy(F.desc("n")).collect()
    least, taken = 10_001, 0
    for r in steps:
        if taken + r["count"] > dictionary:
            break
        taken, least = taken + r["count"], r["n"]
    hot = counts.filter(F.col("n") >= least).select("pair", "n", "best").toArrow()
    keys = hot.column("pair").to_numpy().astype(np.uint32)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], hot.column("n").to_numpy()[order],
                                           hot.column("best").to_numpy()[order].astype(bool)))
    aligned = without(aligned, "n_best", "count_sum", "_lost", "_times", "_row")
    names = [c for c in aligned.columns if c not in ("pairs", "pair_times")]
    fields = "".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}, " for c in names)
    out = aligned.select(*names, "pairs", "pair_times").mapInArrow(
        _scoring(shared, names), f"{fields}n_best long, count_sum long, _lost array<long>, _times array<long>")
    if taken == sum(r["count"] for r in steps):
        return out.drop("_lost", "_times")
    out = materialize(out.withColumn("_row", F.expr("uuid()")), "scored")
    asked = out.filter(F.size("_lost") > 0).select("_row", F.explode(F.arrays_zip("_lost", "_times")).alias("_p"))
    asked = asked.select("_row", F.col("_p._lost").alias("pair"), F.col("_p._times").alias("_t"))
    met = asked.join(counts.filter(F.col("n") < least).select("pair", "n", "best"), "pair").groupBy("_row").agg(
        F.sum(F.col("n") * F.col("_t")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("_t")).otherwise(0)).alias("_best"))
    joined = out.join(met, "_row", "left")
    return joined.withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn(
        "count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0))).drop("_row", "_lost", "_times", "_sum", "_best")
