"""Substring dedup by line and paragraph hashing.

Units are every line, every paragraph (lines without a blank one between them) and
every whole text that has a word, of any length, normalised: white space between words
is one blank, A-Z folded.  Digests are grouped globally, the earliest occurrence in the
order (doc_id, offset) is kept, and the others are removed; spans of overlapping units
are joined and refer to code points of the original text, from the first word of a unit
to the end of its last.

In addition, repeats that follow no line or paragraph: a passage of ``SPAN`` words is
chosen wherever its hash is the smallest among ``STEP`` neighbouring ones, and removed
like the units above.  Any ``WINDOW = SPAN + STEP - 1`` equal words choose the same
passage, so the runs of ``WINDOW`` words around a chosen passage that occurs twice are
compared, too, wherever they reach a word that no other unit removes: each word of a later
occurrence of ``WINDOW`` words or more goes, up to both ends.  Shorter repeats inside a line stay, but for the passages of ``SPAN`` words that
happen to be chosen in both places, unless ``exact`` makes every passage of ``SPAN`` words a unit.

Short lines repeat everywhere; ``min_chars`` is the least length, in normalised code points, of
a line, paragraph or text that is a unit (1: all of them).

Edge cases: null and empty texts have no units; units repeated inside one document
go there, too, but for the first; rows with a null doc_id come last in the order;
rows with equal doc_id are told apart by their text, and equal rows share their
spans; an empty table gives no rows; extra columns are kept but for those named
like an output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrift.llm import textvec as tv
from windrift.llm.common import join_unique, materialize, without

SPAN = 16
STEP = 10
WINDOW = SPAN + STEP - 1

#: Rows and spans up to which the removals are broadcast to the texts; more are joined by a shuffle.
BROADCAST_DOCS, BROADCAST_SPANS = 200_000, 1_000_000

_UNIT = "doc_id long, th long, h1 long, h2 int, first int, last int"
#: The kinds that removals are counted by.
KINDS = ("blocks", "passages", "windows")


def _words(col):
    """Per slice of texts: (first row, bytes, offsets, word hashes, first and last byte of each word,
    first word of its text, words of its text, code points before each byte)."""
    for row, data, offsets in tv.slices(col):
        hashes, first, last, n = tv.words(data, offsets)
        if len(hashes):
            at = np.repeat((np.cumsum(n) - n)[n > 0], n[n > 0])
            yield row, data, offsets, hashes, first, last, at, np.repeat(n, n), np.concatenate(
                [[0], np.cumsum((data & 0xC0) != 0x80)])


def _sums(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``size`` words from each of ``at`` on (past the end: of the words left)."""
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j in range(size):
        w = padded[at + j]
        one += w * tv.COEF[j + 1]
        two += (w ^ (w >> np.uint64(29))) * tv.COEF[j + 30]
    return tv.mix(one), tv.mix(two)


def _blocks(data: np.ndarray, hashes: np.ndarray, first: np.ndarray, text_at: np.ndarray):
    """(first word, words, two hashes) of every line, of the paragraphs of several lines
    and of the texts of several paragraphs."""
    breaks = np.diff(np.cumsum(data == 10)[first], prepend=0)  # line breaks before each word
    text = text_at == np.arange(len(hashes))
    starts = [np.flatnonzero(text | (breaks > k)) for k in (0, 1)] + [np.flatnonzero(text)]
    out = []
    for k, at in enumerate(starts):
        size = np.diff(np.append(at, len(hashes)))
        place = np.arange(len(hashes)) - np.repeat(at, size)
        power = tv._powers(int(size.max()))[place]
        length = size.astype(np.uint64) * tv.COEF[0]
        one = tv.mix(np.add.reduceat(hashes * power, at) ^ length)
        two = tv.mix(np.add.reduceat((hashes ^ (hashes >> np.uint64(29))) * power, at) ^ length)
        new = np.ones(len(at), bool)
        if k:  # those of one part are that part
            parts = np.diff(np.append(np.searchsorted(starts[k - 1], at), len(starts[k - 1])))
            new = parts > 1
        out.append((at[new], size[new], one[new], two[new]))
    return [np.concatenate(x) for x in zip(*out)]


def _units(ids, marks, row, offsets, points, begin, end, one, two, passage):
    """The rows of units; ``passage``: the lowest bit of h2 is 0, else 1."""
    owner = np.searchsorted(offsets, begin, "right") - 1
    base = points[offsets[owner]]
    h2 = (two >> np.uint64(32)).astype(np.uint32)
    h2 = np.where(passage, h2 & np.uint32(0xFFFFFFFE), h2 | np.uint32(1)).astype(np.uint32)
    a, b, owner = points[begin] - base, points[end] - base, pa.array(owner + row)
    return pa.RecordBatch.from_arrays(
        [ids.take(owner), marks.take(owner), pa.array(one.view(np.int64)), pa.array(h2.view(np.int32)),
         pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
        ["doc_id", "th", "h1", "h2", "first", "last"])


def _cut(passages: bool, min_chars: int = 1, exact: bool = False):
    def run(batches):
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for row, data, offsets, hashes, first, last, text_at, text_n, points in _words(batch.column(2)):
                at, size, one, two = _blocks(data, hashes, first, text_at)
                if min_chars > 1:  # the words and the blanks between them
                    chars = np.concatenate([[0], np.cumsum(points[last] - points[first])])
                    long = chars[at + size] - chars[at] + size - 1 >= min_chars
                    at, size, one, two = at[long], size[long], one[long], two[long]
                yield _units(ids, marks, row, offsets, points, first[at], last[at + size - 1], one, two, False)
                place = np.arange(len(hashes)) - text_at
                fits = place <= text_n - SPAN
                if passages and fits.any():
                    one, two = _sums(hashes, np.arange(len(hashes)), SPAN)
                    at = np.flatnonzero(fits if exact else _winnowed(one, fits, text_at, place)[0])
                    yield _units(ids, marks, row, offsets, points, first[at], last[at + SPAN - 1], one[at], two[at], True)
    return run


def _open(batches):
    """The digests of removed passages chosen by a run of WINDOW words that ``spans`` do not cover."""
    for batch in batches:
        for row, data, offsets, hashes, first, _, text_at, text_n, points in _words(batch.column(2)):
            place = np.arange(len(hashes)) - text_at
            one, two = _sums(hashes, np.arange(len(hashes)), SPAN)
            _, v, low = _winnowed(one, place <= text_n - SPAN, text_at, place)
            held = batch.column(3).slice(row, len(offsets) - 1)
            base = np.repeat(points[offsets[:-1]], held.value_lengths().to_numpy(zero_copy_only=False))
            lead, spans, depth = np.append(np.flatnonzero(np.diff(points)), len(data)), held.flatten(), np.zeros(len(hashes) + 1, int)
            for k, step in ((0, 1), (1, -1)):
                np.add.at(depth, np.searchsorted(first, lead[spans.field(k).to_numpy() + base]), step)
            gone = np.concatenate([[0], np.cumsum(np.cumsum(depth)[:-1] > 0)])
            at = np.flatnonzero(place <= text_n - WINDOW)
            at = at[gone[at + WINDOW] - gone[at] < WINDOW]
            found = np.zeros(len(hashes), bool)
            for j in range(STEP):
                p = at + j
                found[p[(v[p] == low[at]) & (gone[p + SPAN] - gone[p] == SPAN)]] = True
            h2 = (two[found] >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)
            yield pa.RecordBatch.from_arrays([pa.array(one[found].view(np.int64)), pa.array(h2.view(np.int32))], ["h1", "h2"])


def _windows(batches):
    """The runs of WINDOW words whose chosen passage is among those of ``starts``."""
    for batch in batches:
        ids, marks, starts = batch.column(0), batch.column(1), batch.column(3)
        for row, _, offsets, hashes, first, last, text_at, text_n, points in _words(batch.column(2)):
            place = np.arange(len(hashes)) - text_at
            fits = place <= text_n - SPAN
            one, _ = _sums(hashes, np.arange(len(hashes)), SPAN)
            _, v, low = _winnowed(one, fits, text_at, place)
            held = starts.slice(row, len(offsets) - 1)
            lens = held.value_lengths().to_numpy(zero_copy_only=False)
            byte = np.flatnonzero(np.diff(points))[held.flatten().to_numpy() + np.repeat(points[offsets[:-1]], lens)]
            again = np.concatenate([np.isin(first, byte) & fits, np.zeros(STEP, bool)])
            v = np.concatenate([v, np.zeros(STEP, np.uint64)])
            found = np.zeros(len(hashes), bool)
            for j in range(STEP):
                found |= again[j:j + len(hashes)] & (v[j:j + len(hashes)] == low)
            at = np.flatnonzero(found & (place <= text_n - WINDOW))
            one, two = _sums(hashes, at, WINDOW)
            yield _units(ids, marks, row, offsets, points, first[at], last[at + WINDOW - 1], one, two, False)


def _winnowed(h: np.ndarray, fits: np.ndarray, text_at: np.ndarray, place: np.ndarray):
    """(passages whose hash is the smallest of a window of STEP starts in their text, or of
    all starts, if the text has fewer; hash of each start; smallest of the window from it on)."""
    far = np.uint64(0xFFFFFFFFFFFFFFFF)
    v = np.where(fits, h, far)
    n = len(v)
    low = v.copy()  # smallest of the window that begins here
    padded = np.concatenate([v, np.full(STEP, far)])
    same = np.concatenate([text_at, np.full(STEP, -1)])
    for j in range(1, STEP):
        low = np.minimum(low, np.where(same[j:j + n] == text_at, padded[j:j + n], far))
    whole = np.zeros(n, bool)  # windows that lie in the text, or its first one
    reach = np.concatenate([fits, np.zeros(STEP, bool)])[STEP - 1:STEP - 1 + n] & (same[STEP - 1:STEP - 1 + n] == text_at)
    whole[fits] = reach[fits] | (place[fits] == 0)
    chosen = np.zeros(n, bool)
    for j in range(STEP):  # a start is chosen if a window that begins j before has it as the smallest
        w = np.zeros(n, bool)
        w[j:] = whole[:n - j] & (text_at[:n - j] == text_at[j:]) & (low[:n - j] == v[j:])
        chosen |= w
    return chosen & fits, v, low


def _later(found: DataFrame, name: str) -> DataFrame:
    """(doc_id, th, h2, first, last) of the occurrences of the units of ``found`` (n: how often
    each occurs) but for the earliest of each."""
    rank = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "th", "first")
    groups = materialize(found.groupBy("h1", "h2", "n").agg(F.min(rank).alias("kept")), name)
    return join_unique(found.drop("n"), groups, ["h1", "h2"], "n").filter(F.col("kept") != rank).select(
        "doc_id", "th", "h2", "first", "last")


def _repeated(units: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``units`` that occur twice, with their number n, and (h1, h2, n), as tables."""
    # most units occur once: they are counted alone, without their places, and go no further
    times = units.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    times = materialize(times.filter(F.col("n") > 1), f"{name}-counts")
    return materialize(join_unique(units, times, ["h1", "h2"], "n"), f"{name}-repeated"), times


def _joined(spans):
    """An array of spans, those that meet or overlap joined."""
    zero = F.array().cast("array<struct<first:int,last:int>>")

    def join_up(done, s):
        end = F.get(done, F.size(done) - 1)
        return F.when((F.size(done) > 0) & (s["first"] <= end["last"]), F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(end["first"].alias("first"), F.greatest(end["last"], s["last"]).alias("last"))))).otherwise(
            F.concat(done, F.array(s)))

    return F.aggregate(F.sort_array(spans), zero, join_up)


def _by_text(later: DataFrame, windows: bool = False) -> DataFrame:
    """(_id, _th, _spans, _n): the joined spans of each text, and the number of its units by kind."""
    kind = F.lit(2) if windows else F.when(F.col("h2").bitwiseAND(1) == 1, 0).otherwise(1)
    spans = later.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(
        F.collect_set(F.struct("first", "last", kind.alias("kind"))).alias("spans"))

    def of(k: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    number = [of(k).alias(c) for k, c in enumerate(KINDS)]
    return spans.select("_id", "_th", _joined(F.transform("spans", lambda s: F.struct(s["first"], s["last"]))).alias("_spans"),
                        F.struct(*number).alias("_n"))


def _mark(doc_id, text):
    """What tells rows of one doc_id apart: a short hash, or a long one where all rows without doc_id share theirs."""
    return F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.hash(text).cast("long"))


def _beside(texts: DataFrame, doc_id, th, table: DataFrame, entries: str, how: str) -> DataFrame:
    """``texts`` joined to ``table`` (_id, _th and an array ``entries``): broadcast if it is small."""
    n, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(entries)), F.lit(0))).first()
    small = n <= BROADCAST_DOCS and total <= BROADCAST_SPANS
    return texts.join(F.broadcast(table) if small else table,
                      doc_id.eqNullSafe(F.col("_id")) & (th == F.col("_th")), how)


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", passages: bool = True,
                   min_chars: int = 1, exact: bool = False) -> DataFrame:
    """(doc_id, th, n_units: struct of KINDS, spans: array of (first, last)): the repeats to remove;
    th is a hash of the text.  Digests have 95 bits.

    ``passages``: whether repeats that follow no line or paragraph count.  ``min_chars``: least normalised length
    of lines, paragraphs and texts.  ``exact``: every SPAN words are a passage, in place of the chosen ones and the
    runs around them, so any repeat of SPAN words or more goes, at a unit for each word."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", _mark(F.col("doc_id"), F.col("text")).alias("th"), "text")
    found, times = _repeated(materialize(rows.mapInArrow(_cut(passages, min_chars, exact), _UNIT), "units"), "units")
    gone = materialize(_by_text(_later(found, "unit-groups")), "unit-spans")
    if passages and not exact:
        texts = _beside(rows, F.col("doc_id"), F.col("th"), gone, "_spans", "inner")
        sought = texts.select("doc_id", "th", "text", "_spans").mapInArrow(_open, "h1 long, h2 int").distinct()
        sought = materialize(times.join(sought, ["h1", "h2"]), "passages-sought")
        held = join_unique(found.drop("n"), sought, ["h1", "h2"], "n").groupBy(
            F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("first").alias("_starts"))
        texts = _beside(rows, F.col("doc_id"), F.col("th"), materialize(held, "passages"), "_starts", "inner")
        windows = materialize(texts.select("doc_id", "th", "text", "_starts").mapInArrow(_windows, _UNIT), "windows")
        wider = _by_text(_later(_repeated(windows, "windows")[0], "window-groups"), True)
        gone = gone.unionByName(wider).groupBy("_id", "_th").agg(
            _joined(F.flatten(F.collect_list("_spans"))).alias("_spans"),
            F.struct(*[F.sum(f"_n.{c}").alias(c) for c in KINDS]).alias("_n"))
    return gone.select(F.col("_id").alias("doc_id"), F.col("_th").alias("th"), F.col("_n").alias("n_units"),
                       F.col("_spans").alias("spans"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 1, exact: bool = False) -> DataFrame:
    """``docs`` with ``kept_text``, ``spans`` (removed, of the original text), ``n_blocks`` (removed lines, paragraphs and
    texts), ``n_passages``, ``n_windows`` (removed runs of WINDOW words; they overlap), ``n_units`` (all three) and
    ``n_removed`` (code points)."""
    counts = [f"n_{c}" for c in KINDS]
    docs = without(docs, "kept_text", "spans", "n_units", "n_removed", *counts, "_id", "_th", "_spans", "_n")
    gone = materialize(repeated_spans(docs, doc_id, text, min_chars=min_chars, exact=exact).select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("spans").alias("_spans"),
        F.col("n_units").alias("_n")), "spans")
    key = F.col(doc_id).cast("long")
    met = _beside(docs, key, _mark(key, F.col(text)), gone, "_spans", "left")
    t = F.coalesce(F.col(text), F.lit(""))
    ends = F.concat(F.transform("_spans", lambda s: s["first"]), F.array(F.char_length(t)))
    starts = F.concat(F.array(F.lit(0)), F.transform("_spans", lambda s: s["last"]))
    cut = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(t, a + 1, b - a)), "")
    none = F.array().cast("array<struct<first:int,last:int>>")
    size = F.aggregate(F.coalesce("_spans", none), F.lit(0).cast("long"),
                       lambda n, s: n + (s["last"] - s["first"]).cast("long"))
    by_kind = [F.coalesce(f"_n.{c}", F.lit(0).cast("long")) for c in KINDS]
    return met.select(*[F.col(c) for c in docs.columns], F.when(F.col("_spans").isNull(), t).otherwise(cut).alias("kept_text"),
                      F.coalesce("_spans", none).alias("spans"), *[n.alias(c) for n, c in zip(by_kind, counts)],
                      (by_kind[0] + by_kind[1] + by_kind[2]).alias("n_units"), size.alias("n_removed"))


#: DuckDB: (doc_id, first, last) of the lines, paragraphs and texts of ``documents`` that occur
#: earlier; equal to the spans of ``repeated_spans`` without passages before they are joined.
LINE_SQL = r"""WITH cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL),
placed AS (SELECT doc_id, no, line,
    COALESCE(SUM(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+', ' ', 'g'), ' ') AS key
  FROM cut),
numbered AS (SELECT *, SUM(CASE WHEN key = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS para FROM placed),
lines AS (SELECT doc_id, no, para, key, CAST(before + length(line) - length(regexp_replace(line, '^[ \x09-\x0D]+', '')) AS BIGINT) AS first,
    CAST(before + length(regexp_replace(line, '[ \x09-\x0D]+$', '')) AS BIGINT) AS last FROM numbered WHERE key <> ''),
units AS (SELECT doc_id, key, first, last FROM lines
  UNION SELECT doc_id, string_agg(key, ' ' ORDER BY no), MIN(first), MAX(last) FROM lines GROUP BY doc_id, para
  UNION SELECT doc_id, string_agg(key, ' ' ORDER BY no), MIN(first), MAX(last) FROM lines GROUP BY doc_id),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY doc_id, first) AS k FROM units)
SELECT DISTINCT doc_id, first, last FROM ranked WHERE k > 1"""
