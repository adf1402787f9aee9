"""Benchmark decontamination by winnowing.

Both sides are cut into k-gram hashes of words, and of every ``window - k + 1``
consecutive hashes the smallest is kept as a fingerprint.  Any shared run of
``window`` words therefore shares a fingerprint.  Equal fingerprints are joined,
the diagonals of the hits are compared word by word, the stretch of the document beside
the words of the item, and a run of ``window`` words or more marks its document words.  An item shorter than ``window`` words
is one window of its own length; such items are matched by all m-grams of that
length m, of which there are at most ``window - 1`` kinds.

Edge cases: a null or empty text has no words, no hits and no items; equal items
count each; null item ids are ignored; repeated doc_id rows are told apart by
their text and reported each; an empty benchmark or document table gives no hits
or no rows; extra columns are kept, but for those named like an output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrift.llm.common import HOT_KEYS, ascii_lower, join_salted, let, materialize, without, words_of

WINDOW = 10
K = 5
#: Fixed value: the separators of the word contract, a character class body.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Benchmark words and text bytes up to which the fingerprints are broadcast; beyond either, both sides are shuffled.
BROADCAST_WORDS, BROADCAST_BYTES = 4_000_000, 64_000_000
#: Diagonals up to which they are broadcast to the texts; more are joined by a shuffle.
BROADCAST_HITS = 1_000_000


def words(text: Column) -> Column:
    return words_of(ascii_lower(text), SEPARATORS)


def _grams(w: Column, n: int) -> Column:
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))


def fingerprints(df: DataFrame, w: str, out: str, window: int = WINDOW, k: int = K) -> DataFrame:
    """``df`` with ``out``: array of (p, h), the winnowed k-grams of the words ``w``.

    Position p is kept if its hash is the smallest of one of the windows over it."""
    span = window - k + 1
    df = df.withColumn("_g", _grams(F.col(w), k))
    last = F.size("_g") - span
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_m", F.transform(at, lambda i: F.least(*[F.get(F.col("_g"), i + j) for j in range(span)])))
    best = F.transform("_g", lambda h, p: F.struct(p.alias("p"), F.when(
        h == F.greatest(*[F.get(F.col("_m"), p - j) for j in range(span)]), h).alias("h")))
    return df.withColumn(out, F.filter(best, lambda e: e["h"].isNotNull())).drop("_g", "_m")


def _benchmark(items: DataFrame, item_id: str, text: str) -> DataFrame:
    return items.filter(F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("iw"),
        F.octet_length(text).cast("long").alias("bytes")).filter(F.size("iw") > 0).withColumn("size", F.size("iw"))


def _runs(sw: Column, begin: Column, iw: Column, shift: Column, least: Column) -> Column:
    """(first, end) of all runs of at least ``least`` document words that equal the
    item's words ``shift`` places before; ``sw``: the document's words from ``begin`` on."""
    same = F.transform(iw, lambda x, i: F.struct((i + shift).alias("at"), F.coalesce(
        F.when(i + shift >= begin, F.get(sw, i + shift - begin)) == x, F.lit(False)).alias("ok")))
    stop = F.array(F.struct((F.size(iw) + shift).alias("at"), F.lit(False).alias("ok")))
    none = F.array().cast("array<struct<first:int,end:int>>")
    zero = F.struct(none.alias("out"), shift.alias("first"))

    def step(a, e):
        run = F.array(F.struct(a["first"].alias("first"), e["at"].alias("end")))
        return F.when(e["ok"], a).otherwise(F.struct(
            F.when(e["at"] - a["first"] >= least, F.concat(a["out"], run)).otherwise(a["out"]).alias("out"),
            (e["at"] + 1).alias("first")))

    return F.aggregate(F.concat(same, stop), zero, step)["out"]


def _join_items(prints: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """Rows of ``prints`` (rid, n, p, h) with equal fingerprints of items, and the row
    p = -1 of each document."""
    if small:
        return prints.join(F.broadcast(items), "h", "left").filter((F.col("p") < 0) | F.col("q").isNotNull())
    prints = materialize(prints, "doc-prints")
    held = prints.filter(F.col("p") >= 0)
    # fingerprints that many documents share are counted first and dealt to several tasks
    often = held.groupBy("h").agg(F.count(F.lit(1)).alias("w"))
    met = materialize(items.join(often, "h"), "item-prints")
    marks = prints.filter(F.col("p") < 0).select("h", "rid", "n", "p", *[
        F.lit(None).cast(t).alias(c) for c, t in (("item_id", "string"), ("size", "int"), ("q", "int"))])
    return join_salted(held, met, ["h"], "w", ["rid", "p"]).drop("w").unionByName(marks)


def _stretches(docs: DataFrame, met: DataFrame) -> DataFrame:
    """(rid, item_id, shift, begin, sw) for each diagonal of ``met`` (rid, item_id, size, shift): the document's
    words beside the item, from word ``begin`` on."""
    hits = materialize(met.groupBy("rid").agg(F.collect_list(F.struct("item_id", "size", "shift")).alias("hits")), "bench-hits")
    n, total = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()
    if n <= HOT_KEYS and total <= BROADCAST_HITS:
        texts = docs.join(F.broadcast(hits), "rid")
    else:  # rows of one rid have one text
        texts = docs.groupBy("rid").agg(F.max("text").alias("text")).join(hits, "rid")

    def beside(w: Column) -> Column:
        def cut(x: Column) -> Column:
            begin = F.greatest(x["shift"], F.lit(0))
            # no stretch is empty: a hit lies in it
            size = F.greatest(F.least(x["shift"] + x["size"], F.size(w)) - begin, F.lit(0))
            return F.struct(x["item_id"].alias("item_id"), x["shift"].alias("shift"), begin.alias("begin"),
                            F.slice(w, begin + 1, size).alias("sw"))
        return F.transform("hits", cut)

    return texts.select("rid", F.explode(let(words(F.col("text")), beside)).alias("s")).select("rid", "s.*")


def matched_runs(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K,
                 broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(rid, n_words, runs: sorted array of (item_id, first, end)) for every row of
    ``docs`` (rid, text): the document words covered by occurrences of windows."""
    bench = materialize(items, "bench-words")
    n_words, n_bytes, short = bench.agg(
        F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)),
        F.sort_array(F.collect_set(F.when(F.col("size") < window, F.col("size"))))).first()
    small = n_words <= broadcast_words and n_bytes <= BROADCAST_BYTES
    base = docs.select("rid", words(F.col("text")).alias("dw")).withColumn("n", F.size("dw").cast("long"))

    def prints(df: DataFrame) -> DataFrame:
        # the outer form: the plain one also filters on size(fp) below the projections that make it, by a second copy of them
        return df.select("rid", "n", F.explode_outer("fp").alias("e")).select("rid", "n", "e.p", "e.h")

    marker = F.array(F.struct(F.lit(-1).alias("p"), F.lit(None).cast("long").alias("h")))
    printed = fingerprints(base, "dw", "fp", window, k)
    long_items = fingerprints(bench.filter(F.col("size") >= window), "iw", "fp", window, k).select(
        "item_id", "size", F.explode_outer("fp").alias("e")).select("item_id", "size", F.col("e.p").alias("q"), "e.h")
    found = _join_items(prints(printed.withColumn("fp", F.concat(F.col("fp"), marker))), long_items, small)
    for m in short:
        of_length = bench.filter(F.col("size") == m).select("item_id", "size", F.lit(0).alias("q"),
                                                            F.xxhash64(*[F.get("iw", j) for j in range(m)]).alias("h"))
        grams = F.transform(_grams(F.col("dw"), m), lambda h, p: F.struct(p.alias("p"), h.alias("h")))
        found = found.unionByName(_join_items(prints(base.withColumn("fp", grams)), of_length, small).filter("p >= 0"))
    # one row for each diagonal, and one of each document
    lines = found.groupBy("rid", "n", "item_id", "size", (F.col("p") - F.col("q")).alias("shift")).agg(
        F.count(F.lit(1)).cast("int").alias("copies"))
    lines = materialize(lines, "bench-lines")
    met = lines.filter(F.col("item_id").isNotNull()).select("rid", "item_id", "size", "shift")
    beside = _stretches(docs, met)
    if small:
        pairs = beside.join(F.broadcast(bench.select("item_id", "iw")), "item_id")
    else:
        often = met.groupBy("item_id").agg(F.count(F.lit(1)).alias("w"))
        pairs = join_salted(beside, materialize(bench.select("item_id", "iw").join(often, "item_id"), "bench-met"),
                            ["item_id"], "w", ["rid", "shift"])
    spans = _runs(F.col("sw"), F.col("begin"), F.col("iw"), F.col("shift"), F.least(F.size("iw"), F.lit(window)))
    runs = pairs.select("rid", "item_id", F.explode(spans).alias("r")).groupBy("rid").agg(
        F.sort_array(F.collect_set(F.struct("item_id", "r.first", "r.end"))).alias("runs"))
    every = lines.filter(F.col("item_id").isNull()).select(
        "rid", F.col("n").alias("n_words"), F.explode_outer(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    none = F.array().cast("array<struct<item_id:string,first:int,end:int>>")
    return every.join(runs, "rid", "left").select("rid", "n_words", F.coalesce("runs", none).alias("runs"))


def covered(runs: Column) -> Column:
    """Number of words in the union of the runs."""
    ordered = F.sort_array(F.transform(runs, lambda r: F.struct(r["first"].alias("first"), r["end"].alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(ordered, zero, lambda a, r: F.struct(
        (a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["first"], a["end"]))).alias("n"),
        F.greatest(a["end"], r["end"]).alias("end")))["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K,
                  broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, item_ids (sorted
    strings), runs, contaminated, th (hash of the text)."""
    rows = docs.select(F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th")).alias("rid"),
                       F.col(text).alias("text"))
    runs = matched_runs(rows, _benchmark(benchmark, item_id, item_text), window, k, broadcast_words)
    ids = F.array_sort(F.array_distinct(F.transform("runs", lambda r: r["item_id"])))
    out = runs.select(F.col("rid.doc_id").alias("doc_id"), F.col("rid.th").alias("th"), "n_words",
                      covered(F.col("runs")).alias("n_hit"), ids.alias("item_ids"), "runs")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without any benchmark window, all columns kept."""
    docs = without(docs, "_bad_id", "_bad_th")
    bad = decontaminate(docs, benchmark, doc_id, text, **options).filter("contaminated").select(
        F.col("doc_id").alias("_bad_id"), F.col("th").alias("_bad_th"))
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col("_bad_id")) & (F.xxhash64(F.col(text)) == F.col("_bad_th")),
                     "left_anti")
