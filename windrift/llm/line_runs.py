"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs, top_doc), sorted by hash; a hash stands in one
run only.  A batch of documents is reduced to its own hashes and merge-anti-joined with
the runs: hashes that no run holds open an entry in a new run of level 0, the others
send an increment to the run that holds them.  ``fanout`` runs of one level are
compacted into one of the next, which folds their increments in, so that a lookup
meets few runs however many batches came.

Edge cases: null and empty texts are one empty line; lines shorter than
``min_chars`` are never dropped; a line twice in one document counts one document
and both lines share its fate; rows with equal doc_id count as one document; rows
with a null doc_id keep all their lines; an empty batch adds an empty run; extra
columns are kept, but for those named like an output.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrift.llm.common import LOWER, UPPER, WS_CHARS, digest, join_unique, materialize, without

MIN_CHARS = 40
MIN_DOCS = 5
FANOUT = 2
BATCHES = 4
KEY = ["h1", "h2"]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WS_CHARS)), UPPER, LOWER)


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, pos, h1, h2) of every line whose key has ``min_chars`` code
    points; th, a hash of the text, tells rows of one doc_id apart."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.posexplode_outer(split_lines(F.col(text))).alias("pos", "line"))
    long = lines.filter(F.col("doc_id").isNotNull() & (F.char_length("line") >= min_chars))
    keyed = long.select("doc_id", "th", "pos", line_key(F.col("line")).alias("k")).filter(F.char_length("k") >= min_chars)
    h1, h2 = digest(F.col("k"))
    return keyed.select("doc_id", "th", "pos", h1.alias("h1"), h2.alias("h2"))


@dataclass
class Run:
    """Entries of hashes that were new when the run was opened, and what later batches add to them."""
    entries: DataFrame
    increments: list[DataFrame] = field(default_factory=list)

    def folded(self) -> DataFrame:
        if not self.increments:
            return self.entries
        more = self.increments[0]
        for x in self.increments[1:]:
            more = more.unionByName(x)
        more = more.groupBy(*KEY).agg(F.sum("n_docs").alias("_n"), F.max("top_doc").alias("_top"))
        return self.entries.join(more, KEY, "left").select(
            *KEY, (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("top_doc", "_top").alias("top_doc"))


class LineRuns:
    """The levelled runs; ``levels[i]`` holds the runs of level i, newest last."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[Run]] = []

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def _held(self) -> DataFrame:
        """(h1, h2, _run): every hash of the runs, and which of them has it."""
        parts = [r.entries.select(*KEY, F.lit(i).alias("_run")) for i, r in enumerate(self.runs())]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def add(self, lines: DataFrame) -> DataFrame:
        """Add the batch ``lines`` (doc_id, h1, h2, ...); returns the entries it opens."""
        once = lines.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one"))
        own = once.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc"))
        runs = self.runs()
        if runs:
            own = materialize(own, "line-batch")
            held = self._held()
            known = materialize(own.join(held, KEY), "line-increments")
            for i, r in enumerate(runs):
                r.increments.append(known.filter(F.col("_run") == i).drop("_run"))
            own = own.join(held, KEY, "left_anti")
        opened = materialize(own.sortWithinPartitions(*KEY), "line-run")
        self._push(0, Run(opened))
        return opened

    def _push(self, level: int, run: Run) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._together(self.levels[level])
            self.levels[level] = []
            self._push(level + 1, Run(materialize(merged.sortWithinPartitions(*KEY), "line-run")))

    @staticmethod
    def _together(runs: list[Run]) -> DataFrame:
        """The entries of several runs with their increments; no hash is in two of them."""
        out = runs[0].folded()
        for r in runs[1:]:
            out = out.unionByName(r.folded())
        return out

    def totals(self) -> DataFrame | None:
        """(h1, h2, n_docs, top_doc) over all batches."""
        return self._together(self.runs()) if self.runs() else None


def dropped_lines(lines: DataFrame, totals: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, th, dropped: array of positions) from the repeated keys of ``totals``."""
    repeated = materialize(totals.filter(F.col("n_docs") >= min_docs), "line-repeated")
    gone = join_unique(lines, repeated, KEY, "n_docs").filter(F.col("doc_id") != F.col("top_doc"))
    return gone.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("dropped"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
          min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    The lines of a key in ``min_docs`` documents or more go, except in the largest
    doc_id that holds it.  Documents are fed to the runs in ``batches``, by a hash
    of doc_id."""
    docs = without(docs, "kept_text", "n_lines", "n_dropped", "_gone_id", "_gone_th", "_gone", "_lines")
    lines = materialize(line_table(docs, doc_id, text, min_chars).withColumn(
        "batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "lines")
    runs = LineRuns(fanout)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b).select("doc_id", *KEY))
    gone = dropped_lines(lines.drop("batch"), runs.totals(), min_docs).toDF("_gone_id", "_gone_th", "_gone")
    joined = docs.join(gone, (F.col(doc_id) == F.col("_gone_id")) & (F.xxhash64(F.col(text)) == F.col("_gone_th")), "left")
    split = joined.withColumn("_lines", split_lines(F.col(text)))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    stay = F.transform(F.array_except(every, F.col("_gone")), lambda i: F.get(F.col("_lines"), i))
    kept = F.when(F.col("_gone").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(stay, "\n"))
    return split.select(*[F.col(c) for c in docs.columns], kept.alias("kept_text"),
                        F.size("_lines").cast("long").alias("n_lines"),
                        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
