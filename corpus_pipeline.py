"""A training corpus from ``documents``: five stages, each an operator of
``windrift.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; all but the last return the columns of documents.

Edge cases, for every stage: an empty table gives no rows; repeated rows share their
fate, but for near_dedup, which keeps the rows of one doc_id; nulls in lang, source and
n_chars pass through; extra columns are kept, also those named like a working column of
an operator.  What null ids and texts do is said with each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrift.llm import lattice, line_runs, odd_sketch, quality, winnow
from windrift.llm.common import materialize, table
from windrift.session import ensure_checkpoint_dir, ship_package


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def _like(docs: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in ``kept``."""
    return docs.join(kept.select(*key).distinct(), key, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects.  Null and empty texts have no words and go; a null doc_id does not
    matter; ties do not arise, a verdict looks at one row alone."""
    _ready(spark)
    return quality.judge(docs).filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that the line runs drop; n_chars follows the text.  A null text becomes empty; rows with a
    null doc_id keep all lines; of a line in several documents the largest doc_id keeps it, in all its rows."""
    _ready(spark)
    made = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return line_runs.dedup(docs).select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies.  Null, empty and wordless texts are linked with
    nothing and stay; what becomes of null doc_ids is said in ``odd_sketch``."""
    _ready(spark)
    return odd_sketch.keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.  Null texts, and items without id or words, have no windows."""
    _ready(spark)
    return winnow.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and whether they spell the text again.  Null and empty texts have no ids and
    spell ''."""
    _ready(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    digest = F.xxhash64(F.translate(F.coalesce("text", F.lit("")), lattice.BLANK, " "))
    lean = docs.select("doc_id", "lang", "source", "text", digest.alias("text_hash"))
    out = lattice.encode(lean, path, spell=True)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: The BPE encoding of the last stage is not SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written to the shared folder.  An empty table, or one of which a stage keeps
    nothing, gives no rows."""
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
