"""The registered queries of the training-data operators, with DuckDB SQL where
SQL expresses them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import corpus_pipeline
from windrift.llm import (
    crosswalk,
    fst,
    langid,
    lattice,
    line_runs,
    odd_sketch,
    oracle,
    pii,
    quality,
    sharding,
    stream_bpe,
    substring,
    trie,
    winnow,
)
from windrift.llm.common import materialize, table


def op1_token_counts(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fst.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op2_substring_dedup(spark, sf_dir) -> DataFrame:
    """Per document the units removed, their joined spans (start:end code points) and what stays."""
    out = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first"].cast("string"),
                                                                    s["last"].cast("string"))), ",")
    return out.select("doc_id", "n_units", "n_blocks", "n_passages", "n_windows", "n_removed", spans.alias("spans"),
                      F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_sentencepiece(spark, sf_dir) -> DataFrame:
    """Ids of every text and whether they spell the text again (U+2581 reads as a blank)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    digest = F.sha2(F.replace(F.coalesce("text", F.lit("")), F.lit(lattice.BLANK), F.lit(" ")), 256)
    out = lattice.encode(docs.withColumn("text_sha256", digest), path, spell=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                      (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


def op4_personal_data(spark, sf_dir) -> DataFrame:
    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"),
                                                                     s["last"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    out = pii.find(table(spark, sf_dir, "documents"))
    counts = [number(k) for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"),
                      F.size("spans").cast("long").alias("n_spans"),
                      F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret"))


def op5_sharding(spark, sf_dir) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op6_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out")
    out = langid.identify(docs.select("doc_id", "text", "lang", held), ~F.col("held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op7_line_dedup(spark, sf_dir) -> DataFrame:
    kept = line_runs.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_quality_rules(spark, sf_dir) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words",
                      quality.base_failed(F.col("q")).alias("base_failed"), "kept")


def op9_decontamination(spark, sf_dir) -> DataFrame:
    out = winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op10_near_dedup(spark, sf_dir) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"))


def op11_alignment(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    lean = crosswalk.align(docs, *paths, detail=False).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "pair_times")
    return crosswalk.score(materialize(lean, "aligned")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_word_bpe(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = stream_bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), spell=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark, sf_dir) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_substring_dedup, op3_sentencepiece,
                                   op4_personal_data, op5_sharding, op6_language_id, op7_line_dedup, op8_quality_rules, op9_decontamination,
                                   op10_near_dedup, op11_alignment, op12_word_bpe, op13_prefix_trie)}

QUERIES["pipeline"] = corpus_pipeline.run

ORACLE: dict[str, str] = dict(oracle.ORACLE)
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
