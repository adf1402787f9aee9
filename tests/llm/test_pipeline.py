"""The whole pipeline against brute force, and the registry."""

import os

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm import reference as ref
from tests.llm.conftest import DOCS
from windrift.llm import registry


def test_pipeline(spark, docs, tmp_dir):
    known = [(i, t) for i, t in DOCS if i is not None]
    bench = [(1, " ".join(dict(DOCS)[22].split()[:12])), (2, "not in any text of the table " * 3)]
    docs.filter("doc_id is not null").selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) n_chars") \
        .write.parquet(os.path.join(tmp_dir, "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(os.path.join(tmp_dir, "benchmark.parquet"))

    kept = ref.quality_kept(known)
    lines = ref.line_dedup(kept)
    kept = [(i, lines[i, t][2]) for i, t in kept]
    part = ref.near_components(kept)
    kept = [(i, t) for i, t in kept if part[i] == i]
    hits = ref.contamination(kept, bench)
    kept = [(i, t) for i, t in kept if not hits[i, t][1]]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: library.encode(t) for i, t in kept}

    rows = corpus_pipeline.run(spark, tmp_dir).collect()
    assert {r.doc_id: r.ids for r in rows} == want and len(rows) == len(want)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert 10 < len(want) < len(DOCS) and 22 not in want


def test_registry():
    names = [n for n in registry.QUERIES if n != "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in registry.QUERIES
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
