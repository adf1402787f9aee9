"""Quality rules, line dedup and decontamination against brute force."""

import pytest
from pyspark.sql import functions as F

from tests.llm import reference as ref
from tests.llm.conftest import DOCS
from windrift.llm import line_runs, quality, winnow

PASSAGE = next(t for i, t in DOCS if i == 21)


def test_quality_features(docs):
    rows = quality.judge(docs).collect()
    want = ref.quality(DOCS)
    assert len(rows) == len(DOCS)
    for r in rows:
        n, chars, symbols, dup, repeat = want[r.doc_id, r.text]
        assert (r.q.n_words, r.q.word_chars, r.q.n_symbols, r.q.n_dup_lines, r.q.n_repeat_words) == \
            (n, chars, symbols, dup, repeat)
        if n < 10 or 100 * repeat > 20 * n:
            assert not r.kept and r.rejected_by == "base"
    assert {r.doc_id for r in rows if r.kept} >= {k for k in range(20, 60) if want[k, dict(DOCS)[k]][0] >= 40}


def test_cascade_order_never_changes_the_verdict(docs):
    names = sorted(quality.RULES)
    kept = [{(r.doc_id, r.text) for r in quality.judge(docs, order=o).filter("kept").collect()} for o in (names, names[::-1])]
    assert kept[0] == kept[1]
    assert sorted(quality.plan_cascade(quality.features(docs))) == names


def test_the_sample_is_random_and_bounded(spark, docs, empty):
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), F.when(
        F.col("id") % 10 == 0, 9000).otherwise(20).cast("int")).alias("text"))
    got = quality.sampled(many, rows=100, most_bytes=100_000).collect()
    assert 20 < len(got) <= 100 and max(len(r.text) for r in got) <= 1000 and max(r.doc_id for r in got) > 500
    assert quality.sampled(docs).count() <= len(DOCS) and quality.sampled(empty).count() == 0


def test_cheap_rules_that_reject_come_first(spark):
    rows = spark.range(300).select(F.repeat(F.lit("some words of a text "), 40).alias("text"))
    dear = lambda t, q: F.length(F.regexp_replace(F.repeat(t, 60), "[^a-z]+", "")) < 0
    rules = {"a_dear_and_idle": dear, "b_cheap_and_idle": lambda t, q: q["n_words"] < 0, "c_rejects": lambda t, q: q["n_words"] > 3}
    assert quality.plan_cascade(quality.features(rows), rules) == ["c_rejects", "b_cheap_and_idle", "a_dear_and_idle"]


def test_line_dedup(docs):
    want = ref.line_dedup(DOCS)
    rows = line_runs.dedup(docs).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        assert (r.n_lines, r.n_dropped, r.kept_text) == want[r.doc_id, r.text]
    assert sum(r.n_dropped for r in rows) > 5


def test_runs_are_levelled_and_know_the_first_seen(spark):
    runs = line_runs.LineRuns(fanout=2)
    for b in range(5):
        batch = spark.createDataFrame([(b * 10 + d, h, h) for d in range(2) for h in range(b, b + 3)], "doc_id long, h1 long, h2 long")
        fresh = {r.h1 for r in runs.add(batch).collect()}
        assert fresh == set(range(b, b + 3)) - set(range(b + 2))  if b else fresh == {0, 1, 2}
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {r.h1: r.n_docs for r in runs.totals().collect()} == {0: 2, 1: 4, 2: 6, 3: 6, 4: 6, 5: 4, 6: 2}


def test_totals_stand_on_the_anti_join(spark, monkeypatch):
    """Each hash opens one entry; batches that repeat it send increments.  Without the anti-join it would stand twice."""
    frame = type(spark.range(1))

    def totals():
        runs = line_runs.LineRuns(fanout=3)
        for b in range(4):
            runs.add(spark.createDataFrame([(b, h, h) for h in (1, 2)], "doc_id long, h1 long, h2 long"))
        return sorted((r.h1, r.n_docs, r.top_doc) for r in runs.totals().collect())

    assert totals() == [(1, 4, 3), (2, 4, 3)]
    join = frame.join
    monkeypatch.setattr(frame, "join", lambda self, other, on=None, how="inner": self if how == "left_anti" else join(self, other, on, how))
    assert totals() != [(1, 4, 3), (2, 4, 3)]


@pytest.mark.parametrize("broadcast_words", [winnow.BROADCAST_WORDS, 0])
def test_decontamination(docs, spark, broadcast_words):
    body = [t for i, t in DOCS if i in (22, 23, 24, 28, 61)]
    bench = [(1, " ".join(body[0].split()[:14])), (2, body[3]), (10, "one two three"), (11, "ONE"), (12, ""), (13, None),
             (None, body[1]), (14, "not there at all, in none of them, whatever one may think of it"), (15, body[4])]
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = ref.contamination(DOCS, bench)
    rows = winnow.decontaminate(docs, items, broadcast_words=broadcast_words).collect()
    assert len(rows) == len(DOCS)
    texts = {(r.doc_id, r.th): r.text for r in docs.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()}
    for r in rows:
        assert (r.n_words, r.n_hit, r.item_ids) == want[r.doc_id, texts[r.doc_id, r.th]]
    left = winnow.clean(docs, items, broadcast_words=broadcast_words)
    assert left.columns == docs.columns
    assert left.count() == sum(not want[x][1] for x in DOCS)


def test_empty_tables(docs, empty, spark):
    assert quality.judge(empty).count() == 0
    assert line_runs.dedup(empty).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnow.decontaminate(docs, none).filter("n_hit > 0 or size(item_ids) > 0").count() == 0
    assert winnow.decontaminate(empty, none).count() == 0
