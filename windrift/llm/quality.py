"""Quality rules as a short-circuit cascade.

Every rule is a named pair of an expression and its threshold.  On a random sample,
bounded in rows and bytes, the cascade measures each rule's cost and its rejection rate,
orders the rules by rejections per cost, and evaluates them in that order as one lazy
``CASE``: a document stops at the first rule that rejects it.  A cost is the least of
several timed runs after a first one that compiles it, less what a run without a rule
takes, in steps of a factor of four, so that small changes of speed leave the order alone.
The order changes the work and the reported first rule, never the verdict.

Edge cases: a null or empty text has no words and fails ``base``; ties of the
order go by rule name; repeated rows are judged one by one; an empty table gives
an empty result; extra columns are kept, but for those named like an output.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrift.llm.common import WS, let, without, words_of

MIN_WORDS = 10
#: Per cent of words in repeated windows, beyond which a text fails.
MAX_REPEAT = 20
WINDOW = 5
#: Rows and text bytes of the sample on which the cascade is ordered, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 8_000_000
#: Timed runs of a rule, after the one that compiles it.
RUNS = 3


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more, from the window hashes.

    Only a text with an equal pair of hashes pays for the sort."""
    keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = let(keyed, lambda s: F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False))
                                          | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))))
    starts = F.sort_array(F.transform(twins, lambda e: e["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(starts, zero, lambda a, p: F.struct(
        (a["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + F.lit(WINDOW)).alias("end")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered["n"]).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_at`` (see below) and the struct column ``q``: n_words, word_chars, n_symbols,
    n_lines, n_dup_lines, n_repeat_words (long)."""
    docs = without(docs, "q", "rejected_by", "kept", "_w", "_l", "_h", "_at")
    t = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn("_w", words_of(F.col(text), WS)).withColumn(
        "_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WS}]")))
    starts = F.when(F.size("_w") >= WINDOW, F.sequence(F.lit(0), F.size("_w") - WINDOW)).otherwise(
        F.array().cast("array<int>"))
    hashed = split.withColumn("_h", F.transform(starts, lambda i: F.xxhash64(
        *[F.get(F.col("_w"), i + j) for j in range(WINDOW)])))
    # a filter on the verdict must stay above this projection: pushed below, it would hold copies of the word
    # arrays inside their own lambdas.  What refers to _at, which is never negative, cannot be pushed.
    return hashed.select(*docs.columns, F.monotonically_increasing_id().alias("_at"), F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_h")).cast("long").alias("n_repeat_words")).alias("q"))


Rule = Callable[[Column, Column], Column]


def _mean_length(text: Column, q: Column) -> Column:
    return (q["word_chars"] > 40 * q["n_words"]) | (q["word_chars"] < 2 * q["n_words"])


def _symbols(text: Column, q: Column) -> Column:
    return 10 * q["n_symbols"] > q["word_chars"]


def _dup_lines(text: Column, q: Column) -> Column:
    return (q["n_lines"] >= 4) & (10 * q["n_dup_lines"] > 5 * q["n_lines"])


def _letters(text: Column, q: Column) -> Column:
    kept = F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]+", ""))
    return 10 * kept < 4 * q["word_chars"]


def _braces(text: Column, q: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return 20 * (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[{}\\\[\];=]+", ""))) > q["word_chars"]


#: Rules of the cascade: true means rejected.
RULES: dict[str, Rule] = {"mean_length": _mean_length, "symbols": _symbols, "dup_lines": _dup_lines,
                          "letters": _letters, "braces": _braces}


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT * q["n_words"])


def sampled(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """A random sample of ``docs``: at most ``rows`` rows, of which none is longer than its share of ``most_bytes``."""
    share = min(1.0, 1.5 * rows / max(docs.count(), 1))
    fits = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) <= most_bytes // rows
    return docs.sample(share, 7).filter(fits).limit(rows)


def _seconds(local: DataFrame, flag: Column) -> tuple[float, int]:
    """(least seconds of RUNS runs after a first one, rows with the flag)"""
    took, job = [], local.agg(F.sum(flag.cast("int")))
    for _ in range(RUNS + 1):
        begun = time.perf_counter()
        n = job.first()[0] or 0
        took.append(time.perf_counter() - begun)
    return min(took[1:]), n


def plan_cascade(featured: DataFrame, rules: dict[str, Rule] = RULES, text: str = "text",
                 sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per cost, measured on at most ``sample_rows`` rows; ties by name.

    The sample is the driver's only input: its rows are brought once and made a
    local relation, so that timing a rule costs no scan."""
    spark = featured.sparkSession
    rows = featured.select(F.col(text).alias("text"), "q").limit(sample_rows).collect()
    if not rows:
        return sorted(rules)
    schema = featured.select(F.col(text).alias("text"), "q").schema
    local = spark.createDataFrame(rows, schema).coalesce(1)
    t, q = F.col("text"), F.col("q")
    least, _ = _seconds(local, q["n_words"] < 0)
    rank: dict[str, float] = {}
    for name, rule in rules.items():
        took, hit = _seconds(local, rule(t, q))
        cost = 4.0 ** round(math.log(max((took - least) / len(rows), 1e-7), 4))
        rank[name] = (hit + 0.5) / len(rows) / cost
    return sorted(rules, key=lambda r: (-rank[r], r))


def cascade(order: list[str], rules: dict[str, Rule], text: Column, q: Column) -> Column:
    """Name of the first rule that rejects, else null."""
    out = F.when(base_failed(q), F.lit("base"))
    for name in order:
        out = out.when(rules[name](text, q), F.lit(name))
    return out


def judge(docs: DataFrame, rules: dict[str, Rule] = RULES, text: str = "text",
          sample_rows: int = SAMPLE_ROWS, order: list[str] | None = None) -> DataFrame:
    """``docs`` with ``q`` (features), ``rejected_by`` (null: kept) and ``kept``."""
    featured = features(docs, text)
    if order is None:
        order = plan_cascade(features(sampled(docs, text, sample_rows), text), rules, text, sample_rows)
    out = featured.withColumn("rejected_by", cascade(order, rules, F.col(text), F.col("q")))
    return out.withColumn("kept", F.col("rejected_by").isNull() & (F.col("_at") >= 0)).drop("_at")
