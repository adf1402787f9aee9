"""Near copies, substring dedup and shards."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa

from tests.llm import reference as ref
from tests.llm.conftest import DOCS
from windrift.llm import components, odd_sketch, sharding, substring
from windrift.llm import textvec as tv


def test_near_duplicates(docs):
    want = ref.near_components(DOCS)
    rows = odd_sketch.near_duplicates(docs).collect()
    assert len(rows) == len(DOCS)
    sizes = {(i, len(ref.shingle_set(t))) for i, t in DOCS}
    for r in rows:
        assert (r.doc_id, r.n_shingles) in sizes
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)
    left = odd_sketch.keep_one(docs)
    assert left.columns == docs.columns and left.count() == sum(i is None or want[i] == i for i, _ in DOCS)


def test_large_buckets_are_compared_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(odd_sketch, "BLOCK", 2)
    want = ref.near_components(DOCS)
    assert {r.doc_id: r.component_id for r in odd_sketch.near_duplicates(docs).collect() if r.doc_id is not None} == want


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    k = odd_sketch.BANDS * odd_sketch.ROWS
    for share in (0.6, 0.75, 0.9):
        a = rng.integers(0, 1 << 63, (400, k), dtype=np.uint64)
        b = np.where(rng.random((400, k)) < share, a, rng.integers(0, 1 << 63, (400, k), dtype=np.uint64))
        got = odd_sketch.estimate(odd_sketch._sketches(a), odd_sketch._sketches(b))
        assert abs(got.mean() - share) < 0.02
    assert (odd_sketch.estimate(odd_sketch._sketches(a), odd_sketch._sketches(a)) == 1).all()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201)]
    got = {r.v: r.c for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}


def test_shingles_of_rows():
    texts = ["a b c d e f", "a b", "", None, "A  B\tc d e F", "a b c d e a b c d e"]
    data, offsets = tv.strings(pa.array(texts, pa.string()))
    h, _, _, counts = tv.words(data, offsets)
    s, n = tv.shingles(h, counts)
    assert list(counts) == [6, 2, 0, 0, 6, 10] and list(n) == [2, 1, 0, 0, 2, 5]
    ends = np.cumsum(n)
    assert list(s[ends[3]:ends[4]]) == list(s[:ends[0]])


def test_substring_dedup(docs, empty):
    rows = {(r.doc_id, r.text): r for r in substring.dedup(docs).collect()}
    assert set(rows) == set(DOCS)
    for (i, t), r in rows.items():
        at, kept = 0, ""
        for first, last in r.spans:
            assert at <= first < last
            kept, at = kept + t[at:first], last
        assert r.kept_text == kept + (t or "")[at:] and r.n_removed == sum(b - a for a, b in r.spans)
        assert r.n_units == r.n_blocks + r.n_passages + r.n_windows and (r.n_units > 0) == bool(r.spans)
    carriers = [k for k in range(20, 60) if k % 7 == 0]  # the passage of 60 words; the earliest keeps it
    assert rows[carriers[0], dict(DOCS)[carriers[0]]].n_removed == 0
    text = dict(DOCS)
    for k in carriers[1:]:
        assert rows[k, text[k]].n_removed > 0.6 * len(" ".join(text[k].split()[30:90]))
    clean = [k for k in range(20, 60) if k % 7 and k % 3]
    assert not any(rows[k, text[k]].n_removed for k in clean)
    for k in range(81, 90):  # whole copies go but for what no unit covers
        assert rows[k, text[k]].n_removed > 0.8 * len(text[k])
    assert substring.dedup(empty).count() == 0


def repeats_docs():
    """(doc_id, text): words that occur once, and planted lines, paragraphs, copies and passages of 25 words or more."""
    rng = random.Random(11)

    def fresh(n):
        return [f"w{rng.randrange(1 << 40)}" for _ in range(n)]

    lines = [fresh(n) for n in (1, 2, 5, 12, 16, 17, 20, 24, 70)]
    passages = [fresh(n) for n in (25, 26, 34, 50, 51, 73)]
    paragraph = fresh(30)
    out = [(0, None), (1, ""), (2, " \n\t\n ")]
    for k in range(3, 60):
        body = []
        for _ in range(rng.randint(1, 3)):
            body += [" ".join(fresh(rng.randint(1, 40)))]
            body += [rng.choice(["  ", ""]) + "\t ".join(rng.choice(lines)).upper()] * rng.randint(0, 1)
            body += [""] * rng.randint(0, 1)
        if k % 3 == 0:  # inside a line, at its start or its end
            body.append(" ".join(["\u00e9"] + fresh(rng.randint(0, 9)) + rng.choice(passages) + fresh(rng.randint(0, 9))))
        if k % 5 == 0:  # one paragraph, broken differently
            at = rng.randint(1, 29)
            body += ["", " ".join(paragraph[:at]), " ".join(paragraph[at:]), " \t"]
        out.append((k, "\n".join(body)))
    out += [(60 + j, out[k][1]) for j, k in enumerate((3, 9, 10, 21, 50))]
    out += [(70 + j, " ".join(fresh(n))) for j, n in enumerate((1, 7, 15, 16, 17, 24, 25, 26))]
    out += [(80 + j, t) for j, (_, t) in enumerate(out[-8:])]
    return out


def brute_spans(docs, windows=True, run=25, min_chars=1):
    """{doc_id: joined spans of the units that occur earlier}"""
    at = collections.defaultdict(list)
    for i, t in docs:
        words = [(m.start(), m.end(), m.group().translate(ref.UP)) for m in re.finditer(ref.WORD, t or "")]
        cuts = [list(re.finditer(r"[^\n]+", t or "")), [], []]
        cuts[1] = list(re.finditer(r"[^\n]*[^\s][^\n]*(\n[^\n]*[^\s][^\n]*)*", t or ""))
        units = [[w for w in words if m.start() <= w[0] < m.end()] for c in cuts for m in c] + [words]
        kinds = [("block", u) for u in units if u and len(" ".join(w[2] for w in u)) >= min_chars]
        kinds += [("window", words[k:k + run]) for k in range(len(words) - run + 1)] if windows else []
        for kind, u in kinds:
            at[kind, tuple(w[2] for w in u)].append((i, u[0][0], u[-1][1]))
    spans = collections.defaultdict(set)
    for places in at.values():
        for i, a, b in set(places) - {min(places)}:
            spans[i].add((a, b))
    return spans


def joined(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def test_repeats_equal_brute_force(spark, monkeypatch):
    rows = repeats_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for windows in (True, False):
        want = {i: joined(s) for i, s in brute_spans(rows, windows).items()}
        got = {r.doc_id: [tuple(s) for s in r.spans] for r in substring.repeated_spans(df, passages=windows).collect()}
        assert got == want
    assert len(want) > 30
    monkeypatch.setattr(substring, "BROADCAST_DOCS", 0)  # joined by a shuffle
    for r in substring.dedup(df).collect():
        left = dict(rows)[r.doc_id] or ""
        for a, b in reversed(joined(brute_spans(rows)[r.doc_id])):
            left = left[:a] + left[b:]
        assert r.kept_text == left
        assert r.doc_id not in (60, 61, 62, 63, 64, *range(80, 88)) or not r.kept_text.split()


def test_exact_passages_and_least_length_equal_brute_force(spark):
    rows = repeats_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {i: joined(s) for i, s in brute_spans(rows, run=substring.SPAN, min_chars=60).items()}
    got = {r.doc_id: r for r in substring.repeated_spans(df, min_chars=60, exact=True).collect()}
    assert {i: [tuple(s) for s in r.spans] for i, r in got.items()} == want
    for i, r in got.items():
        blocks, windows = (brute_spans(rows, w, substring.SPAN, c)[i] for w, c in ((False, 60), (True, 10**9)))
        assert (r.n_units.blocks, r.n_units.passages, r.n_units.windows) == (len(blocks), len(windows), 0)
    short = {i: joined(s) for i, s in brute_spans(rows, False, min_chars=60).items()}
    left = {r.doc_id: [tuple(s) for s in r.spans] for r in substring.repeated_spans(df, passages=False, min_chars=60).collect()}
    assert left == short != {i: joined(s) for i, s in brute_spans(rows, False).items()}


def test_lines_and_paragraphs_equal_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = collections.defaultdict(set)
    for i, a, b in con.execute(substring.LINE_SQL).fetchall():
        want[i].add((a, b))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in substring.repeated_spans(docs, passages=False).collect()}
    assert got == {i: joined(s) for i, s in want.items()} and got
    con.execute("CREATE TABLE planted (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO planted VALUES (?, ?)", repeats_docs())
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM planted")
    spans = collections.defaultdict(set)
    for i, a, b in con.execute(substring.LINE_SQL).fetchall():
        spans[i].add((a, b))
    assert spans == brute_spans(repeats_docs(), windows=False)


def test_shards(docs, empty):
    rows = sharding.assign(docs, 7).collect()
    assert len(rows) == len(DOCS)
    at = {}
    for r in rows:
        at.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in at.values()) and set(at) <= set(range(7))
    known = {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in DOCS}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == known
    one = {}
    for r in rows:
        one.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert all(len(v) == 1 for v in one.values())
    assert sharding.assign(empty, 7).count() == 0
    whole = sharding.shard(docs, 7)
    assert whole.count() == len(DOCS)


def test_smallest_capacity_and_level_cuts():
    import itertools
    import random
    rng = random.Random(3)
    for _ in range(150):
        sizes = sorted([rng.choice([16, 17, 50, rng.randint(16, 400)]) for _ in range(rng.randint(1, 50))], reverse=True)
        runs = [(s, len(list(g))) for s, g in itertools.groupby(sizes)]
        k = rng.randint(1, 9)
        best = sharding.smallest_capacity(runs, k)

        def shards(c):
            n, fill = 1, 0
            for s in sizes:
                n, fill = (n + 1, s) if fill + s > c else (n, fill + s)
            return n
        assert shards(best) <= k and (best == max(sizes) or shards(best - 1) > k)
        first = [0]
        for s, n in runs:
            first.append(first[-1] + n)
        at = [0, *(first[r] + p for r, p in sharding.level_cuts(runs, k)), len(sizes)]
        assert len(at) <= k + 1 and all(a < b and sum(sizes[a:b]) <= best for a, b in itertools.pairwise(at))
