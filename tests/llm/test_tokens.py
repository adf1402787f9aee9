"""Token counts, SentencePiece, language identification and personal data."""

import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import DOCS
from windrift.llm import fst, langid, lattice, pii
from windrift.llm import textvec as tv

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "É", "ñ", "1", "23", "!", "<|endoftext|>", "<|endo",
       "日本", "💩", "　", "can't", "'S", "...", " '", " 's", "\u0085", "ß", "²", "́", "rr", "lll", "▁", "<s>", "ooo", " un"]


def odd_texts(n=800):
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(BPE)
    rows = fst.token_counts(docs.select("doc_id", "text", "n_tokens", F.col("text").alias("copy")), BPE).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        n = len(library.encode(r["copy"] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r["copy"] or "").encode()), n, n > 512)
    assert fst.token_counts(empty, BPE).count() == 0


def test_transducers_on_odd_texts():
    library, counter, memo = Tokenizer.from_file(BPE), fst.Counter(BPE, max_states=500), fst._Memo(limit=100)
    texts = odd_texts(3000) + ["a" * 5000, "\n" * 500, " " * 700 + "x", "the " * 1000]
    got = []
    for _, data, offsets in tv.slices(pa.array(texts), limit=4000):
        got += fst._count_rows(counter, memo, data, offsets).tolist()
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_chunk_maps_compose():
    inputs = np.random.default_rng(0).integers(0, 10, 5000).astype(np.uint8)
    state, want = fst.Q_START, []
    for x in inputs:
        want.append(state)
        state = fst.TO[state, x]
    for chunk in (1, 7, 64, 10_000):
        assert fst.scan_states(inputs, chunk).tolist() == want


@pytest.mark.parametrize("dictionary", [lattice.DICTIONARY, 50])
def test_sentencepiece(spark, docs, dictionary):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts() + [t for _, t in DOCS] + [" " * k for k in range(40)] + [" " * k + "the" for k in range(1, 39, 5)] + \
        ["xr" + "l" * k + "o" for k in range(1, 36, 5)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = lattice.decode(lattice.encode(table, PIECES, dictionary=dictionary), PIECES).collect()
    assert len(rows) == len(texts)
    assert sorted(rows) == sorted(lattice.encode(table, PIECES, dictionary=dictionary, spell=True).collect())
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.ids == library.encode(t) and r.decoded == t.replace("▁", " ")


def test_sentencepiece_of_nothing(empty):
    assert lattice.decode(lattice.encode(empty.select("doc_id", "text"), PIECES), PIECES).count() == 0


def test_language(spark, empty):
    rng = random.Random(2)
    words = {"en": ["the", "and", "with", "thing"], "de": ["und", "nicht", "schön", "über"], "fr": ["être", "les", "dans", "où"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 60))), lang)
            for i in range(900) for lang in [rng.choice(sorted(words))]]
    rows += [(1000, None, "en"), (1001, "123 !?", "de"), (1002, "", None), (1003, "the and", None), (1004, "é" * 30_000, "fr")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.identify(table, F.col("doc_id") % 3 != 1).collect()}
    assert len(out) == len(rows)
    held = [r for r in rows if r[0] % 3 == 1 and r[0] < 900]
    assert sum(out[i].lang_pred == lang for i, _, lang in held) > 0.97 * len(held)
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and not out[i].accepted for i in (1000, 1001, 1002))
    assert out[1003].lang_pred == "en" and all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in langid.identify(table.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()} == {"und"}
    assert langid.identify(empty, F.lit(True)).count() == 0


def test_language_with_clashing_columns(spark):
    rows = [(i, "the and with" if i % 2 else "und nicht über", "en" if i % 2 else "de") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("_l", "_has", "_text", "l", "n", "i", "t", "count", "score", "accepted", "lang_pred"):
        table = table.withColumn(name, F.lit("clash"))
    out = langid.identify(table, F.col("doc_id") < 150).collect()
    assert len(out) == 200 and all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in out)
    twice = langid.identify(table.unionByName(table), F.lit(True))  # repeated rows: each predicted, and alike
    assert twice.count() == 400 and twice.select("doc_id", "lang_pred", "score").distinct().count() == 200


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    twice = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in value.split(".")),
            "card": 16 <= len(digits) <= 19 and sum(twice) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]


def test_personal_data(spark, empty):
    rng = random.Random(2)
    bits = ["a", "b.", "c@", "@", "d.e", "..", "1", "23", ".", "255", "256", "-", " ", "+", "+1", "(", "4111 1111 1111 1111",
            "4111-1111-1111-1111", "12345678", "a@b.c+d@e.f", "é", "💩", "\n", "0", "tel ", "jo (at) ex.org "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", "1 " * 20_000, "a." * 20_000 + "@b.c", "a@b" + ".c" * 20_000, "1" * 40_000, "+1" + " 1" * 9_000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find(table).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        if len(t) < 1000:
            want = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if _passes(k, m[0])]
            assert [(s.kind, s.first, s["last"]) for s in r.base] == want
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    done = {r.doc_id: r.redacted for r in pii.redact(table.withColumn("spans", F.lit("clash"))).collect()}
    assert len(done) == len(texts) and not any("a@b.c" in v for v in done.values() if len(v) < 1000)
    assert pii.find(empty).count() == 0


def planted(n=600):
    """(texts, the loose spans that were planted in each): digits that are no data, spelled-out addresses, secrets."""
    rng = random.Random(9)

    def words(k):
        return " ".join("".join(rng.choice("abdeginorst") for _ in range(rng.randint(2, 9))) for _ in range(k))

    texts, added = [], []
    for i in range(n):
        own, spans, text = [], [], words(rng.randint(3, 20)) + " "
        kind = i % 6
        name = f"{words(1)}.{i}"
        if kind == 0:
            own = [f"mail {name}@{words(1)}.example.com"]
        elif kind == 1:
            own = [("email", f"{name} (at) {words(1)} (dot) com")]
        elif kind in (2, 5):
            own = [("secret", "".join(rng.choice("0123456789abcdef") for _ in range(40)))]
            text += 'token = "'
        elif kind == 3:
            own = [f"call +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", f"host 10.0.{i % 250}.7"]
        else:
            own = ["".join(rng.choice("abcdefgh") for _ in range(30)), f"version 1.2.{i}.999"]
        for x in own:
            if isinstance(x, tuple):
                spans.append((x[0], len(text), len(text) + len(x[1])))
                x = x[1]
            text += x + ('" ' if kind in (2, 5) else " ") + words(4) + " "
        texts.append(text)
        added.append(spans)
    return texts, added


def test_added_spans_have_precision_and_recall(spark):
    texts, want = planted()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(table).collect()}
    got = {(i, *s) for i, r in rows.items() for s in (tuple(s) for s in r.spans) if s not in {tuple(b) for b in r.base}}
    secrets = {(i, *s) for i, own in enumerate(want) for s in own if s[0] == "secret"}
    assert len(got & secrets) >= 0.95 * len(secrets)
    assert len({x for x in got if x[1] == "secret"} - secrets) <= 0.05 * len(secrets)
    report = {r.kind: r for r in pii.measure(table).collect()}
    assert report["secret"].precision >= pii.PRECISION and report["secret"].recall > 0.9
    assert report["secret"].n_added == sum(x[1] == "secret" for x in got)
    assert set(report) == set(pii.ALL)


def test_trees_and_thresholds_take_every_labelled_candidate(spark):
    n = 24_000
    label = (F.col("id") % 2).cast("double")
    known = spark.range(n).select(
        F.col("id").alias("doc_id"), F.col("id").alias("th"), F.lit("secret").alias("kind"), F.lit(0).alias("first"), F.lit(20).alias("last"),
        F.lpad(F.hex("id"), 20, "a1").alias("value"), F.when(label > 0, "token = ").otherwise("words ").alias("before"),
        F.lit(" more").alias("after"), F.lit(False).alias("strict"), F.lit(True).alias("able"), label.alias("label"))
    held = known.filter(F.pmod(F.xxhash64("doc_id", "kind", "first", "value"), F.lit(4)) == 0).count()
    _, cut, report = pii.fit(known)
    assert {r[0]: r[1] for r in report} == {k: held if k == "secret" else 0 for k in pii.ALL}
    assert held > 5_500 and set(cut) == {"secret"}


def test_repeated_rows_and_missing_ids(spark):
    rows = [(None, "write a@b.com"), (1, "write a@b.com"), (1, "write a@b.com"), (1, "token = \"0123456789abcdef0123\""), (None, None)]
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5 and sorted(len(r.base) for r in out) == [0, 0, 1, 1, 1]
