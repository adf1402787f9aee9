"""Alignment of two tokenizers, the streaming BPE and the prefix trie, against brute force and the libraries."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import DOCS
from tests.llm.reference import sha
from windrift.llm import crosswalk, registry, stream_bpe, trie

BYTES, PIECES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "a", "É", "ñ", "1", "23", "!", "<|endoftext|>", "<|endo", "<|startoftext|>",
       "日本", "💩", "　", "can't", "'S", "...", " '", "\u0085", "ß", "²", "́", "̧", "İ", "ﬁ", "Σ", "가", "ᆨ", "rr", "the", "Å", "½", "٣", "▁", "<s>"]


def odd_texts(n=600):
    rng = random.Random(4)
    out = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    out += ["".join(rng.choice("abcdeinrsth") for _ in range(rng.randint(100, 3000))) for _ in range(15)]
    return out + ["日本語の" * 3000, "é" * 9000, "a" * 9000, "!" * 9000, "'s" * 5000, "́" * 9000, "the cat " * 3000, None, ""]


# --- alignment ---------------------------------------------------------------------
def aligned(texts):
    """Brute force: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    a_lib, b_lib = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_lib.encode_special_tokens = True
    back = crosswalk.fst._byte_symbols()

    def a_bytes(i):
        return bytes(back[c] for c in a_lib.id_to_token(i))

    def b_bytes(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()

    def spans(ids, spelled):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(spelled(i)), i))
            at = out[-1][1]
        return out

    links, groups, both = [], [], []
    for t in texts:
        a = spans(a_lib.encode(" " + t, add_special_tokens=False).ids if t else [], a_bytes)
        b = spans(b_lib.encode(t) if t else [], b_bytes)
        want = (" " + t).encode() if t else b""
        if b"".join(a_bytes(x[2]) for x in a) != want or b"".join(b_bytes(x[2]) for x in b) != want:
            a, b = [], []
        both.append((a, b))
        links.append([(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]])
        ends = sorted({x[1] for x in a} & {y[1] for y in b})
        groups.append([("|".join(",".join(str(i) for p, q, i in side if lo <= p < hi) for side in (a, b)))
                       for lo, hi in zip([0, *ends], ends, strict=False)])
    count = collections.Counter(x for own in links for x in own)
    top = collections.defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(len(a), len(b), len(g), len(own), sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own), ";".join(g))
            for (a, b), g, own in zip(both, groups, links, strict=True)]


def short(texts):
    return [t if t is None else t[:1500] for t in texts]  # the brute force compares all pairs of tokens


@pytest.mark.parametrize("dictionary", [crosswalk.DICTIONARY, 50])
def test_alignment(spark, tmp_dir, dictionary):
    texts = short(odd_texts(150) + [t for _, t in DOCS])
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pairs", F.lit("clash")).withColumn(
        "_lost", F.lit("clash")).repartition(3)
    crosswalk.align(table, BYTES, PIECES, detail=False).write.parquet(f"{tmp_dir}/a")
    out = crosswalk.score(spark.read.parquet(f"{tmp_dir}/a"), dictionary)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in out.collect()}
    assert got == dict(enumerate(aligned(texts)))


def test_links_and_cuts(spark):
    texts = short(odd_texts(60))
    rows = crosswalk.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES, PIECES).collect()
    a_side, b_side = crosswalk._sides(BYTES, PIECES)
    for r in rows:
        a, b = (np.concatenate([[0], np.cumsum(side.spelling.size[np.array(ids, int)])]) for side, ids in ((a_side, r.a_ids), (b_side, r.b_ids)))
        want = [(i, j) for i in range(r.n_a) for j in range(r.n_b) if a[i] < b[j + 1] and b[j] < a[i + 1]]
        assert list(zip(r.link_a, r.link_b, strict=True)) == want
        assert r.cuts == sorted(set(a[1:].tolist()) & set(b[1:].tolist()))


def test_lanes_do_not_show():
    rng = np.random.default_rng(0)
    a, b = (np.unique(np.append(rng.integers(1, 5000, 1500), [700, 5000])) for _ in range(2))
    starts = np.array([0, int(np.searchsorted(a, 700, "right"))])
    whole = crosswalk.lockstep(a, b, starts, lane=10**6)
    for lane in (1, 7, 100):
        part = crosswalk.lockstep(a, b, starts, lane)
        assert sorted(zip(*part[:2], strict=True)) == sorted(zip(*whole[:2], strict=True))
        assert (part[2] == whole[2]).all() and (part[3] == whole[3]).all()


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(crosswalk, "PART", 50)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t for t in short(odd_texts(200)) + [t for _, t in DOCS] if t]
    ids, per = crosswalk._sides(BYTES, PIECES)[1].encode(texts)
    assert ids.tolist() == [i for t in texts for i in library.encode(t)] and per.tolist() == [len(library.encode(t)) for t in texts]


def test_alignment_of_nothing(spark, empty, tmp_dir):
    crosswalk.align(empty, BYTES, PIECES, detail=False).write.parquet(f"{tmp_dir}/a")
    assert crosswalk.score(spark.read.parquet(f"{tmp_dir}/a")).count() == 0


def test_alignment_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 4000]
    texts = [t for _, t in docs]
    rows = {r.doc_id: r for r in registry.op11_alignment(spark, sf).collect()}
    for (i, _), want in zip(docs, aligned(texts), strict=True):
        r = rows[i]  # the counts are of all documents, so they are held in the test above
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == want[:4] and r.groups_sha256 == (sha(want[6]) if want[6] else "")


# --- streaming BPE ---------------------------------------------------------------------
def _run(texts, spell=True):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])
    return [x for b in stream_bpe._encoding(WORDS, [], spell)([batch]) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]


@pytest.mark.parametrize("chunk", [stream_bpe.CHUNK, 7])
def test_streaming_bpe(monkeypatch, chunk):
    monkeypatch.setattr(stream_bpe, "CHUNK", chunk)
    stream_bpe._encoder.cache_clear()
    library, texts = Tokenizer.from_file(WORDS), odd_texts(2500)
    for t, (ids, decoded) in zip(texts, _run(texts), strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids == want and decoded == library.decode(want, skip_special_tokens=False)
    stream_bpe._encoder.cache_clear()


def test_tokens_leave_the_word_once_settled():
    encoder = stream_bpe.Encoder(WORDS)
    rng = random.Random(8)
    for _ in range(20):
        raw = bytes(rng.choice(b"abcdeinrsth") for _ in range(6000))
        word, out, held = stream_bpe.Word(encoder), [], 0
        for at in range(0, len(raw), 100):
            out += word.feed(raw[at:at + 100])
            held = max(held, len(word.rest))
        assert out + word.end() == encoder.merge([encoder.inner[b] for b in raw[:-1]] + [encoder.final[raw[-1]]])
        assert held <= encoder.window + 1


def test_lookahead_is_sufficient():
    """On a small merge list, every word: a token with so many symbols behind it stands whatever follows."""
    import itertools
    rng = random.Random(1)
    for _ in range(30):
        names, merges, parts, size = ["a", "b"], {}, [None, None], [1, 1]
        for r in range(6):
            x, y = rng.randrange(len(names)), rng.randrange(len(names))
            if names[x] + names[y] not in names and len(names[x] + names[y]) <= 5:
                names.append(names[x] + names[y])
                merges[x << 32 | y] = (r, len(names) - 1)
                parts.append((r, x, y))
                size.append(size[x] + size[y])
        look = stream_bpe._lookahead(merges, parts, size)
        encoder = stream_bpe.Encoder.__new__(stream_bpe.Encoder)
        encoder.merges = merges
        n = min(look + 5, 11)
        for word in itertools.product((0, 1), repeat=n):
            whole, end = encoder.merge(list(word)), 0
            for k, t in enumerate(whole):
                end += size[t]
                for cut in range(end + look, n):
                    assert encoder.merge(list(word[:cut]))[:k + 1] == whole[:k + 1]


def test_text_machine():
    rng = random.Random(6)
    for _ in range(3000):
        raw = b"".join(rng.choice(["é", "日", "💩", "a"]).encode()[:rng.randint(1, 4)] if rng.random() < 0.7 else bytes([rng.randrange(256)])
                       for _ in range(rng.randint(0, 12)))
        machine, at, out = stream_bpe.TextMachine(), 0, ""
        while at < len(raw):
            k = rng.randint(1, 4)
            out += machine.feed(raw[at:at + k])
            at += k
        assert out + machine.end() == raw.decode("utf-8", "replace")


def test_streaming_bpe_tables(spark, docs, empty):
    out = stream_bpe.encode(docs.withColumn("decoded", F.lit("clash")), WORDS, spell=True)
    library = Tokenizer.from_file(WORDS)
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in out.collect()) == sorted(
        (i or -1, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in DOCS)
    assert sorted(r.decoded for r in out.collect()) == sorted(r.decoded for r in stream_bpe.decode(out, WORDS).collect())
    assert stream_bpe.encode(empty, WORDS, spell=True).count() == 0
    rows = spark.createDataFrame([("Hello, Él 123",), (None,)], "text string")
    assert [r.decoded for r in stream_bpe.decode(stream_bpe.encode(rows, WORDS), WORDS, joined=False).collect()] == ["hello , él 1 2 3", ""]


def test_streaming_bpe_query(spark):
    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(WORDS)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.op12_word_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


# --- prefix trie ---------------------------------------------------------------------
def nodes(turns):
    """Brute force on rows (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, n, r, t in turns:
        if c is not None:
            own[c].append(((n is not None, n or 0), r or "", t or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = collections.defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p],
                   sha(",".join(map(str, sorted(c for c in m if new[c] == p))))) for p, m in members.items())


def conversations(n, seed, vocabulary=6):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(4 * n), n):
        k = rng.choice([1, 2, 3, 4, 5, 8]) if rng.random() < 0.98 else 60
        for t in range(k):
            rows.append((c, t if rng.random() < 0.9 or t else None, rng.choice(["user", "bot"]), None if rng.random() < 0.05 else
                         "w" * rng.randint(1, vocabulary)))
    copied = [r for r in rows if r[0] == rows[0][0]]
    rows += [(c, *r[1:]) for c in range(5 * n, 6 * n) for r in copied]
    return [r for r in rows if r[1] is not None or [x for x in rows if x[0] == r[0] and x[1] is None] == [r]] + [(None, 1, "user", "no id")]


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in df.collect())


@pytest.mark.parametrize("shard, chunk", [(trie.SHARD, trie.CHUNK), (3, 4), (40, 7)])
def test_prefix_trie(spark, monkeypatch, shard, chunk):
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    turns = conversations(150, shard)
    table = spark.createDataFrame([(*r, "clash", None) for r in turns], "conv_id long, turn long, role string, text string, node string, "
                                  "shard string").repartition(4)
    assert trie_rows(trie.prefix_trie(table)) == nodes(turns)


def test_prefix_trie_edges(spark, empty):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    only_root = trie.prefix_trie(spark.createDataFrame([(c, 1, "a", "b")], schema)).collect()
    assert [tuple(r) for r in only_root] == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]
    twice = [(100, 0, None, "x"), (100, 0, None, "x"), (100, None, "z", None)]
    assert trie_rows(trie.prefix_trie(spark.createDataFrame(twice, schema))) == nodes(twice)
    long = [(300, t, "user", "w" * 50_000 if t == 3 else "v") for t in range(500)] + [(400, t, "user", "v") for t in range(3)]
    assert trie_rows(trie.prefix_trie(spark.createDataFrame(long, schema))) == nodes(long)


def test_search_tree_is_balanced():
    tree = trie.SearchTree()
    n = 1023
    for i in trie._median_order(n):
        tree.insert([i], [1], 1, i, "")
    depth = {tree.root[0]: 1}
    for at in range(len(tree.key)):
        for to in (tree.below[at], tree.above[at]):
            if to >= 0:
                depth[to] = depth[at] + 1
    assert max(depth.values()) == 10
