"""BPE encoding by a bounded-lookahead streaming transducer, and decoding by an incremental byte-to-text machine.

For vocabularies with word ends (lower-cased, white space dropped).  The transducer reads a stretch of text in chunks
and keeps, between chunks, only what is not yet settled: characters that may still compose, a quote that may open a
contraction, and the last symbols of the word at hand.  A token is put out once ``lookahead`` symbols stand behind it;
that number follows from the merge list alone:

    Merge (x, y) needs, right of x, the symbols of y and then as many as it takes to know that y is made and not taken
    away first, by a merge (s, z) of a part s on y's right edge that comes before s is used up.  Those merges have lower
    ranks, so one pass over the list in order gives every merge's need; a token needs the most of the merges that its
    own right edge could start.

Whole runs between ASCII white space are memoised in each task, so frequent ones run through the transducer once.

Edge cases: null and empty texts have no ids; repeated rows are encoded each; an empty table gives no rows; extra
columns are kept, but for those named like an output; very long texts and words are taken in chunks.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrift.llm import fst
from windrift.llm import textvec as tv
from windrift.llm.common import without
from windrift.llm.memo import Memo

#: Characters of a chunk that the transducer reads at a time.
CHUNK = 4096
#: Distinct words whose ids a task keeps.
WORDS = 500_000
#: The split rule of the vocabularies that this operator reads, and the same for ASCII alone.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NONE = (1 << 60, -1)
_ASCII = re.compile(rb"'(?:[stmd]|re|ve|ll)|[a-z]+|[0-9]|[^a-z0-9]+")


#: A word by the kinds of its characters: l letter, n number, o other, q quote.
_KINDS = re.compile(rb"l+|n|[oq]+")


@lru_cache(1)
def _kinds() -> bytes:
    letter = np.full(7, ord(" "), np.uint8)
    letter[[fst.LETTER, fst.NUMBER, fst.OTHER, fst.QUOTE]] = list(b"lnoq")
    return letter[fst.code_point_classes()].tobytes()


@lru_cache(1)
def _composing() -> np.ndarray:
    """Whether a code point can change with what stands before it under NFC."""
    out = np.zeros(sys.maxunicode + 1, bool)
    out[0x1161:0x1176] = out[0x11A8:0x11C3] = True  # jamo that join the syllable before them
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000:
            continue
        if unicodedata.combining(chr(c)):
            out[c] = True
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            out[int(parts[1], 16)] = True
        if parts and parts[0][0] != "<":
            out[c] = True
    return out


class Encoder:
    """The transducer of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        first, second = spec["pre_tokenizer"]["pretokenizers"]
        kept = (model["type"], [n["type"] for n in spec["normalizer"]["normalizers"]], first["pattern"]["Regex"],
                first["behavior"], first["invert"], second["type"], second["add_prefix_space"], second["use_regex"],
                model["end_of_word_suffix"], model["ignore_merges"], model["continuing_subword_prefix"], spec["decoder"])
        if kept != ("BPE", ["NFC", "Replace", "Lowercase"], RULE, "Removed", True, "ByteLevel", False, False, "</w>", False,
                    None, None):
            raise ValueError(f"not a lower-casing word BPE: {kept}")
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        vocab = model["vocab"]
        symbol = {b: c for c, b in fst._byte_symbols().items()}
        self.inner = [vocab[symbol[b]] for b in range(256)]
        self.final = [vocab[symbol[b] + "</w>"] for b in range(256)]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.special_bytes = [s.encode() for s in self.specials]
        n = max([*vocab.values(), *self.specials.values()]) + 1
        self.merges: dict[int, tuple[int, int]] = {}
        size, parts = [1] * n, [None] * n
        for r, pair in enumerate(model["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            u, v, w = vocab[x], vocab[y], vocab[x + y]
            self.merges[u << 32 | v] = (r, w)
            if parts[w] is None:
                parts[w], size[w] = (r, u, v), size[u] + size[v]
        self.size, self.lookahead = size, _lookahead(self.merges, parts, size)
        self.window = 4 * (max(size) + self.lookahead)
        self.words: dict[bytes, list[int]] = {}
        self.memo = Memo()
        spelled = [b""] * n
        for t, i in [*vocab.items(), *self.specials.items()]:
            spelled[i] = t.encode()
        self.spelled = spelled

    def merge(self, part: list[int]) -> list[int]:
        """The tokens of a run of symbols: merges by rank, then by place."""
        get = self.merges.get
        if len(part) > 24:
            return self._merge_many(part)
        offers = [get(x << 32 | y, _NONE) for x, y in zip(part, part[1:], strict=False)]
        while offers:
            best = min(offers)
            if best is _NONE:
                break
            i = offers.index(best)
            part[i:i + 2] = [best[1]]
            del offers[i]
            if i:
                offers[i - 1] = get(part[i - 1] << 32 | best[1], _NONE)
            if i < len(offers):
                offers[i] = get(best[1] << 32 | part[i + 1], _NONE)
        return part

    def _merge_many(self, part: list[int]) -> list[int]:
        get, n, heap = self.merges.get, len(part), []
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def propose(i, j):
            if i >= 0 and j < n and (m := get(part[i] << 32 | part[j])) is not None:
                heapq.heappush(heap, (m[0], i, j, part[i], part[j], m[1]))

        for i in range(n - 1):
            propose(i, i + 1)
        while heap:
            _, i, j, x, y, whole = heapq.heappop(heap)
            if part[i] != x or part[j] != y or after[i] != j:
                continue
            part[i], part[j] = whole, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            propose(before[i], i)
            propose(i, after[i])
        return [p for p in part if p >= 0]

    def word(self, raw: bytes) -> list[int]:
        """The ids of one whole word, short ones memoised."""
        ids = self.words.get(raw)
        if ids is None:
            if len(raw) <= self.window:
                ids = self.merge([self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]])
            else:
                run = Word(self)
                ids = [*run.feed(raw), *run.end()]
            if len(raw) <= 64:
                if len(self.words) > WORDS:
                    self.words.clear()
                self.words[raw] = ids
        return ids

    def run(self, raw: bytes) -> list[int]:
        """The ids of a run of text without ASCII white space."""
        if raw.isascii() and len(raw) <= CHUNK and not (b"<|" in raw and any(s in raw for s in self.special_bytes)):
            low = raw.lower()
            if low.isalpha():
                return self.word(low)
            return [i for w in _ASCII.findall(low) for i in self.word(w)]
        text, at, out = raw.decode(), 0, []
        if len(text) <= CHUNK and not (b"<|" in raw and any(s in raw for s in self.special_bytes)):
            return self._short(self.normalise(text))
        for m in self.special.finditer(text):
            out += self._stretch(text[at:m.start()])
            out.append(self.specials[m[0]])
            at = m.end()
        return out + self._stretch(text[at:])

    def _short(self, text: str) -> list[int]:
        """The ids of a normalised text that is read at once."""
        table = _kinds()
        kinds = bytes([table[ord(c)] for c in text])
        if not kinds.strip(b"l"):
            return self.word(text.encode()) if text else []
        out, at = [], 0
        while m := _KINDS.search(kinds, at):
            i, at = m.span()
            if kinds[i] == 113 and (opens := _OPENS.match(text, i)):
                at = opens.end()
            out += self.word(text[i:at].encode())
        return out

    def _stretch(self, text: str) -> list[int]:
        stretch, out = Stretch(self), []
        for at in range(0, len(text), CHUNK):
            out += stretch.feed(text[at:at + CHUNK])
        return out + stretch.end()


def _lookahead(merges: dict[int, tuple[int, int]], parts: list, size: list[int]) -> int:
    """Symbols behind a token after which nothing can change it (see the module's text)."""
    ranks: dict[int, list[int]] = {}  # of the merges that a token starts, ascending, with the most that any of them so far needs
    needs: dict[int, list[int]] = {}

    def need(token: int, limit: int) -> int:
        """The most that merges of rank < limit on the right edge of ``token`` need."""
        most = 0
        while True:
            own = ranks.get(token)
            if own and (k := bisect_left(own, limit)):
                most = max(most, needs[token][k - 1])
            if parts[token] is None:
                return most
            r, _, right = parts[token]
            limit, token = min(limit, r), right

    for pair, (r, _) in merges.items():
        x, y = pair >> 32, pair & 0xFFFFFFFF
        most = size[y] + need(y, r)
        ranks.setdefault(x, []).append(r)
        own = needs.setdefault(x, [])
        own.append(max(most, own[-1]) if own else most)
    return max((need(t, 1 << 60) for t in range(len(size))), default=0)


class Word:
    """The state inside one word: the symbols that are not settled."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.rest = encoder, []

    def feed(self, raw: bytes) -> list[int]:
        """Further bytes of the word; returns the tokens that are settled."""
        e, out, at = self.encoder, [], 0
        while at < len(raw):
            take = e.window + 1 - len(self.rest)
            self.rest += [e.inner[b] for b in raw[at:at + take]]
            at += take
            if len(self.rest) > e.window:
                end = 0
                limit = len(self.rest) - 1 - e.lookahead  # the last symbol may yet be the word's end
                for t in e.merge(self.rest[:-1]):
                    if end + e.size[t] > limit:
                        break
                    end += e.size[t]
                    out.append(t)
                self.rest = self.rest[end:]
        return out

    def end(self) -> list[int]:
        e = self.encoder
        last = e.inner.index(self.rest[-1])
        ids = e.merge([*self.rest[:-1], e.final[last]])
        self.rest = []
        return ids


class Stretch:
    """The state inside a text without special tokens: what may still compose, the kind of the word at hand, and the word."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.raw, self.held = encoder, "", ""
        self.kind, self.word = fst.BLANK, None

    def feed(self, text: str) -> list[int]:
        text = self.raw + text
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        safe = np.flatnonzero(~_composing()[points[1:]])  # a cut before such a character changes nothing
        cut = int(safe[-1]) + 1 if len(safe) else 0
        self.raw = text[cut:]
        return self._split(self.encoder.normalise(text[:cut]), False) if cut else []

    def end(self) -> list[int]:
        out = self._split(self.encoder.normalise(self.raw) if self.raw else "", True)
        self.raw = ""
        return out + self._close()

    def _close(self) -> list[int]:
        out = self.word.end() if self.word else []
        self.word = None
        return out

    def _split(self, text: str, last: bool) -> list[int]:
        text = self.held + text
        keep = len(text)
        if not last and (k := text.find("'", max(0, len(text) - 2))) >= 0:
            keep = k
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = fst.code_point_classes()[points]
        kinds = np.where(kinds == fst.QUOTE, fst.OTHER, np.where(kinds == fst.SPACE, fst.BLANK, kinds))
        out, i = [], 0
        change = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
        bounds = [*change.tolist(), len(text)]
        j = 0
        while i < keep:
            kind = int(kinds[i])
            while bounds[j] <= i:
                j += 1
            stop = min(bounds[j], keep)
            if kind == fst.BLANK:
                out += self._close()
            elif kind == fst.OTHER and text[i] == "'" and self.kind != fst.OTHER and (m := _OPENS.match(text, i)):
                out += self._close()
                out += self.encoder.word(m[0].encode())
                self.kind, i = fst.BLANK, m.end()
                continue
            elif kind == fst.NUMBER:
                out += self._close()
                for c in text[i:stop]:
                    out += self.encoder.word(c.encode())
            else:
                if self.kind != kind or self.word is None:
                    out += self._close()
                    self.word = Word(self.encoder)
                out += self.word.feed(text[i:stop].encode())
            self.kind, i = kind, stop
        self.held = text[i:]
        return out


#: The contractions of the split rule.
_OPENS = re.compile("'(?:[stmd]|re|ve|ll)")


class TextMachine:
    """Bytes to text, some at a time; between calls it keeps the bytes of an unfinished character.  Each longest part of
    a character that cannot go on becomes U+FFFD."""

    def __init__(self):
        self.part, self.need, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, raw: bytes) -> str:
        out = []
        if not self.need:  # settled: whole characters at once, up to the first fault
            try:
                return raw.decode()
            except UnicodeDecodeError as e:
                out.append(raw[:e.start].decode())
                raw = raw[e.start:]
        for b in raw:
            if self.need and self.low <= b <= self.high:
                self.part.append(b)
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                if not self.need:
                    out.append(self.part.decode())
                    self.part.clear()
                continue
            if self.need:
                out.append("�")
                self._reset()
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.part.append(b)
                self.need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def _reset(self) -> None:
        self.part.clear()
        self.need, self.low, self.high = 0, 0x80, 0xBF

    def end(self) -> str:
        out = "�" if self.need else ""
        self._reset()
        return out


class Speller:
    """Bytes of each id.  ``joined``: as the library decodes, the tokens as they are written, a blank between two; else
    the text that they stand for, a blank after each word end."""

    def __init__(self, encoder: Encoder, joined: bool):
        if joined:
            spelled = [s + b" " for s in encoder.spelled]
        else:
            back = fst._byte_symbols()
            spelled = [s if s.decode() in encoder.specials else
                       bytes(back[c] for c in s.decode().removesuffix("</w>")) + b" " * s.endswith(b"</w>") for s in encoder.spelled]
        self.size = np.array([len(s) for s in spelled], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(spelled), np.uint8)

    def spell(self, ids: np.ndarray, per_text: np.ndarray) -> pa.Array:
        """The text of each list of ids, without a last blank."""
        lens = self.size[ids]
        data = self.data[tv.ranges(self.at[ids], lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(per_text)])]
        full = np.flatnonzero(np.diff(ends) > 0)
        full = full[data[ends[full + 1] - 1] == 32]
        keep = np.ones(len(data), bool)
        keep[ends[full + 1] - 1] = False
        size = np.diff(ends)
        size[full] -= 1
        raw, at, out, machine = data[keep].tobytes(), 0, [], TextMachine()
        for n in size.tolist():
            out.append("".join(machine.feed(raw[k:min(k + 65_536, at + n)]) for k in range(at, at + n, 65_536)) + machine.end())
            at += n
        return pa.array(out, pa.string())


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(4)
def _speller(path: str, joined: bool) -> Speller:
    return Speller(_encoder(path), joined)


def _encoding(path: str, names: list[str], spell: bool | None):
    def run(batches):
        encoder = _encoder(path)
        memo = encoder.memo
        for batch in batches:
            for row, data, offsets in tv.slices(batch.column(len(names))):
                hashes, first, last, counts = tv.words(data, offsets, fold=None)
                at, size = memo.look_up(hashes, first, last, data.tobytes(), encoder.run)
                ends = np.concatenate([[0], np.cumsum(size)])
                per_text = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
                ids = memo.flat[tv.ranges(at, size)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)), pa.array(ids))
                n = len(offsets) - 1
                more = [] if spell is None else [_speller(path, spell).spell(ids, per_text)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, n) for i in range(len(names))), lists, *more],
                                                 [*names, "ids", *(["decoded"] if more else [])])
    return run


def encode(docs: DataFrame, path: str, text: str = "text", spell: bool | None = None) -> DataFrame:
    """``docs`` (less the text) with ``ids``: array<int>; ``spell`` True or False also gives ``decoded``, as ``decode`` with
    ``joined`` does, from the same task."""
    docs = without(docs, "ids", "decoded", "_text")
    names = [c for c in docs.columns if c != text]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != text)
    return docs.select(*names, F.col(text).cast("string").alias("_text")).mapInArrow(
        _encoding(path, names, spell), f"{fields}ids array<int>" + (", decoded string" if spell is not None else ""))


def _decoding(path: str, joined: bool, names: list[str]):
    def run(batches):
        speller = _speller(path, joined)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                lists = part.column(len(names))
                sizes = np.array([0 if k is None else k for k in pa.compute.list_value_length(lists).to_pylist()], np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), speller.spell(ids, sizes)],
                                                 [*names, "decoded"])
    return run


def decode(encoded: DataFrame, path: str, ids: str = "ids", joined: bool = True) -> DataFrame:
    """``encoded`` with ``decoded``; null ids spell nothing.  ``joined``: the library's form (see ``Speller``)."""
    encoded = without(encoded, "decoded", "_ids")
    names = encoded.columns
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.schema.fields)
    return encoded.select(*names, F.col(ids).alias("_ids")).mapInArrow(_decoding(path, joined, names), f"{fields}decoded string")
