"""Token counts of a byte-level BPE by compiled finite-state transducers.

Two deterministic transducers are chained.

* The *splitter* reads classes of code points and emits a mark wherever a
  pre-token of the vocabulary's split rule begins.  A text is cut into chunks; each
  chunk is run from every state at once, which gives its state map; the maps are
  composed by a parallel prefix scan, and a second run from the now known entry
  states emits the marks.
* The *counter* reads the bytes of one pre-token.  After each prefix the encoding
  has one last token; its states are the prefixes up to what can still matter, the
  pending (trie node, last token, count behind) triples, and each transition is
  annotated with the change of the token count.  States are compiled when first
  reached, as the full machine is far larger than the part that texts use.

The rule that makes the counter deterministic: a token sequence is the encoding of
its bytes exactly if each neighbouring pair is, so a cut survives by looking at its
last token alone.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from windrift.llm import textvec as tv
from windrift.llm.common import without

#: Code points of a chunk of the scan.
CHUNK = 64
#: Compiled states beyond which the counter starts anew.
MAX_STATES = 200_000

# Classes of code points, as the split rule tells them apart.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, END = range(7)
# Letters with a part in the contractions 's 't 're 've 'm 'll 'd, and one that is a letter only.
PLAIN, S1, R, V, L, E = range(6)


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """Class of every code point: 0 letter, 1 number, 2 other, 3 white space, 4 space, 5 quote."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    other = out.copy()
    for kind, initial in ((LETTER, "L"), (NUMBER, "N")):
        for run in regex.finditer(rf"\p{{{initial}}}+", every):
            for c in run[0]:
                out[ord(c)] = kind
    for c in every:
        other[ord(c)] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)
    # the two know different versions of Unicode; where they differ, the library's own splitter says
    apart = [int(c) for c in np.flatnonzero(out != other)]
    pieces = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str("".join(f"\na{chr(c)}1" for c in apart))
    begins = np.zeros(4 * len(apart) + 1, bool)
    begins[[span[0] for _, span in pieces]] = True
    for i, c in enumerate(apart):  # a letter goes with the a before it, a number with the 1 after it
        out[c] = LETTER if not begins[4 * i + 2] else NUMBER if not begins[4 * i + 3] else OTHER
    # The White_Space code points.
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    out[0x20] = SPACE
    out[0x27] = QUOTE
    return out


# --- the splitter -------------------------------------------------------------
# Inputs: the class, refined by what follows where the rule looks ahead:
#   LETTER NUMBER OTHER, QUOTE2 / QUOTE3 (a quote that opens a contraction of 2 or 3 characters if a pre-token starts
#   there), QUOTE (any other quote), GAP (white space before white space or the end), LAST (the last blank of a run that
#   is not a space, before something else), LEAD (a space right before something else), RESET (start of a text).
IN_LETTER, IN_NUMBER, IN_OTHER, IN_QUOTE, IN_QUOTE2, IN_QUOTE3, IN_GAP, IN_LAST, IN_LEAD, IN_RESET = range(10)
# States: what the current pre-token is made of.
Q_START, Q_LEAD, Q_LETTER, Q_NUMBER, Q_OTHER, Q_GAP, Q_LAST, Q_IN2, Q_IN3, Q_DONE = range(10)
N_STATES = 10


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, mark) tables, both [state, input]."""
    to, mark = np.zeros((N_STATES, 10), np.uint8), np.zeros((N_STATES, 10), bool)
    runs = {IN_LETTER: Q_LETTER, IN_NUMBER: Q_NUMBER, IN_OTHER: Q_OTHER, IN_QUOTE: Q_OTHER}
    for q in range(N_STATES):
        for x in range(10):
            if x == IN_RESET:
                to[q, x], mark[q, x] = Q_START, True
            elif q == Q_IN3:  # one more character of the contraction follows this one
                to[q, x], mark[q, x] = Q_IN2, False
            elif q == Q_IN2:
                to[q, x], mark[q, x] = Q_DONE, False
            elif x in (IN_QUOTE2, IN_QUOTE3):
                if q in (Q_OTHER, Q_LEAD):  # inside a run of others, or behind the space that leads one
                    to[q, x], mark[q, x] = Q_OTHER, False
                else:
                    to[q, x], mark[q, x] = (Q_IN2 if x == IN_QUOTE2 else Q_IN3), True
            elif x in runs:
                to[q, x], mark[q, x] = runs[x], q not in (runs[x], Q_LEAD)
            elif x == IN_GAP:
                to[q, x], mark[q, x] = Q_GAP, q != Q_GAP
            elif x == IN_LAST:
                to[q, x], mark[q, x] = Q_LAST, True
            else:
                to[q, x], mark[q, x] = Q_LEAD, True
    return to, mark


TO, MARK = _splitter()


def _inputs(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Splitter inputs of code points; ``first``: where a text starts (RESET is
    given apart, in front of the text)."""
    cls = code_point_classes()[points]
    n = len(points)
    after = np.full(n, END, np.uint8)
    after[:-1] = cls[1:]
    ends = np.zeros(n + 1, bool)
    ends[first] = True
    ends[n] = True
    after[ends[1:]] = END
    out = np.full(n, IN_OTHER, np.uint8)
    out[cls == LETTER] = IN_LETTER
    out[cls == NUMBER] = IN_NUMBER
    white = (cls == BLANK) | (cls == SPACE)
    stays = (after == BLANK) | (after == SPACE) | (after == END)
    out[white & stays] = IN_GAP
    out[white & ~stays] = IN_LAST
    out[(cls == SPACE) & ~stays] = IN_LEAD
    at = np.flatnonzero(cls == QUOTE)
    if len(at):
        out[at] = IN_QUOTE
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        has1 = ~ends[at + 1]
        has2 = has1 & ~ends[np.minimum(at + 2, n)]
        single = has1 & np.isin(one, [ord(c) for c in "stmd"])
        pair = has2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
                       | ((one == ord("l")) & (two == ord("l"))))
        out[at[pair]] = IN_QUOTE3
        out[at[single]] = IN_QUOTE2
    return out


def scan_states(inputs: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """State in front of every input, from START: chunk state maps, composed by a
    parallel prefix scan, then a run of all chunks from their entry states."""
    n = len(inputs)
    k = -(-n // chunk)
    grid = np.full(k * chunk, IN_RESET, np.uint8)
    grid[:n] = inputs
    grid = grid.reshape(k, chunk)
    flat = (TO.astype(np.int16) * 10).ravel()  # indexed by state * 10 + input, giving the next state * 10
    grid = np.ascontiguousarray(grid.T)
    maps = np.tile(np.arange(0, 10 * N_STATES, 10, dtype=np.int16)[:, None], (1, k))
    for j in range(chunk):
        maps = flat[maps + grid[j]]
    maps = np.ascontiguousarray(maps.T) // 10
    step = 1
    while step < k:  # inclusive scan: maps[i] becomes the map of chunks 0..i
        head, tail = maps[:-step], maps[step:]
        maps = np.concatenate([maps[:step], np.take_along_axis(tail, head.astype(np.intp), 1)])
        step *= 2
    state = np.concatenate([[Q_START], maps[:-1, Q_START]]).astype(np.int16) * 10
    before = np.empty((chunk, k), np.uint8)
    for j in range(chunk):
        before[j] = state // 10
        state = flat[state + grid[j]]
    before = before.T
    return before.ravel()[:n]


# --- the counter --------------------------------------------------------------
def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Lazily compiled transducer from bytes of a pre-token to token counts."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kept = (spec["normalizer"], spec["pre_tokenizer"]["type"], spec["pre_tokenizer"]["add_prefix_space"],
                spec["model"]["type"], spec["model"].get("ignore_merges", False))
        if kept != (None, "ByteLevel", False, "BPE", False):
            raise ValueError(f"not a plain byte-level BPE: {kept}")
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings are not supported")
        byte = _byte_symbols()
        vocab = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # of each merged token: when it is made, and of what; -1 for the single bytes
        self.made, self.left, self.right = [-1] * len(vocab), [-1] * len(vocab), [-1] * len(vocab)
        self.rank: dict[int, int] = {}
        for r, (x, y) in enumerate(pairs):
            x, y = bytes(byte[c] for c in x), bytes(byte[c] for c in y)
            i, u, v = vocab[x + y], vocab[x], vocab[y]
            self.rank[u << 32 | v] = r
            if self.made[i] < 0:
                self.made[i], self.left[i], self.right[i] = r, u, v
        # the trie of the vocabulary: node << 8 | byte -> node
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for t, i in vocab.items():
            node = 0
            for c in t:
                self.inner[node] = True
                to = self.child.get(node << 8 | c)
                if to is None:
                    to = self.child[node << 8 | c] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = to
            self.token[node] = i
        self.known: dict[int, bool] = {}
        self.max_states = max_states
        self._reset()

    def _reset(self) -> None:
        # a state: (pending trie node, last token before it, count there less the count here) of each live cut
        start = ((0, -1, 0),)
        self.ids, self.states = {start: 0}, [start]
        self.to: dict[int, tuple[int, int]] = {}  # state << 8 | byte -> (state, change of the count)

    def _together(self, a: int, b: int) -> bool:
        """Whether the tokens a, b are the encoding of their bytes: undo the later of
        the two again and again; no merge across the cut may come before that."""
        limit = 1 << 60
        while True:
            r = self.rank.get(a << 32 | b)
            if r is not None and r < limit:
                return False
            if self.made[a] > self.made[b]:
                limit, a = self.made[a], self.right[a]
            elif self.made[b] < 0:
                return True
            else:
                limit, b = self.made[b] + 1, self.left[b]

    def stand_together(self, a: int, b: int) -> bool:
        key = a << 32 | b
        out = self.known.get(key)
        if out is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            out = self.known[key] = a < 0 or self._together(a, b)
        return out

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        new, last, ahead = [], -1, 0
        for node, token, behind in self.states[state]:
            grown = self.child.get(node << 8 | byte)
            if grown is None:
                continue
            if last < 0 and (t := self.token[grown]) >= 0 and self.stand_together(token, t):
                last, ahead = t, behind + 1
            if self.inner[grown]:
                new.append((grown, token, behind))
        if last < 0:
            raise ValueError("no encoding of a prefix")
        rebased = (*((n, t, c - ahead) for n, t, c in new), (0, last, 0))
        to = self.ids.get(rebased)
        if to is None:
            to = self.ids[rebased] = len(self.states)
            self.states.append(rebased)
        out = self.to[state << 8 | byte] = to, ahead
        return out

    def count(self, token: bytes) -> int:
        """Tokens of one pre-token: the sum of the annotations along its path."""
        if len(self.states) > self.max_states:
            self._reset()
        state = total = 0
        get = self.to.get
        for byte in token:
            step = get(state << 8 | byte) or self._compile(state, byte)
            state, change = step
            total += change
        return total


@lru_cache(4)
def _counter(path: str) -> Counter:
    return Counter(path)


class _Memo:
    """Counts of pre-tokens by hash, sorted; bounded, and kept between batches."""

    def __init__(self, limit: int = 2_000_000):
        self.keys, self.counts, self.limit = np.zeros(0, np.uint64), np.zeros(0, np.int32), limit

    def counted(self, hashes, first, last, data, counter) -> np.ndarray:
        keys, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, keys)
        found = np.zeros(len(keys), bool)
        if len(self.keys):
            found = self.keys[np.minimum(where, len(self.keys) - 1)] == keys
        out = np.zeros(len(keys), np.int64)
        out[found] = self.counts[where[found]]
        missing = np.flatnonzero(~found)
        raw = data.tobytes() if len(missing) else b""
        for i in missing:
            out[i] = counter.count(raw[first[at[i]]:last[at[i]]])
        if len(missing):
            if len(self.keys) > self.limit:
                self.keys, self.counts = self.keys[:0], self.counts[:0]
            merged = np.concatenate([self.keys, keys[missing]])
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.counts = np.concatenate([self.counts, out[missing].astype(np.int32)])[order]
        return out[back.ravel()]


def pre_tokens(data: np.ndarray, offsets: np.ndarray, specials: list[bytes]):
    """(first byte, last byte + 1, is a special token) of all pre-tokens of the texts
    in ``data``, which ``offsets`` cut."""
    cuts, special = offsets[:-1][np.diff(offsets) > 0], np.zeros(0, np.int64)
    if specials and len(data):
        raw = data.tobytes()
        spans = []
        at = 0
        while True:
            hits = [(i, -len(s)) for s in specials if (i := raw.find(s, at)) >= 0]
            if not hits:
                break
            i, size = min(hits)
            row = int(np.searchsorted(offsets, i, "right")) - 1
            if i - size <= offsets[row + 1]:
                spans.append((i, i - size))
                at = i - size
            else:
                at = i + 1
        if spans:
            special = np.array([a for a, _ in spans])
            cuts = np.unique(np.concatenate([cuts, special, [b for _, b in spans if b < len(data)]]))
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    points, lead = tv.code_points(data)
    cut_points = np.searchsorted(lead, cuts)
    inputs = _inputs(points, cut_points)
    states = scan_states_with_cuts(inputs, cut_points)
    mark = MARK.ravel()[states.astype(np.intp) * 10 + inputs]
    mark[cut_points] = True
    if len(special):  # a special token is one piece
        inside = np.zeros(len(data) + 1, np.int32)
        ends = np.array([b for _, b in spans])
        inside[special + 1] += 1
        inside[ends] -= 1
        mark &= np.cumsum(inside)[:-1][lead] == 0
    first = lead[mark]
    last = np.append(first[1:], len(data))
    return first, last, np.isin(first, special)


def scan_states_with_cuts(inputs: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """State in front of every input when each cut starts anew: a RESET is put in
    front of each."""
    n = len(inputs)
    place = np.arange(n) + np.searchsorted(cuts, np.arange(n), "right")
    wide = np.full(n + len(cuts), IN_RESET, np.uint8)
    wide[place] = inputs
    return scan_states(wide)[place]


def _count_rows(counter: Counter, memo: _Memo, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    first, last, special = pre_tokens(data, offsets, counter.specials)
    if not len(first):
        return np.zeros(len(offsets) - 1, np.int64)
    ones = np.ones(len(first), np.int64)
    plain = np.flatnonzero(~special)
    hashes = tv.span_hashes(data, first)[plain]
    ones[plain] = memo.counted(hashes, first[plain], last[plain], data, counter)
    total = np.concatenate([[0], np.cumsum(ones)])
    at = np.searchsorted(first, offsets)
    return total[at[1:]] - total[at[:-1]]


def _counting(path: str):
    def run(batches):
        counter, memo = _counter(path), _Memo()
        for batch in batches:
            for at, data, offsets in tv.slices(batch.column(batch.num_columns - 1)):
                rows = len(offsets) - 1
                keys = [batch.column(i).slice(at, rows) for i in range(batch.num_columns - 1)]
                counts = _count_rows(counter, memo, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(np.diff(offsets)), pa.array(counts)],
                    [*batch.schema.names[:-1], "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit.  Null and empty texts have no
    tokens; repeated rows are counted each; an empty table gives no rows; columns
    named like an output are replaced."""
    docs = without(docs, "n_bytes", "n_tokens", "over_limit")
    rest = [c for c in docs.columns if c != text]
    ordered = docs.select(*rest, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[:-1])
    out = ordered.mapInArrow(_counting(path), f"{schema}{', ' if schema else ''}n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
