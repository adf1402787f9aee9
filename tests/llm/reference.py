"""Brute-force versions, on plain Python rows (doc_id, text)."""

import collections
import hashlib
import re

UP = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD, TERM = r"[^\x20\x09-\x0d]+", r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def line_dedup(docs, min_chars=40, min_docs=5):
    """{(doc_id, text): (n_lines, n_dropped, kept text)}"""
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UP)

    held = collections.defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held[key(line)].add(i)
    top = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or top.get(key(x), i) == i]
        out[i, t] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def quality(docs):
    """{(doc_id, text): (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)}"""
    out = {}
    for i, t in docs:
        w = re.findall(WORD, t or "")
        seen = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if seen[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        out[i, t] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
    return out


def contamination(docs, bench):
    """{(doc_id, text): (n_words, n_hit, item ids)}"""
    win, sizes = collections.defaultdict(set), set()
    for i, t in bench:
        w = re.findall(TERM, (t or "").translate(UP))
        if w and i is not None:
            m = min(10, len(w))
            sizes.add(m)
            for k in range(len(w) - m + 1):
                win[tuple(w[k:k + m])].add(str(i))
    out = {}
    for i, t in docs:
        w = re.findall(TERM, (t or "").translate(UP))
        hit, items = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                found = win.get(tuple(w[k:k + m]))
                if found:
                    hit.update(range(k, k + m))
                    items |= found
        out[i, t] = (len(w), len(hit), sorted(items))
    return out


def shingle_set(t, size=5):
    w = re.findall(WORD, (t or "").translate(UP))
    return frozenset([tuple(w[k:k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else [])


def near_components(docs):
    """{doc_id: smallest doc_id reachable}, doc_ids not null"""
    rows = [(i, shingle_set(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(rows):
        for j, r in rows[:a]:
            if s and r and 100 * len(s & r) >= 75 * len(s | r):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def quality_kept(docs):
    """Rows that no quality rule rejects."""
    import regex
    out = []
    for (i, t), (n, chars, symbols, dup, repeat) in zip(docs, [quality([d])[d] for d in docs], strict=True):
        lines = sum(bool(re.search(WORD, x)) for x in (t or "").split("\n"))
        letters, braces = len(regex.findall(r"\p{L}", t or "")), len(re.findall(r"[{}\\\[\];=]", t or ""))
        if not (n < 10 or 100 * repeat > 20 * n or chars > 40 * n or chars < 2 * n or 10 * symbols > chars
                or (lines >= 4 and 10 * dup > 5 * lines) or 10 * letters < 4 * chars or 20 * braces > chars):
            out.append((i, t))
    return out
