"""Kernels over bytes: same values as their definitions, in memory that does not grow with the text."""

import collections
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from windrift.llm import lattice
from windrift.llm import textvec as tv


def _defined(run: bytes) -> int:
    """The hash of one run of bytes, digit by digit."""
    h, mask = 0, (1 << 64) - 1
    for k, b in enumerate(run):
        h = (h + int(tv._BYTE[b]) * pow(int(tv._BASE), k, 1 << 64)) & mask
    h ^= (len(run) * int(tv.COEF[0])) & mask
    return int(tv.mix(np.array([h], np.uint64))[0])


@pytest.mark.parametrize("longest", [3, 200, 90_000])
def test_span_hashes_are_as_defined(longest):
    rng = np.random.default_rng(longest)
    lens = rng.integers(1, longest + 1, max(4, 150_000 // longest))
    data = rng.integers(0, 256, int(lens.sum())).astype(np.uint8)
    first = np.cumsum(lens) - lens
    got = tv.span_hashes(data, first)
    for i in [0, 1, len(lens) // 2, len(lens) - 2, len(lens) - 1]:
        assert int(got[i]) == _defined(data[first[i]:first[i] + min(lens[i], 90_000)].tobytes())
    assert (got[:3] == tv.span_hashes(data[:first[3]], first[:3])).all()


def test_span_hashes_take_little_memory():
    data = np.random.default_rng(1).integers(0, 256, 1 << 21).astype(np.uint8)
    first = np.arange(0, len(data), 16)
    tv.span_hashes(data[:1 << 17], first[:1 << 13])
    tracemalloc.start()
    tv.span_hashes(data, first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * len(data)  # an array of places, or of powers, would take 8 bytes for each byte


def test_code_points_of_valid_and_broken_bytes():
    text = "aé▁﻿\U0001f600\x00z" * 50
    points, lead = tv.code_points(np.frombuffer(text.encode(), np.uint8))
    assert points.tolist() == [ord(c) for c in text]
    assert lead.tolist() == np.cumsum([0, *(len(c.encode()) for c in text)])[:-1].tolist()
    points, lead = tv.code_points(np.frombuffer(b"a\xff\xfeb", np.uint8))
    assert len(points) == len(lead) == 4 and points[0] == ord("a") and points[3] == ord("b")


def test_counted_segments_come_together(monkeypatch):
    """Segments of many slices are counted exactly, and put out again only when too many are held."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [f"word{i % 7} some été x{i}" for i in range(300)] + [None, "", "  "]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    model, want = lattice.pieces(path), collections.Counter()
    for _, data, offsets in lattice._prepared_slices(batch.column(0)):
        first = lattice.segment_starts(model, data, offsets)
        want.update(data[a:b].tobytes().decode() for a, b in zip(first, [*first[1:], len(data)], strict=True))
    for held, most in ((10, None), (lattice.HELD, 1)):
        monkeypatch.setattr(lattice, "HELD", held)
        got = list(lattice._counting(path)(batch.slice(i, 10) for i in range(0, len(texts), 10)))
        total = collections.Counter()
        for b in got:
            assert len(set(b.column(0).to_pylist())) == b.num_rows
            total.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
        assert total == want and (most is None or len(got) == most) and (most or len(got) > 1)
