"""A bounded memo of token ids by the hash of a byte run, looked up for whole batches."""

from __future__ import annotations

import numpy as np


class Memo:
    """Ids of byte runs, kept sorted by hash; starts anew when ``limit`` runs are held."""

    def __init__(self, limit: int = 1_000_000):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def look_up(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray, raw: bytes, encode) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``flat``, number of ids) of each run raw[first[i]:last[i]]; ``encode`` gives the ids of one unknown run."""
        if len(self.keys) > self.limit:
            self._clear()
        keys, some, back = np.unique(hashes, return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(where, len(self.keys) - 1)] == keys
        lost = np.flatnonzero(~known)
        if len(lost):
            fresh, sizes = [], np.zeros(len(lost), np.int64)
            for k, i in enumerate(some[lost].tolist()):
                ids = encode(raw[first[i]:last[i]])
                fresh.extend(ids)
                sizes[k] = len(ids)
            at = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.concatenate([self.flat, np.array(fresh, np.int32)])
            merged = np.concatenate([self.keys, keys[lost]])
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.at = np.concatenate([self.at, at])[order]
            self.size = np.concatenate([self.size, sizes])[order]
            where = np.searchsorted(self.keys, keys)
        return self.at[where][back.ravel()], self.size[where][back.ravel()]
