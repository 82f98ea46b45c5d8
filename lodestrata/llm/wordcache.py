"""Token ids of whole texts with each distinct unit encoded once for each Python worker."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa

from .common import Words


class UnitEncoder:
    """Splits texts into byte ranges that encode independently and keeps the ids of those it has met.

    A subclass gives `_units` (begin, end, first unit of each text) and `_ids` (ids of new units: all
    of them in a row, and how many each has). Units are told apart by their bytes. Of a block the
    distinct ones are looked up; at most about `most` are kept, past that it starts anew. `end` is an
    id put after each text, or None."""

    end: int | None = None

    def __init__(self, most: int = 400_000):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.entry: dict[bytes, int] = {}
        self.at, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _enter(self, units: list[bytes], ids: np.ndarray, length: np.ndarray) -> None:
        self.entry.update(zip(units, range(len(self.at), len(self.at) + len(units)), strict=True))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(length) - length])
        self.length, self.ids = np.concatenate([self.length, length]), np.concatenate([self.ids, ids.astype(np.uint32)])

    def _entries(self, units: pa.BinaryArray) -> np.ndarray:
        """The entry of each unit; unknown ones are learnt, each once."""
        if len(self.entry) > self.most:
            self._clear()
        coded = units.dictionary_encode()
        listed = coded.dictionary.to_pylist()
        of = np.fromiter(map(self.entry.get, listed, itertools.repeat(-1)), np.int64, len(listed))
        if len(new := np.flatnonzero(of < 0)):
            of[new] = np.arange(len(self.at), len(self.at) + len(new))
            fresh = [listed[i] for i in new.tolist()]
            self._enter(fresh, *self._ids(fresh))
        return of[coded.indices.to_numpy()]

    def _units(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and each text's number of ids."""
        words = Words(texts)
        begin, end, first = self._units(words)
        entry = self._entries(words.units(begin, end)) if len(begin) else np.zeros(0, np.int64)
        length, at = self.length[entry], self.at[entry]
        ends = np.concatenate([[0], np.cumsum(length)])
        n_docs = len(first) - 1
        sizes = np.diff(ends[first])
        total = int(ends[-1])
        source = np.repeat(at - ends[:-1], length) + np.arange(total)
        if self.end is None:
            return self.ids[source], sizes
        out = np.empty(total + n_docs, np.uint32)
        out[np.arange(total) + np.repeat(np.arange(n_docs), sizes)] = self.ids[source]
        out[np.cumsum(sizes + 1) - 1] = self.end
        return out, sizes + 1
