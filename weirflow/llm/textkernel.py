"""Vectorised text primitives for Arrow batches: word hashes, shingles, grouping of sorted streams.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, hashed over their UTF-8
bytes, so that no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; a longer document is hashed on its own.
CHUNK_BYTES = 1 << 19

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x += _STEP
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """Hashes the words of texts; holds the lookup tables of one worker."""

    BASE = 0xD1342543DE82EF95

    def __init__(self, lower: bool = True) -> None:
        codes = np.arange(256)
        if lower:
            codes[65:91] += 32
        self.value = mix64(codes)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.ahead = self.back = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.ahead) < n:
            self.ahead = powers(self.BASE, n)
            self.back = powers(pow(self.BASE, -1, 1 << 64), n)

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, bytes, offsets of each text in them) for runs of whole texts; null is empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
            yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first byte, end byte) of each word, and how many words precede each text."""
        n = len(data)
        if not n:
            empty = np.zeros(0, np.int64)
            return empty.astype(np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
        solid = ~self.space[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        start = solid.copy()
        start[1:] &= ~solid[:-1] | cut[1:n]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | cut[1:n]
        first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
        self._grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.multiply(self.value[data], self.ahead[:n], out=total[1:])
        np.cumsum(total, out=total)
        hashed = mix64((total[last] - total[first]) * self.back[first] + (last - first).astype(np.uint64))
        return hashed, first, last, np.searchsorted(first, offsets)


def shingles(hashed: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles of each text, and how many precede each text.

    A text with fewer words, but at least one, has its whole sequence as one shingle.
    """
    counts = np.diff(before)
    usual = np.maximum(counts - width + 1, 0)
    number = np.where(counts > 0, np.maximum(usual, 1), 0)
    ahead = np.concatenate([[0], np.cumsum(number)])
    factors = powers(0xA24BAED4963EE407, width + 1)[1:]
    if len(hashed) >= width:
        rolled = np.zeros(len(hashed) - width + 1, np.uint64)
        for j in range(width):
            rolled += hashed[j : len(hashed) - width + 1 + j] * factors[j]
        within = np.zeros(len(hashed) + 1, np.int64)
        has = usual > 0
        np.add.at(within, before[:-1][has], 1)
        np.add.at(within, (before[:-1] + usual)[has], -1)
        rolled = rolled[np.cumsum(within)[: len(rolled)] > 0]
    else:
        rolled = np.zeros(0, np.uint64)
    out = np.empty(ahead[-1], np.uint64)
    short = (counts > 0) & (counts < width)
    is_usual = np.ones(len(out), bool)
    is_usual[ahead[:-1][short]] = False
    out[is_usual] = rolled
    for i in np.flatnonzero(short):
        own = hashed[before[i] : before[i + 1]]
        out[ahead[i]] = np.sum(own * factors[: len(own)], dtype=np.uint64) + np.uint64(len(own))
    return mix64(out), ahead


def shingle_sets(hasher: WordHasher, texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in hasher.chunks(texts):
        hashed, _, _, before = hasher.words(data, offsets)
        found, ahead = shingles(hashed, before, width)
        for i in range(len(offsets) - 1):
            yield np.unique(found[ahead[i] : ahead[i + 1]])


def list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of numpy arrays, without a Python object for each value."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole runs of rows with equal keys, and the first row of each run and the end.

    Rows with equal keys must be consecutive in the stream. At most a batch and one run are held.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
        change[0] = last is not None and last != tuple(batch.column(key)[0].as_py() for key in keys)
        last = tuple(batch.column(key)[batch.num_rows - 1].as_py() for key in keys)
        at = np.flatnonzero(change)
        if len(at):
            if held or at[-1]:
                yield _bounded(pa.Table.from_batches([*held, batch.slice(0, int(at[-1]))]), keys)
            held = [batch.slice(int(at[-1]))]
        else:
            held.append(batch)
    if held:
        yield _bounded(pa.Table.from_batches(held), keys)


def _bounded(table: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    change = np.ones(table.num_rows, bool)
    change[1:] = False
    for key in keys:
        column = table.column(key).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return table.combine_chunks(), np.append(np.flatnonzero(change), table.num_rows)


class Forest:
    """Union-find over positions; find() gives the smallest position of a tree."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
