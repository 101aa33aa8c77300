"""Packing of documents into token sequences: variable capacities, and packed id matrices.

Both packers place pieces in order of falling length, each into the open bin that
it leaves with the least room (best fit decreasing). Room is searched in a segment
tree over the possible amounts, in a time that grows with the logarithm of the
capacity. Each document ends with an end-of-text token, so an empty or null text
takes one token. A text longer than the largest capacity is cut into pieces of it
and a rest; pieces are named by their first token, so nothing is lost.

Packing goes on inside each input partition, in windows that end at WINDOW_DOCS
documents or WINDOW_TOKENS tokens in the order of the input: nothing is shuffled
and memory is bounded; a window leaves at most a few bins part empty. Rows are
packed one by one, repeated and null ids, too (pieces of long texts with one id can't
be told apart, as ids name texts). Equal lengths keep the input's
order. A bin's id is its partition's number times 2**40 plus its own number. Very long
runs with or without white space are cut before encoding (tokens.RUN); joined, the
tokens still give the text. Only doc_id and text are read, so other columns can't clash;
an empty table gives no bins.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weirflow.llm import tokens

WINDOW_DOCS, WINDOW_TOKENS = 16_384, 8_000_000
#: Permitted sequence lengths of variable packing.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
SEQUENCE = 2048


def sequence_cost(capacity: int) -> float:
    """What a sequence costs to train on: a part by token, a part by pair of tokens, and a fixed part."""
    return capacity + capacity * capacity / 32_768 + 16


class RoomTree:
    """Open bins by room left; take(n) finds the bin with the least room of n or more."""

    def __init__(self, most: int) -> None:
        self.base = 1 << max(1, (most + 1).bit_length())
        self.full = bytearray(2 * self.base)
        self.bins: dict[int, list[int]] = {}

    def put(self, room: int, number: int) -> None:
        own = self.bins.setdefault(room, [])
        heapq.heappush(own, number)
        if len(own) == 1:
            at = self.base + room
            while at and not self.full[at]:
                self.full[at] = 1
                at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, number) of the best fit, the lowest number where several have that room; it leaves the tree."""
        full, at = self.full, self.base + least
        if not full[at]:
            while at > 1 and (at & 1 or not full[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at + (not full[2 * at])
        room = at - self.base
        own = self.bins[room]
        number = heapq.heappop(own)
        if not own:
            full[at] = 0
            at >>= 1
            while at and not (full[2 * at] or full[2 * at + 1]):
                full[at] = 0
                at >>= 1
        return room, number


def best_fit(sizes: list[int], opened: Callable[[int, int], int]) -> tuple[list[int], list[int]]:
    """Each piece's bin, and each bin's capacity; ``opened(size, left)`` chooses the capacity of a new bin.

    ``left`` counts the tokens of the piece and of all after it.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins, capacities, left = [0] * len(sizes), [], sum(sizes)
    tree = RoomTree(max(sizes, default=0) + 1)
    for i in order:
        size = sizes[i]
        found = tree.take(size)
        if found is None:
            capacity = opened(size, left)
            found = (capacity, len(capacities))
            capacities.append(capacity)
            if capacity >= tree.base:
                wider = RoomTree(capacity)
                for room, numbers in tree.bins.items():
                    for number in numbers:
                        wider.put(room, number)
                tree = wider
        room, number = found
        bins[i] = number
        if room > size:
            tree.put(room - size, number)
        left -= size
    return bins, capacities


def pack_variable(sizes: list[int], capacities: tuple[int, ...], cost: Callable[[int], float]) -> tuple[list[int], list[int]]:
    """Each piece's bin and each bin's capacity, at the least total cost of those tried.

    Tried are, with each capacity as a limit, new bins of the capacity with the least
    cost for each token that they can get to hold, none above the limit but for pieces
    that fit no smaller one; and, with each capacity as a floor, new bins of it or of the
    least that fits. From the cheapest floor on, the opening of the pieces of each
    least fitting capacity is changed alone, as long as that saves. After each try, bins are
    downsized to the least capacity that holds their contents; the first of equal packings counts.
    """
    sizes_up = sorted(set(capacities))
    best: tuple[float, list[int], list[int]] | None = None

    def attempt(opened: Callable[[int, int], int]) -> float:
        nonlocal best
        bins, opened_as = best_fit(sizes, opened)
        held = [0] * len(opened_as)
        for i, b in enumerate(bins):
            held[b] += sizes[i]
        final = [sizes_up[bisect.bisect_left(sizes_up, h)] for h in held]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = (total, bins, final)
        return total

    for limit in sizes_up:

        def limited(size: int, left: int, limit: int = limit) -> int:
            fitting = [c for c in sizes_up if c >= size]
            chosen = [c for c in fitting if c <= limit] or fitting[:1]
            return min(chosen, key=lambda c: (cost(c) / min(c, left), c))

        attempt(limited)

    tried: dict[tuple[int, ...], float] = {}

    def openings(plan: tuple[int, ...]) -> float:
        """The total if the pieces whose least fitting capacity is number k open plan[k]."""
        if plan not in tried:
            tried[plan] = attempt(lambda size, left: plan[bisect.bisect_left(sizes_up, size)])
        return tried[plan]

    plan = min((tuple(max(c, floor) for c in sizes_up) for floor in sizes_up), key=openings)
    present = {bisect.bisect_left(sizes_up, size) for size in sizes}
    saves = True
    while saves:
        near = [(*plan[:k], c, *plan[k + 1 :]) for k in sorted(present) for c in sizes_up[k:]]
        found = min(near, key=openings, default=plan)
        saves = openings(found) < openings(plan)
        plan = found if saves else plan
    return best[1:] if best else ([], [])


def _pieces(length: int, most: int) -> list[tuple[int, int]]:
    """(first token, tokens) of the pieces of a document."""
    return [(a, min(most, length - a)) for a in range(0, length, most)]


def variable_packing(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = sequence_cost, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """doc_id, token_start, n_tokens, bin_id, bin_offset and bin_size of each piece of each row of ``docs``."""
    sent = tokens.send(docs.sparkSession, vocabulary)
    most = max(capacities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoding(sent.value)
        base, number = TaskContext.get().partitionId() << 40, 0
        held: list[tuple[int | None, int]] = []
        waiting = 0

        def packed() -> pa.RecordBatch:
            nonlocal number, held, waiting
            pieces = [(doc, a, n) for doc, length in held for a, n in _pieces(length, most)]
            bins, sizes = pack_variable([p[2] for p in pieces], capacities, cost)
            offset, used = [], [0] * len(sizes)
            for (_, _, n), b in zip(pieces, bins, strict=True):
                offset.append(used[b])
                used[b] += n
            columns = [
                pa.array([p[0] for p in pieces], pa.int64()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([base + number + b for b in bins], pa.int64()),
                pa.array(offset, pa.int64()),
                pa.array([sizes[b] for b in bins], pa.int64()),
            ]
            number += len(sizes)
            held, waiting = [], 0
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "token_start", "n_tokens", "bin_id", "bin_offset", "bin_size"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((doc, tokens.count(enc, text.as_py() or "") + 1))
                waiting += held[-1][1]
                if len(held) >= WINDOW_DOCS or waiting >= WINDOW_TOKENS:
                    yield packed()
        if held:
            yield packed()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, token_start long, n_tokens long, bin_id long, bin_offset long, bin_size long")


def packed_ids(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """A row for each packed sequence of at most ``sequence`` tokens.

    bin_id; doc_ids and token_starts, the document and first token of each segment;
    cu_seqlens, where each segment begins and the last one ends; resets, the places
    where positions begin at 0 again; input_ids and position_ids, the matrix rows of
    ``sequence`` little-endian 16-bit numbers, filled up with end-of-text ids and 0.
    """
    sent = tokens.send(docs.sparkSession, vocabulary)
    schema = "bin_id long, doc_ids array<long>, token_starts array<int>, cu_seqlens array<int>, resets array<int>, input_ids binary, position_ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoding(sent.value)
        end = tokens.end_of_text(enc)
        if end >= 1 << 16:
            raise ValueError("ids of this vocabulary don't fit 16 bits")
        base, number = TaskContext.get().partitionId() << 40, 0
        held: list[tuple[int | None, int, np.ndarray]] = []
        waiting = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, waiting
            bins, capacities = best_fit([len(p[2]) for p in held], lambda size, left: sequence)
            members: list[list[int]] = [[] for _ in capacities]
            for i, b in enumerate(bins):
                members[b].append(i)
            for a in range(0, len(members), 1000):
                part = members[a : a + 1000]
                ids = np.full((len(part), sequence), end, "<u2")
                places = np.zeros((len(part), sequence), "<u2")
                bounds = []
                for r, own in enumerate(part):
                    at = [0]
                    for i in own:
                        piece = held[i][2]
                        ids[r, at[-1] : at[-1] + len(piece)] = piece
                        places[r, at[-1] : at[-1] + len(piece)] = np.arange(len(piece))
                        at.append(at[-1] + len(piece))
                    bounds.append(at)
                columns = [
                    pa.array(range(base + number, base + number + len(part)), pa.int64()),
                    pa.array([[held[i][0] for i in own] for own in part], pa.list_(pa.int64())),
                    pa.array([[held[i][1] for i in own] for own in part], pa.list_(pa.int32())),
                    pa.array(bounds, pa.list_(pa.int32())),
                    pa.array([x[:-1] for x in bounds], pa.list_(pa.int32())),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array([x.tobytes() for x in places], pa.binary()),
                ]
                number += len(part)
                yield pa.RecordBatch.from_arrays(columns, ["bin_id", "doc_ids", "token_starts", "cu_seqlens", "resets", "input_ids", "position_ids"])
            held, waiting = [], 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(tokens.ids(enc, text.as_py() or ""), end).astype("<u2")
                held += [(doc, a, ids[a : a + n]) for a, n in _pieces(len(ids), sequence)]
                waiting += len(ids)
                if len(held) >= WINDOW_DOCS or waiting >= WINDOW_TOKENS:
                    yield from packed()
        if held:
            yield from packed()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, schema)


def write_packed(docs: DataFrame, path: str, sequence: int = SEQUENCE, vocabulary: str = tokens.VOCABULARY) -> None:
    """Writes the packed sequences as Parquet files of binary matrix rows below ``path``, which executors must reach."""
    packed_ids(docs, sequence, vocabulary).write.parquet(path)
