"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size into classes (cap / 2, cap] of shingles. For a
class, each document is covered by windows of 2 * cap consecutive shingles that
start every cap, so that any passage of up to cap shingles lies whole inside one
window and makes up at least a quarter of it: inside a size partition containment
becomes a Jaccard similarity that MinHash sees, however long the document is.
FUNCTIONS minima of each window are looked up among the items' minima of that
class and function; one hit makes a candidate. A candidate counts only if the exact
share of the item's distinct shingles that occur anywhere in the whole document
reaches the threshold.

Recall: an item of n shingles has its smallest one under a function in the document
with the chance of its containment, and that one is the smallest of its window of
2 * cap < 4 n shingles, too, with one of at least n / (n + 4 n). That holds wherever
the pieces lie. So a verbatim item is missed with a chance of at most (3/4) ** 64 in one
window, or (4/5) ** 64, under 1e-6, in scattered pieces; one of which 0.8 is there with
(1 - 0.8 / 5) ** 64, about 1e-5.

Minima of larger windows come from those of smaller ones, so a document's shingles
are hashed once per function.

The items are the stated query set. Repeated ones count once until the end. Their
sketches are made by the executors, and they are taken in blocks of at most about
BLOCK_ITEMS items and BLOCK_SHINGLES shingles: a block is fetched, sent to the
executors, searched for and its hits written before the next one, so neither the
driver nor a broadcast grows with their number, but the documents are read once for
each block. Documents are never shuffled.

Items with fewer words than a shingle are matched by their whole word sequence. Null
or wordless items match nothing, null or wordless documents hold nothing. A row
comes out for each document row and item row that match, so repeated rows repeat.
Other columns don't matter, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import textkernel as tk
from weirflow.llm.scratch import Scratch, column, fresh
from weirflow.llm.shipping import send

FUNCTIONS = 64
#: Items and their shingles in a broadcast, about: half a KB each, and 8 bytes each.
BLOCK_ITEMS, BLOCK_SHINGLES = 100_000, 10_000_000


def _multipliers() -> np.ndarray:
    return tk.mix64(np.arange(1, FUNCTIONS + 1)) | np.uint64(1)


class ItemIndex:
    """The sketches of a block of items of one shingle width, by size class and function."""

    def __init__(self, keys: list[int], sets: list[np.ndarray], minima: np.ndarray, width: int) -> None:
        self.width, self.ids, self.sets = width, keys, sets
        self.multipliers = _multipliers()
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        caps = np.array([1 << (len(x) - 1).bit_length() for x in sets])
        for cap in np.unique(caps).tolist():
            members = np.flatnonzero(caps == cap)
            orders = np.argsort(minima[members], axis=0, kind="stable")
            self.classes[cap] = [(minima[members[orders[:, f]], f], members[orders[:, f]]) for f in range(FUNCTIONS)]
        self.smallest = min(self.classes, default=1)
        #: For each function, which top 16 bits a minimum of any class has: most windows end here.
        self.coarse = []
        for f in range(FUNCTIONS):
            table = np.zeros(1 << 16, bool)
            for own in self.classes.values():
                table[(own[f][0] >> np.uint64(48)).astype(np.int64)] = True
            self.coarse.append(table)

    def candidates(self, found: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """Distinct (text * number of items + item) for texts whose windows share a minimum with an item.

        ``found`` holds the shingles of all texts in order, ``ahead`` how many precede each text.
        """
        n_texts, n_items = len(ahead) - 1, len(self.sets)
        counts = np.diff(ahead)
        hits: list[np.ndarray] = []
        if not n_items or not len(found):
            return np.zeros(0, np.int64)
        # Blocks of as many shingles as the smallest class's cap, which end with their text.
        blocks = -(-counts // self.smallest)
        at = np.concatenate([[0], np.cumsum(blocks)])
        text = np.repeat(np.arange(n_texts), blocks)
        start = ahead[:-1][text] + (np.arange(at[-1]) - at[:-1][text]) * self.smallest
        plans, cap, own_text = [], self.smallest, text
        largest = max(self.classes)
        while cap <= largest:
            next_same = np.append(own_text[1:] == own_text[:-1], False)
            plans.append((cap, own_text, next_same))
            first = np.append(True, own_text[1:] != own_text[:-1])
            rank = np.arange(len(own_text)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            own_text = own_text[rank % 2 == 0]
            plans[-1] += (rank % 2 == 0,)
            cap *= 2
        for f in range(FUNCTIONS):
            minima = np.minimum.reduceat(found * self.multipliers[f], start)
            for cap, own_text, next_same, even in plans:
                pair = minima.copy()
                pair[:-1][next_same[:-1]] = np.minimum(minima[:-1], minima[1:])[next_same[:-1]]
                if cap in self.classes:
                    maybe = np.flatnonzero(self.coarse[f][(pair >> np.uint64(48)).astype(np.int64)])
                    values, members = self.classes[cap][f]
                    lo = np.searchsorted(values, pair[maybe], "left")
                    hi = np.searchsorted(values, pair[maybe], "right")
                    while (live := lo < hi).any():
                        hits.append(own_text[maybe[live]] * n_items + members[lo[live]])
                        lo = lo + 1
                minima = pair[even]
            # Each function finds the same pairs again: they are held once.
            hits = [np.unique(np.concatenate(hits))] if len(hits) > 1 else hits
        return np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)


def _search(blocks: list[ItemIndex], num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tk.WordHasher()
        for batch in batches:
            ids = batch.column(0)
            docs, items, shared, sizes = [], [], [], []
            for base, data, offsets in hasher.chunks(batch.column(1)):
                hashed, _, _, before = hasher.words(data, offsets)
                for index in blocks:
                    found, ahead = tk.shingles(hashed, before, index.width)
                    held_by, held = -1, np.zeros(0, np.uint64)
                    for pair in index.candidates(found, ahead).tolist():
                        t, k = divmod(pair, len(index.sets))
                        if t != held_by:
                            held_by, held = t, np.unique(found[ahead[t] : ahead[t + 1]])
                        both = len(np.intersect1d(held, index.sets[k], assume_unique=True))
                        if both * den >= num * len(index.sets[k]):
                            docs.append(ids[base + t].as_py())
                            items.append(index.ids[k])
                            shared.append(both)
                            sizes.append(len(index.sets[k]))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(shared, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "item", "n_shared", "n_shingles"])

    return run


def _item_sketches(width: int):
    """item_id, key, width, set and minima of each item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, multipliers = tk.WordHasher(), _multipliers()
        for batch in batches:
            rows: list[tuple] = []
            for base, data, offsets in hasher.chunks(batch.column(1)):
                hashed, _, _, before = hasher.words(data, offsets)
                for t, n in enumerate(np.diff(before).tolist()):
                    if n:
                        found, _ = tk.shingles(hashed[before[t] : before[t + 1]], np.array([0, n]), min(n, width))
                        found = np.unique(found)
                        minima = np.array([(found * f).min() for f in multipliers], np.uint64)
                        rows.append((base + t, min(n, width), hashlib.md5(bytes([min(n, width) % 256]) + found.tobytes()).digest(), found.tobytes(), minima.tobytes(), len(found)))
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [batch.column(0).take(at), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), 1)]]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "width", "key", "set", "minima", "size"])

    return run


def _indexes(table: pa.Table) -> list[ItemIndex]:
    """The indexes of a block's distinct items, one for each shingle width."""
    widths = table.column("width").to_numpy()
    items, sets, minima = table.column("item").to_pylist(), table.column("set").to_pylist(), table.column("minima").to_pylist()
    out = []
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width).tolist()
        values = np.frombuffer(b"".join(minima[i] for i in own), np.uint64).reshape(len(own), FUNCTIONS)
        out.append(ItemIndex([items[i] for i in own], [np.frombuffer(sets[i], np.uint64) for i in own], values, width))
    return out


def contamination(docs: DataFrame, items: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles and containment for each document that holds an item.

    ``docs`` has doc_id and text, ``items`` item_id and text. A document holds an
    item if den * shared distinct shingles >= num * the item's.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    sketched = scratch.keep(items.mapInArrow(_item_sketches(width), "item_id long, width int, key binary, set binary, minima binary, size long"), "items")
    distinct = sketched.groupBy("key").agg(*[F.first(c).alias(c) for c in ("width", "set", "minima", "size")])
    distinct = scratch.keep(distinct.withColumn("item", F.monotonically_increasing_id()), "distinct")
    n, shingles = distinct.agg(F.count("*"), F.sum("size")).first()
    n_blocks = max(-(-n // BLOCK_ITEMS), -(-(shingles or 0) // BLOCK_SHINGLES))
    schema = "doc_id long, item long, n_shared long, n_shingles long"
    parts = [spark.createDataFrame([], schema)] if not n_blocks else []
    for b in range(n_blocks):
        block = distinct if n_blocks == 1 else distinct.filter(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == b)
        sent = send(spark, _indexes(block.toArrow()))
        hits = docs.mapInArrow(lambda batches, sent=sent: _search(sent.value, num, den)(batches), schema)
        if n_blocks > 1:
            hits = scratch.keep(hits, f"hits-{b}")
            sent.packed.destroy()
        parts.append(hits)
    hits = reduce(DataFrame.unionAll, parts)
    # The names of each distinct item's rows.
    names = scratch.keep(sketched.select("item_id", "key").join(distinct.select("key", "item"), "key").select("item", "item_id"), "names")
    found = hits.join(names, "item").select("doc_id", "item_id", "n_shared", "n_shingles")
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns unchanged; rows with null id stay."""
    (held,) = fresh(docs.columns, "held_id")
    hits = contamination(docs.select("doc_id", "text"), items, width, num, den).select(F.col("doc_id").alias(held)).distinct()
    return docs.join(hits, F.col("doc_id").cast("long") == column(held), "left_anti")
