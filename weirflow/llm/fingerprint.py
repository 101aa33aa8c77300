"""Document fingerprints by locally consistent parsing with deterministic coin tossing.

A text's UTF-8 bytes are level 0. At each level, runs of an equal symbol become
one symbol; then deterministic coin tossing turns each symbol, by the lowest bit
in which it differs from its left neighbour, into a small label that differs from
the neighbours' labels. After four tosses labels are below 6, and a phrase begins
at each local maximum, so phrases have 2 to about 11 symbols. A phrase's name is a
hash of its symbols' names and is a symbol of the next level. Where a phrase
begins depends on a few symbols around it only, so equal substrings get equal
interior names at every level, whatever their offset.

A fingerprint holds the smallest names (a bottom-k sketch of the multiset) of three
sections: phrases of level 3 and above, of level 2 and of level 1. Likeness is the Jaccard estimate from the coarsest section in
which both texts have enough names. Null or empty texts have the empty
fingerprint, which is like itself only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import textkernel as tk
from weirflow.llm.scratch import small_batches

LEVELS = 8
#: Names kept of each section, coarsest first, and how many both texts need for it to decide.
KEPT, DECISIVE = (48, 24, 24), 8
#: Bytes a name of a section stands for at most on average; beyond that the text repeats itself so much that
#: the section, in which equal neighbours are one, says little, and is left empty.
LONGEST = (64, 24, 1 << 40)
#: Rows of a bucket of the order by id; at most MOST_BUCKETS bounds reach the driver (beyond 131 million rows, buckets
#: grow: they are sorted and streamed, so a task's memory doesn't).
BUCKET_ROWS, MOST_BUCKETS = 2_000, 65_536


def _toss_table(bits: int) -> np.ndarray:
    """label[left << bits | own]: twice the lowest differing bit's index, plus own's bit there."""
    own = np.arange(1 << bits)
    out = np.zeros((1 << bits, 1 << bits), np.uint8)
    for left in range(1 << bits):
        differ = own ^ left
        lowest = np.zeros_like(own)
        nonzero = differ > 0
        lowest[nonzero] = np.bitwise_count((differ[nonzero] & -differ[nonzero]) - 1)
        out[left] = 2 * lowest + (own >> lowest & 1)
    return out.ravel()


class Parser:
    """Parses batches of texts; holds the tables of one worker."""

    def __init__(self) -> None:
        self.byte_toss, self.tosses = _toss_table(8), [(7, _toss_table(7)), (4, _toss_table(4)), (3, _toss_table(3))]
        self.letters = tk.mix64(np.arange(256) + 1000)
        self.powers = tk.WordHasher()

    @staticmethod
    def _retoss(label: np.ndarray, first: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
        key = np.empty(len(label), np.uint16)
        key[1:] = label[:-1]
        key[first] = label[first] ^ 1
        key <<= bits
        key |= label
        return table[key]

    def _landmarks(self, symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a phrase begins at each symbol; neighbours inside a text differ. first: each text's first symbol."""
        if symbol.dtype == np.uint8:
            label = self._retoss(symbol, first, 8, self.byte_toss)
        else:
            differ = np.empty(len(symbol), np.uint64)
            differ[1:] = symbol[1:] ^ symbol[:-1]
            differ[first] = 1
            lowest = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
            label = 2 * lowest + (symbol >> lowest.astype(np.uint64) & np.uint64(1)).astype(np.uint8)
        for bits, table in self.tosses:
            label = self._retoss(label, first, bits, table)
        start = np.zeros(len(label), bool)
        start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        # A text's first symbol begins a phrase, its second and last never do: no phrase of one symbol at an end.
        start[first[1:] - 1] = False
        if len(start):
            start[-1] = False
        second = first + 1
        start[second[second < len(start)]] = False
        start[first] = True
        return start

    def levels(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(names, how many precede each text) of level 1, 2, ...; texts of one name stay as they are."""
        symbol, ahead = data, offsets
        for _ in range(LEVELS):
            held = np.flatnonzero(np.diff(ahead) > 0)
            if not len(held):
                return
            change = np.ones(len(symbol), bool)
            change[1:] = symbol[1:] != symbol[:-1]
            change[ahead[:-1][held]] = True
            at = np.flatnonzero(change)
            length = np.diff(np.append(at, len(symbol)))
            run = symbol[at]
            first = np.searchsorted(at, ahead[:-1][held])
            start = np.flatnonzero(self._landmarks(run, first))
            value = self.letters[run] if run.dtype == np.uint8 else run.copy()
            long = np.flatnonzero(length > 1)
            value[long] = tk.mix64(value[long] + length[long].astype(np.uint64))
            self.powers._grow(len(value) + 1)
            total = np.zeros(len(value) + 1, np.uint64)
            np.multiply(value, self.powers.ahead[: len(value)], out=total[1:])
            np.cumsum(total, out=total)
            end = np.append(start[1:], len(value))
            names = tk.mix64((total[end] - total[start]) * self.powers.back[start] + (end - start).astype(np.uint64))
            # A text that is one symbol keeps its name, so that equal phrases stay equal whatever surrounds them.
            if run.dtype != np.uint8:
                single = (end - start == 1) & (length[start] == 1)
                names[single] = run[start[single]]
            before = np.zeros(len(ahead), np.int64)
            before[:-1][held] = np.searchsorted(start, first)
            before[-1] = len(start)
            empty = np.flatnonzero(np.diff(ahead) == 0)
            if len(empty):
                filled = np.minimum.accumulate(np.where(np.append(np.diff(ahead) > 0, True), before, len(start))[::-1])[::-1]
                before = filled
            yield names, before
            symbol, ahead = names, before

    def sections(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        """For each text, the smallest names of its sections, coarsest first, as 32-bit values."""
        for _, data, offsets in self.powers.chunks(texts):
            levels = list(self.levels(data, offsets))
            for t in range(len(offsets) - 1):
                own = [names[before[t] : before[t + 1]] for names, before in levels]
                one = next((i for i, x in enumerate(own) if len(x) < 2), len(own))  # above it, nothing is new
                own = own[: one + 1]
                own += [np.zeros(0, np.uint64)] * (3 - len(own))
                parts = (np.concatenate(own[2:]), own[1], own[0])
                size = offsets[t + 1] - offsets[t]
                yield tuple(_smallest(p, k) if len(p) * most >= size else _smallest(p, 0) for p, k, most in zip(parts, KEPT, LONGEST, strict=True))


def _smallest(names: np.ndarray, k: int) -> np.ndarray:
    """The k smallest of the names as a multiset: the j-th occurrence of a name is a name of its own."""
    found = np.sort(names) if k else names[:0]
    if len(found) > 1:
        again = np.flatnonzero(found[1:] == found[:-1]) + 1
        if len(again):
            new = np.ones(len(found), bool)
            new[again] = False
            number = again - np.flatnonzero(new)[np.cumsum(new)[again] - 1]
            found[again] = tk.mix64(found[again] + number.astype(np.uint64))
        if len(found) > k:
            found = np.partition(found, k)[:k]
        found = np.sort(found)
    return (found >> np.uint64(32)).astype(np.uint32)


def written(sections: tuple[np.ndarray, ...]) -> str:
    """A fingerprint's text: the sections' values in hex, coarsest first, between dots; empty for the empty text."""
    return "" if not len(sections[-1]) else ".".join(s.astype(">u4").tobytes().hex() for s in sections)


def read(fingerprint: str) -> tuple[np.ndarray, ...]:
    parts = fingerprint.split(".") if fingerprint else [""] * len(KEPT)
    return tuple(np.frombuffer(bytes.fromhex(p), ">u4").astype(np.uint32) for p in parts)


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """The share of common names among the smallest of both, in the coarsest section where both have DECISIVE names."""
    if not len(a[-1]) or not len(b[-1]):
        return float(len(a[-1]) == len(b[-1]))
    for x, y, k in zip(a, b, KEPT, strict=True):
        if min(len(x), len(y)) >= DECISIVE or k is KEPT[-1] and x is a[-1]:
            union = np.union1d(x, y)[:k]
            return float((np.isin(union, x) & np.isin(union, y)).sum() / max(1, len(union)))
    return 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for batch in batches:
            ids, texts = batch.columns
            n = pa.array([len(x or "") for x in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, n, pa.array([written(s) for s in parser.sections(texts)], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, extra, doc_id, text: rows of a bucket by descending doc_id, then one that follows the bucket's last.

    The order is cyclic, null ids come last, ties go by text. Buckets are ranges of
    ids between approximate quantiles; only their bounds and largest ids (at most
    MOST_BUCKETS each) reach the driver. A text is shuffled once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")
    number = max(1, min(MOST_BUCKETS, docs.count() // BUCKET_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / number for i in range(1, number)] or [0.5], max(10_000, 10 * number))).first()[0] or []
    cuts = np.unique(np.array(cuts if number > 1 else [], np.int64))

    @F.pandas_udf("int")
    def bucket_of(ids):  # the largest ids are in bucket 0
        import pandas as pd

        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(cuts), np.int32)
        out[known] = len(cuts) - np.searchsorted(cuts, ids[known].astype("int64").to_numpy())
        return pd.Series(out)

    placed = docs.withColumn("bucket", bucket_of("doc_id"))
    firsts = placed.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).orderBy("bucket").collect()
    if not firsts:
        return placed.selectExpr("bucket", "1 as extra", "doc_id", "text")
    copies = [(firsts[i - 1].bucket, row.doc_id) for i, row in enumerate(firsts)]
    copies = spark.createDataFrame(copies, "bucket int, first_id long")
    extra = docs.join(F.broadcast(copies), F.col("doc_id").eqNullSafe(F.col("first_id"))).selectExpr("bucket", "1 as extra", "doc_id", "text")
    rows = placed.selectExpr("bucket", "0 as extra", "doc_id", "text").unionByName(extra)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "text")


def edit_robustness(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint against those of its edited text and of the next document.

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document by descending doc_id, cyclically.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        names = [x.split()[0] for x in schema.split(", ")]
        held: list[tuple] = []  # the last row, whose next one is in a later batch

        def compared(rows: list[tuple]) -> pa.RecordBatch:
            """A result for each row but the last and extra ones."""
            own = list(parser.sections(pa.array([r[3] for r in rows], pa.large_string())))
            pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            edited = []
            for i in pairs:
                text, after = rows[i][3], rows[i + 1][3]
                part = len(text) // 3
                edited.append(text[: len(text) - part] + after[:part])
            changed = list(parser.sections(pa.array(edited, pa.large_string())))
            columns = [
                pa.array([rows[i][2] for i in pairs], pa.int64()),
                pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array([written(own[i]) for i in pairs], pa.string()),
                pa.array([written(x) for x in changed], pa.string()),
                pa.array([likeness(own[i], x) for i, x in zip(pairs, changed, strict=True)], pa.float64()),
                pa.array([likeness(own[i], own[i + 1]) for i in pairs], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                rows = held + list(zip(*(part.column(k).to_pylist() for k in range(4)), strict=True))
                held = rows[-1:]
                yield compared(rows)

    return with_next(docs).mapInArrow(run, schema)
