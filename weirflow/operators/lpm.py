"""Longest-prefix match: a table of prefixes, and joins that find each address's longest covering one.

Semantics: families never match each other; host bits of a prefix are ignored; the
first insertion (smallest seq) of equal prefixes wins; a stored null value is still
a match; ``/0`` matches its whole family; a malformed address matches nothing.
Every probe row gives exactly one result row.

Three plans give the same results. A table of at most BROADCAST_ROWS prefixes and
BROADCAST_BYTES bytes is parsed, deduplicated and fetched once, for all lookups:

- ``chain``: a broadcast hash join for each length present, the longest match taken
  row by row. Nothing of the probe moves. For few lengths.
- ``segments``: the table is flattened into disjoint ranges, broadcast as sorted
  arrays and searched in Arrow batches. Nothing of the probe moves, and the time
  doesn't depend on the number of lengths.

Larger tables take the third:

- ``explode``: distinct addresses are joined with the table by (length, masked
  address), and the result is joined back; an address with a third of all rows is one
  row of the inner join. Prefixes of up to SHORT bits, at most 131,072 of a family, are
  few keys that all addresses share, so these are broadcast as segments instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.functions import addresses as A

#: Prefixes and bytes that are broadcast at most, and lengths that are chained at most.
BROADCAST_ROWS, BROADCAST_BYTES, CHAIN_LENGTHS = 2_000_000, 256 << 20, 12
#: Bits of the prefixes that ``explode`` broadcasts, at most.
SHORT = 16
#: Bytes of a node of the original's trie (two links, a value and a flag on a 64-bit host), a fixed value.
NODE_BYTES = 32


def normalise(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of seq, prefix, value: accepted rows have family, plen, hi, lo, too."""
    parsed = prefixes.withColumn("p", A.prefix(F.col("prefix")))
    good = parsed.filter("p is not null").select("seq", "prefix", "value", "p.family", "p.plen", "p.hi", "p.lo")
    return good, parsed.filter("p is null").drop("p")


def first_wins(accepted: DataFrame) -> DataFrame:
    """The first inserted value of each prefix; stored nulls stay. One partially aggregated shuffle."""
    first = accepted.groupBy("family", "plen", "hi", "lo").agg(F.min_by(F.struct("value"), "seq").alias("kept"), F.min("seq").alias("seq"))
    return first.select("seq", "family", "plen", "hi", "lo", F.col("kept.value").alias("value"))


@dataclass
class PrefixTable:
    """An immutable set of prefixes; every change gives a new table. The old method names are kept."""

    spark: SparkSession
    rows: DataFrame | None = None
    rejected: DataFrame | None = None

    @classmethod
    def new(cls, spark: SparkSession) -> PrefixTable:
        return cls(spark)

    @classmethod
    def of(cls, prefixes: DataFrame) -> PrefixTable:
        """A table of the columns seq, prefix and value."""
        return cls(prefixes.sparkSession).add(prefixes)

    def add(self, prefixes: DataFrame) -> PrefixTable:
        """With more prefixes; where they are known already, the smaller seq stays. They are visible at once."""
        good, bad = normalise(prefixes)
        good = good.drop("prefix")
        rows = good if self.rows is None else self.rows.unionByName(good)
        rejected = bad if self.rejected is None else self.rejected.unionByName(bad)
        return PrefixTable(self.spark, first_wins(rows), rejected)

    def rebuild(self) -> PrefixTable:
        """The table itself: nothing needs building."""
        return self

    def cache(self) -> PrefixTable:
        """Keeps the deduplicated rows for several lookups."""
        return self if self.rows is None else PrefixTable(self.spark, self.rows.cache(), self.rejected)

    @cached_property
    def small(self) -> pa.Table | None:
        """The deduplicated rows, if they are few enough to broadcast; fetched once."""
        held = self.rows.limit(BROADCAST_ROWS + 1).toArrow()
        return held.combine_chunks() if held.num_rows <= BROADCAST_ROWS and held.nbytes <= BROADCAST_BYTES else None

    def finish(self) -> PrefixTable:
        """Without contents; lookups then find nothing, and prefixes can be added again."""
        if self.rows is not None:
            self.rows.unpersist()
        return PrefixTable(self.spark)

    destroy = finish

    def lookup(self, probe: DataFrame, column: str, strategy: str = "auto") -> DataFrame:
        """``probe`` with matched and value for the address text in ``column``."""
        return self._found(probe, A.address(F.col(column)), strategy, A.ipv4_address(F.col(column)))

    def lookup_raw(self, probe: DataFrame, column: str, strategy: str = "auto") -> DataFrame:
        """The same for addresses of 4 or 16 bytes."""
        return self._found(probe, A.raw_address(F.col(column)), strategy)

    lookup_cache_raw = lookup_raw

    def lookup_number(self, probe: DataFrame, column: str, strategy: str = "auto") -> DataFrame:
        """The same for IPv4 addresses as BIGINT."""
        return self._found(probe, A.number_address(F.col(column)), strategy)

    def semi(self, probe: DataFrame, column: str, strategy: str = "auto") -> DataFrame:
        """The rows whose address some prefix covers."""
        return self.lookup(probe, column, strategy).filter("matched").drop("matched", "value")

    def anti(self, probe: DataFrame, column: str, strategy: str = "auto") -> DataFrame:
        """The rows whose address no prefix covers."""
        return self.lookup(probe, column, strategy).filter("not matched").drop("matched", "value")

    def _found(self, probe: DataFrame, address: Column, strategy: str, ipv4: Column | None = None) -> DataFrame:
        """The probe with its matches; ``ipv4`` is a cheaper form of ``address`` for tables of IPv4 alone."""
        if self.rows is None:
            return probe.withColumns({"matched": F.lit(False), "value": F.lit(None).cast("string")})
        held = None if strategy == "explode" else self.small
        if held is None:
            if strategy in ("chain", "segments"):
                raise ValueError(f"the table is too large to broadcast: use explode in place of {strategy}")
            lengths = [(r.family, r.plen) for r in self.rows.select("family", "plen").distinct().collect()]
        else:
            lengths = sorted(set(zip(held.column("family").to_pylist(), held.column("plen").to_pylist(), strict=True)))
        with_address = probe.withColumn("_a", address if ipv4 is None or any(f == 6 for f, _ in lengths) else ipv4)
        if held is None:
            return self._explode(with_address, lengths).drop("_a")
        plain = self.rows.schema["value"].dataType.typeName() == "string"
        if strategy == "chain" or strategy == "auto" and (len(lengths) <= CHAIN_LENGTHS or not plain):
            return self._chain(with_address, held, lengths).drop("_a")
        return self._segments(with_address, held).drop("_a")

    def _chain(self, probe: DataFrame, held: pa.Table, lengths: list[tuple[int, int]]) -> DataFrame:
        hits = []
        families, plens = held.column("family").to_numpy(), held.column("plen").to_numpy()
        for k, (family, plen) in enumerate(sorted(lengths, key=lambda x: (-x[1], x[0]))):
            hi, lo = A.masked(F.col("_a"), F.lit(plen))
            rows = held.filter(pa.array((families == family) & (plens == plen))).select(["hi", "lo", "value"])
            own = self.spark.createDataFrame(rows, "hi bigint, lo bigint, value " + self.rows.schema["value"].dataType.simpleString())
            own = F.broadcast(own.select(F.col("hi").alias(f"_h{k}"), F.col("lo").alias(f"_l{k}"), F.struct("value").alias(f"_v{k}")))
            on = (F.col("_a.family") == family) & (hi == F.col(f"_h{k}"))
            # A prefix of up to 64 bits has no bits in lo: one comparison less.
            probe = probe.join(own, on & (lo == F.col(f"_l{k}")) if plen > 64 else on, "left").drop(f"_h{k}", f"_l{k}")
            hits.append(f"_v{k}")
        best = F.coalesce(*[F.col(h) for h in hits]) if hits else F.lit(None).cast("struct<value:string>")
        return probe.withColumn("_best", best).drop(*hits).withColumns({"matched": F.col("_best").isNotNull(), "value": F.col("_best.value")}).drop("_best")

    def _explode(self, probe: DataFrame, lengths: list[tuple[int, int]]) -> DataFrame:
        long = [(f, p) for f, p in lengths if p > SHORT]
        of = {f: sorted(p for g, p in long if g == f) for f in (4, 6)}
        plens = F.when(F.col("_a.family") == 4, F.array(*map(F.lit, of[4])).cast("array<int>")).otherwise(F.array(*map(F.lit, of[6])).cast("array<int>"))
        wanted = probe.filter("_a is not null").select("_a").distinct().withColumn("plen", F.explode(plens))
        hi, lo = A.masked(F.col("_a"), F.col("plen"))
        wanted = wanted.select("_a", F.col("_a.family").alias("family"), "plen", hi.alias("hi"), lo.alias("lo"))
        met = wanted.join(self.rows.select("family", "plen", "hi", "lo", F.struct("value").alias("v")), ["family", "plen", "hi", "lo"])
        best = met.groupBy("_a").agg(F.max_by("v", "plen").alias("_best")).withColumnRenamed("_a", "_b")
        out = probe.join(best, F.col("_a") == F.col("_b"), "left").drop("_b")
        if len(long) < len(lengths):
            short = self.rows.filter(F.col("plen") <= SHORT).toArrow().combine_chunks()
            few = sorted(set(zip(short.column("family").to_pylist(), short.column("plen").to_pylist(), strict=True)))
            plain = self.rows.schema["value"].dataType.typeName() == "string"
            out = self._segments(out, short) if plain else self._chain(out, short, few)
            hit = F.when(F.col("_best").isNotNull(), F.col("_best")).when(F.col("matched"), F.struct("value"))
            out = out.withColumn("_best", hit).drop("matched", "value")
        return out.withColumns({"matched": F.col("_best").isNotNull(), "value": F.col("_best.value")}).drop("_best")

    def _segments(self, probe: DataFrame, held: pa.Table) -> DataFrame:
        table = flatten_prefixes(*(held.column(c).to_numpy() for c in ("family", "plen", "hi", "lo")))
        sent = self.spark.sparkContext.broadcast((table, held.column("value").cast(pa.string()).combine_chunks()))

        @F.arrow_udf("matched boolean, value string")
        def search(family: pa.Array, hi: pa.Array, lo: pa.Array) -> pa.Array:
            ranges, values = sent.value
            entry = search_segments(ranges, family.to_numpy(), hi.to_numpy(), lo.to_numpy())
            matched = entry >= 0
            return pa.StructArray.from_arrays([pa.array(matched), values.take(pa.array(entry, mask=~matched))], ["matched", "value"])

        # Nulls would turn the longs into floats on their way.
        found = search(*[F.coalesce(F.col(f"_a.{x}"), F.lit(0)) for x in ("family", "hi", "lo")])
        return probe.withColumn("_found", found).withColumns({"matched": F.col("_found.matched"), "value": F.col("_found.value")}).drop("_found")

    def info(self) -> DataFrame:
        """family, n_nodes, n_values and trie_bytes of a binary trie that holds the table: a node for each distinct leading part.

        Parts of up to SHORT bits are counted apart; below each of these, in the order of their bits, a prefix adds
        a node for each bit that it doesn't share with the one before it. So no prefix is copied for each of its bits.
        """
        if self.rows is None:
            return self.spark.createDataFrame([], "family int, n_nodes long, n_values long, trie_bytes long")
        head = F.shiftrightunsigned("hi", 64 - SHORT)
        heads = self.rows.select("family", F.least("plen", F.lit(SHORT)).alias("plen"), head.alias("head")).distinct()
        parts = heads.select("family", F.explode(F.sequence(F.lit(0), F.col("plen"))).alias("depth"), "head")
        parts = parts.select("family", "depth", F.expr(f"head div cast(pow(2, {SHORT} - depth) as bigint)").alias("bits")).distinct()
        shallow = parts.groupBy("family").agg(F.count("*").alias("n"))

        same = Window.partitionBy("family", "head").orderBy("x", "y", "plen")
        sign = F.lit(-(1 << 63))
        deep = self.rows.filter(F.col("plen") > SHORT).select("family", "plen", "hi", "lo", head.alias("head"), F.col("hi").bitwiseXOR(sign).alias("x"), F.col("lo").bitwiseXOR(sign).alias("y"))
        bits = lambda c: F.when(c == 0, 0).otherwise(F.length(F.bin(c)))
        above, below = F.col("hi").bitwiseXOR(F.lag("hi").over(same)), F.col("lo").bitwiseXOR(F.lag("lo").over(same))
        shared = F.when(above != 0, 64 - bits(above)).otherwise(128 - bits(below))
        shared = F.when(F.lag("plen").over(same).isNull(), SHORT).otherwise(F.least(shared, F.lag("plen").over(same), F.col("plen")))
        added = deep.select("family", (F.col("plen") - F.greatest(shared, F.lit(SHORT))).alias("n")).groupBy("family").agg(F.sum("n").alias("n"))
        nodes = shallow.unionByName(added).groupBy("family").agg(F.sum("n").alias("n_nodes"))
        values = self.rows.groupBy("family").agg(F.count("*").alias("n_values"))
        return nodes.join(values, "family").withColumn("trie_bytes", F.col("n_nodes") * NODE_BYTES)

    def dump(self) -> DataFrame:
        """prefix (canonical text with its length) and value of each entry."""
        if self.rows is None:
            return self.spark.createDataFrame([], "prefix string, value string")
        text = F.concat(A.address_text(F.struct("family", "hi", "lo")), F.lit("/"), F.col("plen").cast("string"))
        return self.rows.select(text.alias("prefix"), "value")


def flatten_prefixes(family: np.ndarray, plen: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> dict:
    """Disjoint ranges of each family: sorted starts as two unsigned arrays, and the entry that holds from each start on (-1: none).

    Ranges of one length never overlap, so entries are painted a length at a time, longer ones over shorter ones.
    """
    out = {}
    one = np.uint64(1)
    for own in (4, 6):
        rows = np.flatnonzero(family == own)
        p, high, low = plen[rows].astype(np.int64), hi[rows].astype(np.int64).view(np.uint64), lo[rows].astype(np.int64).view(np.uint64)
        wide = p <= 64
        step_high = np.where(wide & (p > 0), one << np.clip(64 - p, 0, 63).astype(np.uint64), np.uint64(0))
        end_low = np.where(wide, low, low + (one << np.clip(128 - p, 0, 63).astype(np.uint64)))
        carry = ~wide & (end_low == 0)
        end_high = high + step_high + carry
        last = (p == 0) | ((end_high == 0) & (wide | carry))  # ends with the address space
        every_high, every_low = np.concatenate([[np.uint64(0)], high, end_high]), np.concatenate([[np.uint64(0)], low, end_low])
        order = np.lexsort((every_low, every_high))
        a, b = every_high[order], every_low[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        start, end = place[1 : 1 + len(rows)], np.where(last, new.sum(), place[1 + len(rows) :])
        entry = np.full(new.sum(), -1, np.int64)
        for length in np.unique(p):
            at = np.flatnonzero(p == length)
            size = end[at] - start[at]
            cells = np.arange(size.sum()) + np.repeat(start[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            entry[cells] = np.repeat(rows[at], size)
        changes = np.append(True, entry[1:] != entry[:-1])
        out[own] = (a[new][changes], b[new][changes], entry[changes])
    return out


def search_segments(table: dict, family: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The entry of each address, -1 where there is none; family 0 is no address."""
    entry = np.full(len(family), -1, np.int64)
    for own in (4, 6):
        rows = np.flatnonzero(family == own)
        if not len(rows):
            continue
        high, low, held = table[own]
        h = hi[rows].astype(np.int64).view(np.uint64)
        at = np.searchsorted(high, h, "right") - 1
        if own == 6:
            # Among the starts with the same high half, the last one whose low half isn't above the address's.
            left = np.searchsorted(high, h, "left")
            low_own = lo[rows].astype(np.int64).view(np.uint64)
            a, b = left.copy(), at + 1
            while (live := a < b).any():
                mid = (a + b) // 2
                below = live & (low[np.minimum(mid, len(low) - 1)] <= low_own)
                a = np.where(below, mid + 1, a)
                b = np.where(live & ~below, mid, b)
            at = a - 1
        entry[rows] = held[at]
    return entry
