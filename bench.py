"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1). BENCH_CPUS: local cores (default 8).
Besides the catalogue, lpm_lookups_per_s is measured: PROBES lookups in a synthetic
table of 500,000 prefixes of 25 lengths, by form of the address; lpm_build_s has
what comes before a lookup (fetching the table once, and preparing each plan).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weirflow.functions import addresses as A
from weirflow.operators.lpm import PrefixTable
from weirflow.plans import catalogue

PREFIXES, PROBES = 500_000, 3_000_000


def prefix_table(spark: SparkSession) -> PrefixTable:
    """A table as large as a full routing table, lengths 8 to 32."""
    number = F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    text = F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
    rows = spark.range(PREFIXES).select(F.col("id").alias("seq"), F.concat(text, F.lit("/"), (8 + F.col("id") % 25).cast("string")).alias("prefix"), F.col("id").cast("string").alias("value"))
    return PrefixTable.of(rows)


def timed(frame) -> float:
    began = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("weirflow-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timed(catalogue.QUERIES["traffic_by_prefix"](spark, sf_dir))  # starts the engine
    found = {}
    for name, query in catalogue.QUERIES.items():
        began = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        found[name] = round(time.perf_counter() - began, 3)
    # Build (parse, deduplicate, fetch, flatten, send) and lookup apart; numbers, IPv4 texts, IPv6 raw.
    table, rates, build = prefix_table(spark), {}, {}
    probe = spark.range(PROBES).select(F.pmod(F.xxhash64(F.col("id") + 1), F.lit(1 << 32)).alias("ip"))
    six = spark.range(PROBES).select(F.unhex(F.concat(F.hex(F.lit(0x20010DB8)), F.lpad(F.hex(F.xxhash64(F.col("id") + 2)), 16, "0"), F.lit("0" * 8))).alias("raw"))
    texts = probe.select(A.ipv4_text(F.col("ip")).alias("addr"))
    began = time.perf_counter()
    assert table.small is not None
    build["fetch"] = round(time.perf_counter() - began, 3)
    for name, look in (
        ("segments", lambda: table.lookup_number(probe, "ip", "segments")), ("segments_text", lambda: table.lookup(texts, "addr", "segments")), ("segments_v6_raw", lambda: table.lookup_raw(six, "raw", "segments")),
    ):
        began = time.perf_counter()
        found_rows = look()
        build[name] = round(time.perf_counter() - began, 3)
        timed(found_rows.limit(1000))  # starts the workers
        rates[name] = round(PROBES / timed(found_rows))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "lpm_lookups_per_s": rates, "lpm_build_s": build, "lpm_prefixes": PREFIXES, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
