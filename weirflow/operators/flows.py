"""Aggregation of flow records, and their enrichment by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators.lpm import PrefixTable

#: The full key of a flow; the CRC-64 key covers only half of each address.
FLOW_KEY = ["ip_version", "protocol", "src_ip6", "dst_ip6", "src_ip4", "dst_ip4", "src_port", "dst_port", "vlan_id", "tunnel_type", "outer_src_ip4", "outer_dst_ip4"]


def aggregate_flows(records: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row for each flow: first and last time, octets, packets and all TCP flags seen.

    Every aggregate is partial, so a flow with a third of all packets is one row of each task in the shuffle.
    """
    key = [k for k in (key or FLOW_KEY) if k in records.columns]
    return records.groupBy(*key).agg(
        F.min("flow_start").alias("flow_start"),
        F.max("flow_end").alias("flow_end"),
        F.sum("octets").alias("octets"),
        F.sum("packets").alias("packets"),
        F.bit_or(F.coalesce(F.col("tcp_flags"), F.lit(0)).cast("int")).alias("tcp_flags"),
    )


def tunnel_mix(records: DataFrame) -> DataFrame:
    """Packets, octets and flows by kind of tunnel; null is plain IPv4."""
    return records.groupBy("tunnel_type").agg(F.sum("packets").alias("packets"), F.sum("octets").alias("octets"))


def traffic_by_prefix(probe: DataFrame, table: PrefixTable, column: str, strategy: str = "auto") -> DataFrame:
    """Rows by label of the longest prefix of an IPv4 number; null where none covers it."""
    return table.lookup_number(probe, column, strategy).groupBy(F.col("value").alias("label")).agg(F.count("*").alias("n"))


def label_ends(records: DataFrame, table: PrefixTable, src: str, dst: str, strategy: str = "auto") -> DataFrame:
    """Records with src_label and dst_label, the longest prefixes of two IPv4 numbers."""
    out = table.lookup_number(records, src, strategy).withColumnRenamed("value", "src_label").drop("matched")
    return table.lookup_number(out, dst, strategy).withColumnRenamed("value", "dst_label").drop("matched")


def packet_rate(records: DataFrame, seconds: int) -> DataFrame:
    """Packets and octets a second in consecutive intervals."""
    return records.groupBy(F.window("flow_start", f"{seconds} seconds").alias("w")).agg(
        (F.sum("packets") / seconds).alias("packets_per_s"), (F.sum("octets") / seconds).alias("octets_per_s")
    )
