"""Packets to flow records: tunnel detection, inner IPv6 parse and flow keys, as column expressions.

``packets`` has packet_id, ts, caplen and data (a whole Ethernet frame). Each stage
adds named offset columns; nothing is shuffled and nothing but the CRC-64 key runs
in Python, over Arrow batches and only where a key is asked for.

All guards are strict: a field whose bytes weren't all captured is null, and a
header with a null field isn't recognised. Frames that are no tunnel and no native
IPv6 fall back to a plain IPv4 record that starts clean; other frames give no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import crc64
from weirflow.functions.packet_bytes import captured, hex_at, holds, number_at

VLAN, IPV4, IPV6 = 0x8100, 0x0800, 0x86DD
UDP, IPV6_IN_IPV4 = 17, 41
AYIYA_PORT, TEREDO_PORT = 5072, 3544
#: Seconds that an AYIYA packet's clock may differ from the capture's.
CLOCK_SKEW = 120
#: 192.88.99.1, the anycast address of 6to4 relays.
RELAY = 3227017985
NATIVE, TEREDO, ISATAP, SIX_TO_FOUR, AYIYA, OTHER_41 = range(1, 7)
_PORTS = (6, 17, 132, 33)
_ICMP = (1, 58)
_DATA = "_data"


def with_ethernet(packets: DataFrame) -> DataFrame:
    """Adds _data, ethertype, vlan_id (0 if untagged) and _l3, the network header's offset; one VLAN tag is skipped."""
    out = packets.withColumn("_data", captured(F.col("data"), F.col("caplen") if "caplen" in packets.columns else None))
    outer = number_at(_DATA, 12, 2)
    tagged = outer == VLAN
    return out.select(
        "*",
        F.when(tagged, number_at(_DATA, 16, 2)).otherwise(outer).alias("ethertype"),
        F.when(tagged, number_at(_DATA, 14, 2).bitwiseAND(F.lit(0x0FFF))).otherwise(F.lit(0)).cast("int").alias("vlan_id"),
        F.when(tagged, 18).otherwise(14).alias("_l3"),
    )


def with_ipv4(frames: DataFrame) -> DataFrame:
    """Adds the outer IPv4 header's protocol, addresses, total length and _l4; null where it isn't IPv4."""
    at = F.when(F.col("ethertype") == IPV4, F.col("_l3"))
    return frames.select(
        "*",
        number_at(_DATA, at + 9, 1).alias("_proto4"),
        number_at(_DATA, at + 2, 2).alias("_total4"),
        number_at(_DATA, at + 12, 4).alias("_src4"),
        number_at(_DATA, at + 16, 4).alias("_dst4"),
        (at + 4 * number_at(_DATA, at, 1).bitwiseAND(F.lit(15))).cast("int").alias("_l4"),
    )


def with_udp(frames: DataFrame) -> DataFrame:
    """Adds the outer UDP ports, the payload's length and its offset; null where it isn't UDP over IPv4."""
    at = F.when(F.col("_proto4") == UDP, F.col("_l4"))
    return frames.select(
        "*", number_at(_DATA, at, 2).alias("_sport4"), number_at(_DATA, at + 2, 2).alias("_dport4"), (number_at(_DATA, at + 4, 2) - 8).alias("_udp_len"), (at + 8).alias("_payload")
    )


def with_tunnel_offsets(frames: DataFrame) -> DataFrame:
    """Adds _inner, where an IPv6 header may begin, _skipped (of Teredo), and _kind: ayiya, teredo, p41, native or null."""
    ayiya = (F.col("_sport4") == AYIYA_PORT) | (F.col("_dport4") == AYIYA_PORT)
    p = F.when(ayiya, F.col("_payload"))
    sizes = number_at(_DATA, p, 1), number_at(_DATA, p + 1, 1)
    identity = F.pow(F.lit(2), F.shiftright(sizes[0], 4)).cast("int")
    out = frames.select("*", F.coalesce(ayiya, F.lit(False)).alias("_ayiya"), number_at(_DATA, p + 4, 4).alias("_epoch"), (p + 8 + identity + 4 * F.shiftright(sizes[1], 4)).cast("int").alias("_ayiya_at"))
    q = F.when(~F.col("_ayiya"), F.col("_payload"))
    auth = number_at(_DATA, q, 2) == 1
    skipped = F.when(auth, 13 + number_at(_DATA, q + 2, 1) + number_at(_DATA, q + 3, 1)).otherwise(F.when(q.isNotNull(), 0))
    out = out.select("*", skipped.cast("int").alias("_auth"))
    origin = number_at(_DATA, q + F.col("_auth"), 2) == 0
    out = out.select("*", (F.col("_auth") + F.when(origin, 8).otherwise(0)).alias("_skipped"))
    kind = (
        F.when(F.col("_ayiya"), "ayiya").when(F.col("_sport4").isNotNull(), "teredo").when(F.col("_proto4") == IPV6_IN_IPV4, "p41").when(F.col("ethertype") == IPV6, "native")
    )
    inner = F.when(F.col("_ayiya"), F.col("_ayiya_at")).when(F.col("_sport4").isNotNull(), F.col("_payload") + F.col("_skipped"))
    inner = inner.when(F.col("_proto4") == IPV6_IN_IPV4, F.col("_l4")).when(F.col("ethertype") == IPV6, F.col("_l3"))
    return out.select("*", kind.alias("_kind"), inner.cast("int").alias("_inner"))


def with_ipv6(frames: DataFrame, at: str = "_inner") -> DataFrame:
    """Adds what an IPv6 header at offset ``at`` says: version, payload length, addresses, protocol and _up, the upper header.

    A hop-by-hop header is skipped if it comes first and was captured whole, then all
    consecutive fragment headers; other extension headers count as the protocol.
    """
    o = F.col(at)
    out = frames.select(
        "*",
        F.shiftright(number_at(_DATA, o, 1), 4).cast("int").alias("_version"),
        number_at(_DATA, o + 4, 2).alias("_plen"),
        number_at(_DATA, o + 6, 1).alias("_next"),
        hex_at(_DATA, o + 8, 16).alias("_src6"),
        hex_at(_DATA, o + 24, 16).alias("_dst6"),
        F.when(holds(_DATA, o, 40), o + 40).alias("_up0"),
    )
    hop = F.col("_next") == 0
    out = out.withColumn("_hop", F.when(hop, 8 + 8 * number_at(_DATA, F.col("_up0") + 1, 1)).otherwise(0))
    out = out.select(
        "*",
        F.when(hop, number_at(_DATA, F.col("_up0"), 1)).otherwise(F.col("_next")).alias("_next1"),
        F.when(holds(_DATA, F.col("_up0"), F.col("_hop")), F.col("_up0") + F.col("_hop")).cast("int").alias("_up1"),
    )
    state = "struct<next:bigint,up:int>"
    start = F.struct(F.col("_next1").alias("next"), F.col("_up1").alias("up")).cast(state)

    def skip(s: Column, _: Column) -> Column:
        fragment = F.struct(F.when(holds(_DATA, s["up"], 8), number_at(_DATA, s["up"], 1)).alias("next"), (s["up"] + 8).alias("up")).cast(state)
        return F.when(s["next"] == 44, fragment).otherwise(s)

    most = F.greatest(F.floor((F.octet_length(_DATA) - F.col("_up1")) / 8) + 1, F.lit(1)).cast("int")
    skipped = F.aggregate(F.array_repeat(F.lit(0), most), start, skip)
    out = out.withColumn("_after", F.when(F.col("_next1") == 44, skipped).otherwise(start))
    return out.select("*", F.col("_after.next").alias("_protocol"), F.col("_after.up").alias("_up")).drop("_after", "_next1", "_up1", "_up0", "_next", "_hop")


def with_upper(frames: DataFrame, protocol: str = "_protocol", at: str = "_up") -> DataFrame:
    """Adds ports, TCP flags, ICMP type and code, and _whole: that the upper header's fields were all captured."""
    proto, up = F.col(protocol), F.col(at)
    has_ports, is_icmp = proto.isin(*_PORTS), proto.isin(*_ICMP)
    sport, dport = number_at(_DATA, up, 2), number_at(_DATA, up + 2, 2)
    flags = F.when(proto == 6, number_at(_DATA, up + 13, 1)).when(has_ports, 0)
    icmp = number_at(_DATA, up, 1) * 256 + number_at(_DATA, up + 1, 1)
    whole = F.when(has_ports, sport.isNotNull() & dport.isNotNull() & flags.isNotNull()).when(is_icmp, icmp.isNotNull()).otherwise(proto.isNotNull() & up.isNotNull())
    return frames.select(
        "*",
        F.when(has_ports, sport).when(is_icmp, 0).cast("int").alias("_sport"),
        F.when(has_ports, dport).when(is_icmp, 0).cast("int").alias("_dport"),
        flags.cast("smallint").alias("_flags"),
        F.when(is_icmp, icmp).cast("int").alias("_icmp"),
        F.coalesce(whole, F.lit(False)).alias("_whole"),
    )


def tunnel_class(src6: Column, dst6: Column, outer_src: Column, outer_dst: Column) -> Column:
    """The kind of IPv6 in IPv4 by its inner addresses (hex) and outer ones; the order decides."""
    six_to_four = lambda ip: F.substring(ip, 1, 4) == "2002"
    isatap = lambda ip: F.substring(ip, 21, 4) == "5EFE"
    return (
        F.when(six_to_four(src6), SIX_TO_FOUR).when(isatap(src6), ISATAP).when(six_to_four(dst6), SIX_TO_FOUR).when(isatap(dst6), ISATAP)
        .when((outer_src == RELAY) | (outer_dst == RELAY), SIX_TO_FOUR).otherwise(OTHER_41)
    )


def teredo_accepts(version: Column, udp_len: Column, skipped: Column, plen: Column, sport: Column, dport: Column, src6: Column, dst6: Column) -> Column:
    """Whether a UDP payload is Teredo: an IPv6 header of just the payload's length, and a Teredo port or address."""
    by_port = (sport == TEREDO_PORT) | (dport == TEREDO_PORT)
    by_address = (F.substring(src6, 1, 8) == "20010000") | (F.substring(dst6, 1, 8) == "20010000")
    return F.coalesce((version == 6) & (udp_len - skipped == plen + 40) & (by_port | by_address), F.lit(False))


def ayiya_accepts(epoch: Column, seconds: Column) -> Column:
    """Whether an AYIYA header's clock is within CLOCK_SKEW of the capture's."""
    return F.coalesce(F.abs(epoch - seconds) <= CLOCK_SKEW, F.lit(False))


def decode(packets: DataFrame, with_key: bool = False) -> DataFrame:
    """A flow record for each packet that gives one: packet_id and the columns of the record.

    tunnel_type (also output_interface) is null for plain IPv4. outer_src_ip4 and
    outer_dst_ip4 are 0 without an envelope. Times are cut to milliseconds. With
    ``with_key``, flow_id is the CRC-64 key of IPv6 records.
    """
    frames = with_upper(with_ipv6(with_tunnel_offsets(with_udp(with_ipv4(with_ethernet(packets))))))
    seconds = F.unix_seconds("ts")
    parsed = F.col("_whole") & F.col("_dst6").isNotNull()
    teredo = teredo_accepts(*[F.col(c) for c in ("_version", "_udp_len", "_skipped", "_plen", "_sport4", "_dport4", "_src6", "_dst6")])
    kind = (
        F.when((F.col("_kind") == "ayiya") & parsed & ayiya_accepts(F.col("_epoch"), seconds), AYIYA)
        .when((F.col("_kind") == "teredo") & parsed & teredo, TEREDO)
        .when((F.col("_kind") == "p41") & parsed, tunnel_class(F.col("_src6"), F.col("_dst6"), F.col("_src4"), F.col("_dst4")))
        .when((F.col("_kind") == "native") & parsed, NATIVE)
    )
    frames = frames.withColumn("tunnel_type", kind.cast("int"))
    six = F.col("tunnel_type").isNotNull()
    enveloped = F.col("tunnel_type") > NATIVE
    # Plain IPv4: the upper header again, from the outer one.
    plain = with_upper(
        frames.select("*", *[F.col(f"_{c}").alias(f"six_{c}") for c in ("sport", "dport", "flags", "icmp")]).drop("_sport", "_dport", "_flags", "_icmp", "_whole"), "_proto4", "_l4"
    )
    either = lambda a, b: F.when(six, a).otherwise(b)
    time = F.timestamp_millis(F.unix_millis("ts"))
    record = F.struct(
        "packet_id",
        time.alias("flow_start"),
        time.alias("flow_end"),
        F.lit(0).alias("input_interface"),
        F.col("tunnel_type").alias("output_interface"),
        "tunnel_type",
        either(F.col("_plen") + 40, F.col("_total4")).alias("octets"),
        F.lit(1).cast("bigint").alias("packets"),
        either(F.lit(6), F.lit(4)).alias("ip_version"),
        either(F.col("_protocol"), F.col("_proto4")).cast("smallint").alias("protocol"),
        F.when(six, F.unhex("_src6")).alias("src_ip6"),
        F.when(six, F.unhex("_dst6")).alias("dst_ip6"),
        F.when(~six, F.col("_src4")).alias("src_ip4"),
        F.when(~six, F.col("_dst4")).alias("dst_ip4"),
        either(F.col("six_sport"), F.col("_sport")).alias("src_port"),
        either(F.col("six_dport"), F.col("_dport")).alias("dst_port"),
        either(F.col("six_flags"), F.col("_flags")).alias("tcp_flags"),
        either(F.col("six_icmp"), F.col("_icmp")).alias("icmp_type_code"),
        F.when(F.coalesce(enveloped, F.lit(False)), F.col("_src4")).otherwise(0).alias("outer_src_ip4"),
        F.when(F.coalesce(enveloped, F.lit(False)), F.col("_dst4")).otherwise(0).alias("outer_dst_ip4"),
        "vlan_id",
        (six | F.col("_dst4").isNotNull()).alias("_found"),
    )
    # A generator drops packets without a record. A filter would be pushed down
    # through all stages, with every stage's expressions written out in it.
    out = plain.select(F.inline(F.filter(F.array(record), lambda r: r["_found"]))).drop("_found")
    out = out.withColumns(
        {
            "has_ipv6": F.col("ip_version") == 6,
            "has_ports": F.coalesce(F.col("protocol").isin(*_PORTS), F.lit(False)),
            "has_tcp": F.coalesce(F.col("protocol") == 6, F.lit(False)),
            "has_icmp": F.coalesce(F.col("protocol").isin(*_ICMP), F.lit(False)),
            "has_vlan": F.col("vlan_id") > 0,
        }
    )
    if with_key:
        out = out.withColumn("flow_id", crc64.flow_id(*[F.col(c) for c in ("src_ip6", "dst_ip6", "protocol", "src_port", "dst_port")]))
    return out


def sample(packets: DataFrame, one_in: int) -> DataFrame:
    """Every ``one_in``-th packet by its id: the same ones each time."""
    return packets.filter(F.pmod("packet_id", F.lit(one_in)) == 0)


_COMMON = "input_interface,output_interface,flow_start,flow_end,octets,packets,octets_out,packets_out,ip_version,protocol"
_ENDS = {6: "src_ip6,dst_ip6", 4: "src_ip4,dst_ip4"}
_UPPER = {"tcp": "src_port,dst_port,tcp_flags", "udp": "src_port,dst_port", "icmp": "icmp_type_code", "other": ""}
_ORDER = {6: ("tcp", "udp", "icmp", "other"), 4: ("udp", "tcp", "icmp", "other")}


def templates() -> dict[int, list[str]]:
    """The columns of each of the 16 export templates, by IP version, upper protocol and VLAN, numbered from 1."""
    out: dict[int, list[str]] = {}
    for version in (6, 4):
        for upper in _ORDER[version]:
            for vlan in ("", "vlan_id"):
                envelope = "outer_src_ip4,outer_dst_ip4" if version == 6 or upper == "other" else ""
                parts = [_COMMON, _ENDS[version], _UPPER[upper]] + ([vlan, envelope] if version == 6 else [envelope, vlan])
                out[len(out) + 1] = ",".join(p for p in parts if p).split(",")
    return out


def template_id(ip_version: Column, protocol: Column, vlan_id: Column) -> Column:
    """The number of the template that exports a record."""
    order = {v: {p: i for i, p in enumerate(names)} for v, names in _ORDER.items()}
    kind = lambda v: F.when(protocol == 6, order[v]["tcp"]).when(protocol == 17, order[v]["udp"]).when(protocol.isin(*_ICMP), order[v]["icmp"]).otherwise(order[v]["other"])
    vlan = F.when(vlan_id > 0, 1).otherwise(0)
    return F.when(ip_version == 6, 1 + 2 * kind(6) + vlan).otherwise(9 + 2 * kind(4) + vlan)


def _routed(records: DataFrame) -> DataFrame:
    """The records with bytes and packets out, which equal those in, and the number of their template."""
    return records.withColumns({"octets_out": F.col("octets"), "packets_out": F.col("packets"), "template_id": template_id(F.col("ip_version"), F.col("protocol"), F.col("vlan_id"))})


def export(records: DataFrame) -> dict[int, DataFrame]:
    """The records of each template, with that template's columns. Each is a query of its own: to write all, write_export() decodes once."""
    routed = _routed(records)
    return {k: routed.filter(F.col("template_id") == k).select(columns) for k, columns in templates().items()}


def write_export(records: DataFrame, path: str) -> None:
    """Decodes and routes the records once, into a folder of Parquet files for each template; read one with read_export()."""
    every = dict.fromkeys(c for columns in templates().values() for c in columns)
    routed = _routed(records).select("template_id", *every)
    routed.write.partitionBy("template_id").parquet(path)


def read_export(spark: SparkSession, path: str, template: int) -> DataFrame:
    """The records of one template, with that template's columns; only its folder is read."""
    return spark.read.parquet(path).filter(F.col("template_id") == template).select(templates()[template])


def hex_dump(packets: DataFrame) -> DataFrame:
    """packet_id and the captured bytes as spaced hex, for debugging."""
    data = captured(F.col("data"), F.col("caplen") if "caplen" in packets.columns else None)
    return packets.select("packet_id", F.trim(F.regexp_replace(F.hex(data), "(..)", "$1 ")).alias("bytes"))
