import datetime

import pytest
from frames import ayiya, ethernet, icmp, ip4, ip6, tcp, udp
from pyspark.sql import functions as F

from weirflow.functions.crc64 import crc64_bytes
from weirflow.operators import decode, flows

NOW = 1_700_000_000
INNER = ip6(6, tcp(10, 20))
AUTH = bytes([0, 1, 2, 3]) + bytes(14)
CASES = {
    "native tcp": (ethernet(0x86DD, INNER), (1, 6, 10, 20, 0)),
    "native udp": (ethernet(0x86DD, ip6(17, udp(1, 2, b""))), (1, 17, 1, 2, 0)),
    "native icmp": (ethernet(0x86DD, ip6(58, icmp(128, 3))), (1, 58, 0, 0, 0)),
    "native sctp": (ethernet(0x86DD, ip6(132, udp(7, 8, b""))), (1, 132, 7, 8, 0)),
    "native other": (ethernet(0x86DD, ip6(43, b"")), (1, 43, None, None, 0)),
    "vlan": (ethernet(0x86DD, INNER, 0x2064), (1, 6, 10, 20, 100)),
    "teredo by port": (ethernet(0x800, ip4(17, udp(3544, 99, INNER))), (2, 6, 10, 20, 0)),
    "teredo by address": (ethernet(0x800, ip4(17, udp(98, 99, ip6(6, tcp(1, 2), src="2001:0:1::1")))), (2, 6, 1, 2, 0)),
    "teredo auth": (ethernet(0x800, ip4(17, udp(3544, 99, AUTH + INNER))), (2, 6, 10, 20, 0)),
    "teredo origin": (ethernet(0x800, ip4(17, udp(3544, 99, bytes(8) + INNER))), (2, 6, 10, 20, 0)),
    "teredo auth and origin": (ethernet(0x800, ip4(17, udp(3544, 99, AUTH + bytes(8) + INNER))), (2, 6, 10, 20, 0)),
    "teredo of wrong length": (ethernet(0x800, ip4(17, udp(3544, 99, ip6(6, tcp(1, 2), plen=21)))), (None, 17, 3544, 99, 0)),
    "teredo elsewhere": (ethernet(0x800, ip4(17, udp(98, 99, INNER))), (None, 17, 98, 99, 0)),
    "isatap source": (ethernet(0x800, ip4(41, ip6(6, tcp(1, 2), src="2a00::5efe:1:2"))), (3, 6, 1, 2, 0)),
    "isatap target": (ethernet(0x800, ip4(41, ip6(6, tcp(1, 2), dst="2a00::5efe:1:2"))), (3, 6, 1, 2, 0)),
    "6to4 source": (ethernet(0x800, ip4(41, ip6(6, tcp(1, 2), src="2002::1"))), (4, 6, 1, 2, 0)),
    "6to4 target": (ethernet(0x800, ip4(41, ip6(6, tcp(1, 2), dst="2002::1"))), (4, 6, 1, 2, 0)),
    "6to4 relay": (ethernet(0x800, ip4(41, ip6(6, tcp(1, 2)), dst="192.88.99.1")), (4, 6, 1, 2, 0)),
    "isatap before 6to4": (ethernet(0x800, ip4(41, ip6(6, tcp(1, 2), src="2a00::5efe:1:2", dst="2002::1"))), (3, 6, 1, 2, 0)),
    "ayiya": (ethernet(0x800, ip4(17, udp(5072, 9, ayiya(120, NOW) + INNER))), (5, 6, 10, 20, 0)),
    "ayiya of another time": (ethernet(0x800, ip4(17, udp(5072, 9, ayiya(121, NOW) + INNER))), (None, 17, 5072, 9, 0)),
    "ayiya port is never teredo": (ethernet(0x800, ip4(17, udp(5072, 3544, INNER))), (None, 17, 5072, 3544, 0)),
    "other in protocol 41": (ethernet(0x800, ip4(41, INNER, ihl=6)), (6, 6, 10, 20, 0)),
    "hop-by-hop": (ethernet(0x86DD, ip6(0, bytes([6, 1]) + bytes(14) + tcp(3, 4))), (1, 6, 3, 4, 0)),
    "two fragments": (ethernet(0x86DD, ip6(44, bytes([44]) + bytes(7) + bytes([17]) + bytes(7) + udp(5, 6, b""))), (1, 17, 5, 6, 0)),
    "hop-by-hop and fragment": (ethernet(0x86DD, ip6(0, bytes([44, 0]) + bytes(6) + bytes([6]) + bytes(7) + tcp(7, 8))), (1, 6, 7, 8, 0)),
    "hop-by-hop before no next header": (ethernet(0x86DD, ip6(0, bytes([59, 1]) + bytes(14))), (1, 59, None, None, 0)),
    "cut hop-by-hop": (ethernet(0x86DD, ip6(0, bytes([59, 1]) + bytes(13))), None),
    "plain": (ethernet(0x800, ip4(6, tcp(1, 2))), (None, 6, 1, 2, 0)),
    "arp": (ethernet(0x806, bytes(30)), None),
    "empty": (b"", None),
}


def packets(spark, frames):
    ts = datetime.datetime.fromtimestamp(NOW, datetime.timezone.utc)
    rows = [(i, ts, len(f), f) for i, f in enumerate(frames)]
    return spark.createDataFrame(rows, "packet_id long, ts timestamp, caplen int, data binary")


def test_every_kind(spark):
    rows = {r.packet_id: r for r in decode.decode(packets(spark, [f for f, _ in CASES.values()]), with_key=True).collect()}
    for i, (name, (_, expected)) in enumerate(CASES.items()):
        r = rows.get(i)
        assert (r and (r.tunnel_type, r.protocol, r.src_port, r.dst_port, r.vlan_id)) == expected, name
    first, relay, plain = rows[0], rows[list(CASES).index("6to4 relay")], rows[list(CASES).index("plain")]
    assert (first.octets, first.packets, first.tcp_flags, first.outer_src_ip4) == (60, 1, 0x12, 0)
    assert (relay.outer_src_ip4, relay.outer_dst_ip4) == (0x01020304, decode.RELAY)
    assert (plain.ip_version, plain.octets, plain.src_ip4, plain.flow_id) == (4, 40, 0x01020304, None)
    icmp_row = rows[list(CASES).index("native icmp")]
    assert (icmp_row.icmp_type_code, icmp_row.tcp_flags) == (128 * 256 + 3, None)
    low = bytes([1]) + bytes(7) + bytes([2]) + bytes(7) + bytes([6, 10, 0, 20, 0])
    assert first.flow_id % (1 << 64) == int(crc64_bytes([low])[0])


@pytest.mark.parametrize("name", ["native tcp", "isatap source", "teredo auth and origin", "ayiya", "hop-by-hop and fragment"])
def test_every_truncation_gives_a_clean_fallback_or_nothing(spark, name):
    whole, expected = CASES[name]
    rows = {r.packet_id: r for r in decode.decode(packets(spark, [whole[:n] for n in range(len(whole) + 1)])).collect()}
    # TCP is complete with its flags, six bytes before its end.
    for n in range(len(whole) + 1):
        if n in rows and rows[n].tunnel_type is not None:
            assert n >= len(whole) - 6 and (rows[n].tunnel_type, rows[n].protocol) == expected[:2]
        elif n in rows:
            assert whole[12:14] == b"\x08\x00" and n >= 34 and rows[n].src_ip6 is None
    assert rows[len(whole)].tunnel_type == expected[0] and rows[len(whole) - 6].tunnel_type is not None or name.startswith("teredo")


def test_captured_length_hides_bytes(spark):
    cut = packets(spark, [CASES["native tcp"][0]]).withColumn("caplen", F.lit(60))
    assert decode.decode(cut).count() == 0


def test_crc_check_value():
    assert int(crc64_bytes([b"123456789"])[0]) == 0x62EC59E3F1A4F00A
    assert [int(x) for x in crc64_bytes([b"", b"123456789", b"1"])][1] == 0x62EC59E3F1A4F00A


def test_templates_route_every_record_once(spark, tmp_path):
    assert len(decode.templates()) == 16
    assert "vlan_id" in decode.templates()[2] and "outer_src_ip4" in decode.templates()[1] and "tcp_flags" in decode.templates()[11]
    records = decode.decode(packets(spark, [f for f, _ in CASES.values()]))
    parts = decode.export(records)
    decode.write_export(records, str(tmp_path / "export"))
    for k, part in parts.items():
        own = decode.read_export(spark, str(tmp_path / "export"), k)
        assert own.columns == part.columns and sorted(map(repr, own.collect())) == sorted(map(repr, part.collect()))
    assert sum(p.count() for p in parts.values()) == records.count()
    assert parts[2].collect()[0].vlan_id == 100


def test_flows_dump_and_sample(spark):
    frames = packets(spark, [CASES["native tcp"][0]] * 3 + [CASES["plain"][0]])
    found = {r.ip_version: r for r in flows.aggregate_flows(decode.decode(frames)).collect()}
    assert (found[6].packets, found[6].octets, found[6].tcp_flags) == (3, 180, 0x12) and found[4].packets == 1
    assert decode.hex_dump(frames).orderBy("packet_id").first().bytes.startswith("00 00")
    assert [r.packet_id for r in decode.sample(frames, 2).orderBy("packet_id").collect()] == [0, 2]
    assert {r.tunnel_type: r.packets for r in flows.tunnel_mix(decode.decode(frames)).collect()} == {1: 3, None: 1}
