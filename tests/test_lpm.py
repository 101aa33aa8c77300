import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from weirflow.functions import addresses as A
from weirflow.operators.lpm import PrefixTable

WITHOUT_DEFAULT = (
    "147.229.3.1 147.229.3.2/32 147.229.3.0/24 147.229.0.0/16 10.255.3.0/24 10.255.3.0/32 224.0.0.0/4 224.0.0.0/4 224.0.0.0/5 224.0.0.0/5 "
    "2001:67c:1220:f565::1234 2001:67c:1220:f565::1235/128 2001:67c:1220:f565::/64 2001:67c:1220::/32 2001:67c:1220:f565::/64 2001:67c:1220::/32 "
    "2001:67c:1220:c000::/52 2001:67c:1220:c000::/56 ff3a::/32 ff3a::/32"
).split()
WITH_DEFAULT = ["0.0.0.0/0", "::/0", *WITHOUT_DEFAULT]
ADDRESSES = (
    "147.229.3.0 147.229.3.1 147.229.3.2 147.229.3.3 147.229.3.254 147.229.4.0 147.228.255.255 147.229.255.255 147.230.0.1 10.255.3.0 0.0.0.0 255.255.255.255 "
    "2001:67c:1220::1 2001:67c:1220:f565::1234 2001:67c:1220:f565:: 2001:67c:1220:f565:FFFF:FFFF:FFFF:FFFF 2001:67c:1220:f566:: 2001:67c:2325:f566::1 "
    "2001:67b:FFFF:FFFF:FFFF:FFFF:FFFF:FFFF 2001:67d::1 2001::1 2001:67c:1220:c1b0:c57b:6ec4:6aee:4d7 2001:67c:1220:c0b0:c57b:6ec4:6aee:4d7 ::0.0.0.0 0001:: 240.0.0.1"
).split()
STRATEGIES = ["chain", "explode", "segments", "auto"]


def table_of(spark, prefixes):
    return PrefixTable.of(spark.createDataFrame([(i, p, v) for i, (p, v) in enumerate(prefixes)], "seq long, prefix string, value string"))


def found(table, spark, addresses, strategy="auto"):
    probe = spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "i long, addr string")
    rows = table.lookup(probe, "addr", strategy).collect()
    assert len(rows) == len(addresses)
    return [(r.matched, r.value) for r in sorted(rows, key=lambda r: r.i)]


def brute(prefixes, address):
    try:
        ip = ipaddress.ip_address(address)
    except (ValueError, TypeError):
        return False, None
    best = None
    for p, v in reversed(prefixes):  # so the first of equals is looked at last
        net = ipaddress.ip_network(p, strict=False)
        if net.version == ip.version and ip in net and (best is None or net.prefixlen >= best[0]):
            best = (net.prefixlen, v)
    return (True, best[1]) if best else (False, None)


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("prefixes", [WITH_DEFAULT, WITHOUT_DEFAULT])
def test_known_tables(spark, prefixes, strategy):
    pairs = [(p, p) for p in prefixes]
    assert found(table_of(spark, pairs), spark, ADDRESSES, strategy) == [brute(pairs, a) for a in ADDRESSES]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_first_insert_wins_and_a_stored_null_matches(spark, strategy):
    table = table_of(spark, [("10.0.0.0/8", "first"), ("10.9.9.9/8", "second"), ("10.1.0.0/16", None), ("10.1.2.0/24", "deep")])
    assert found(table, spark, ["10.5.5.5", "10.1.9.9", "10.1.2.3", "11.0.0.1"], strategy) == [(True, "first"), (True, None), (True, "deep"), (False, None)]
    later = table.add(spark.createDataFrame([(-1, "10.0.0.0/8", "earlier"), (9, "::/0", "six")], "seq long, prefix string, value string"))
    assert found(later, spark, ["10.5.5.5", "::1", "1.1.1.1"], strategy) == [(True, "earlier"), (True, "six"), (False, None)]


def test_malformed_prefixes_are_rejected_and_addresses_match_nothing(spark):
    table = table_of(spark, [("0.0.0.0/0", "v4"), ("1.2.3.4/", "a"), ("1.2.3.4/33", "b"), ("1.2/8", "c"), ("::/129", "d"), ("x", "e"), ("1.2.3.4/8/9", "f"), ("1.2.3.4/24abc", "g")])
    assert table.rows.count() == 1 and table.rejected.count() == 7
    assert found(table, spark, ["1.2.3", "01.2.3.4", "256.1.1.1", "", None, "::1", "1.2.3.4 "]) == [(False, None)] * 7


def test_empty_finished_and_raw(spark):
    assert found(PrefixTable.new(spark), spark, ["1.2.3.4", "fe0::1"]) == [(False, None)] * 2
    table = table_of(spark, [(p, p) for p in WITH_DEFAULT])
    raw = spark.createDataFrame([(0, bytes([147, 229, 3, 1])), (1, ipaddress.ip_address("2001:67c:1220::1").packed), (2, b"12345")], "i long, raw binary")
    for lookup in (table.lookup_raw, table.lookup_cache_raw):
        assert [r.value for r in lookup(raw, "raw").orderBy("i").collect()] == ["147.229.3.1", "2001:67c:1220::/32", None]
    assert found(table.rebuild().finish(), spark, ["1.2.3.4"]) == [(False, None)]


def test_info_and_dump(spark):
    table = table_of(spark, [(p, p) for p in WITH_DEFAULT])
    assert {r.family: (r.n_nodes, r.n_values, r.trie_bytes) for r in table.info().collect()} == {4: (71, 9, 71 * 32), 6: (168, 8, 168 * 32)}
    dump = {r.prefix: r.value for r in table.dump().collect()}
    assert len(dump) == 17
    assert dump["147.229.3.1/32"] == "147.229.3.1" and dump["2001:67c::/32"] == "2001:67c:1220::/32" and dump["::/0"] == "::/0"


def test_semi_and_anti(spark):
    table = table_of(spark, [("10.0.0.0/8", None)])
    probe = spark.createDataFrame([("10.1.1.1",), ("11.1.1.1",), (None,)], "addr string")
    assert [r.addr for r in table.semi(probe, "addr").collect()] == ["10.1.1.1"]
    assert {r.addr for r in table.anti(probe, "addr").collect()} == {"11.1.1.1", None}


@pytest.mark.parametrize("strategy", ["chain", "explode", "segments"])
def test_random_tables(spark, strategy):
    rng = random.Random(5)
    pairs = []
    for i in range(120):
        if i % 2:
            plen = rng.choice([0, 3, 8, 15, 16, 31, 32])
            pairs.append((f"{ipaddress.ip_address(rng.getrandbits(6) << 26 | rng.getrandbits(4))}/{plen}", str(i)))
        else:
            plen = rng.choice([0, 7, 63, 64, 65, 127, 128])
            pairs.append((f"{ipaddress.ip_address(rng.getrandbits(4) << 124 | rng.getrandbits(2) << 63 | rng.getrandbits(3))}/{plen}", str(i)))
    probe = [str(ipaddress.ip_network(rng.choice(pairs)[0], strict=False)[0] + rng.choice([0, 1])) for _ in range(150)]
    assert found(table_of(spark, pairs), spark, probe, strategy) == [brute(pairs, a) for a in probe]


def test_lookup_moves_nothing_of_the_probe(spark):
    table = table_of(spark, [(p, p) for p in WITHOUT_DEFAULT])
    probe = spark.range(100).select(F.col("id").alias("ip"))
    for strategy in ("chain", "segments"):
        plan = table.lookup_number(probe, "ip", strategy)._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_address_parsing_equals_the_socket_library():
    import socket

    import pyarrow as pa

    rng = random.Random(7)
    texts = ["", ":", "::", ":::", "1::2::3", "::1:2:3:4:5:6:7:8", "1.2.3.04", "é::", "a" * 60, None]
    for _ in range(4000):
        kind = rng.random()
        texts.append(str(ipaddress.IPv6Address(rng.getrandbits(128) & ~(rng.getrandbits(128) & rng.getrandbits(128)))) if kind < 0.3 else ":".join(rng.choice(["", "0", "1", "ab", "ffff"]) for _ in range(rng.randrange(1, 10))) if kind < 0.7 else ".".join(str(rng.randrange(300)) for _ in range(rng.choice([3, 4, 4, 4, 5]))))

    def one(x):
        try:
            return socket.inet_pton(socket.AF_INET6 if ":" in x else socket.AF_INET, x)
        except (OSError, TypeError, ValueError):
            return None

    assert A.parse_addresses(pa.array(texts, pa.string())).to_pylist() == [one(x) for x in texts]


def test_a_table_too_large_to_broadcast_is_exploded(spark, monkeypatch):
    from weirflow.operators import lpm

    monkeypatch.setattr(lpm, "BROADCAST_ROWS", 10)
    pairs = [(p, p) for p in WITH_DEFAULT]
    table = table_of(spark, pairs)
    assert found(table, spark, ADDRESSES) == [brute(pairs, a) for a in ADDRESSES]
    with pytest.raises(ValueError, match="too large"):
        table.lookup(spark.createDataFrame([("::1",)], "addr string"), "addr", "chain")


def test_address_texts(spark):
    texts = ["1.2.3.4", "0.0.0.0", "::", "::1", "1::", "2001:DB8::1:0:0:1", "1:0:0:2:0:0:0:3", "::ffff:1.2.3.4", "::1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "64:ff9b::192.0.2.33"]
    bad = ["1::2::3", ":1::", "1:2:3", "12345::", "1:2:3:4:5:6:7:8:9", "::1.2.3", "::1.2.3.400", "g::", "1.2.3.4.5", "::%eth0", "1:2:3:4:5:6:7:1.2.3.4"]
    rows = spark.createDataFrame([(t,) for t in texts + bad], "t string").select("t", A.address_text(A.address(F.col("t"))).alias("out")).collect()
    import socket

    for r in rows:
        if r.t in bad:
            assert r.out is None, r.t
        elif ":" in r.t:
            assert r.out == socket.inet_ntop(socket.AF_INET6, socket.inet_pton(socket.AF_INET6, r.t))
        else:
            assert r.out == r.t
