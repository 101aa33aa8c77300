"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, and the DuckDB SQL that each one is held against.

All queries read whole tables. Integers are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import addresses as A
from weirflow.functions import crc64
from weirflow.functions.packet_bytes import captured, number_at
from weirflow.operators import decode, flows, transport
from weirflow.operators.lpm import PrefixTable
from weirflow.plans import inputs
from weirflow.session import shared_folder
from weirflow.sources import headers, snapshots
from weirflow.streaming import relay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def longs(frame: DataFrame) -> DataFrame:
    """All integer columns as BIGINT."""
    return frame.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in frame.dtypes])


# Longest-prefix match

_V4 = ", ".join(
    f"({sum(int(o) << s for o, s in zip(p.split('/')[0].split('.'), (24, 16, 8, 0), strict=True))}, {p.split('/')[1]}, '{v}')" for _, p, v in inputs.V4_PREFIXES
)
_EVENT_IP = f"(SELECT event_id, {inputs.IP} AS ip FROM events)"


def _v4_sql(rows: str, columns: str = "event_id, v AS label") -> str:
    return f"""
WITH p(net, len, v) AS (VALUES {rows}), e AS {_EVENT_IP},
m AS (SELECT event_id, arg_max(v, len) AS v FROM e JOIN p ON ip // (CAST(1 AS BIGINT) << (32 - len)) = net // (CAST(1 AS BIGINT) << (32 - len)) GROUP BY event_id)
SELECT {columns} FROM e LEFT JOIN m USING (event_id)"""


_NO_DEFAULT = _V4[_V4.index("), (") + 3 :]


def _labelled(spark: SparkSession, sf_dir: str, strategy: str, default: bool = True) -> DataFrame:
    table = PrefixTable.of(inputs.prefixes(spark, inputs.V4_PREFIXES[0 if default else 1 :]))
    return table.lookup_number(inputs.with_ip(spark, sf_dir), "ip", strategy).select("event_id", F.col("value").alias("label"))


@query(_v4_sql(_V4))
def lpm_v4_lookup(spark, sf_dir):
    return _labelled(spark, sf_dir, "chain")


@query(_v4_sql(_NO_DEFAULT))
def lpm_v4_no_default(spark, sf_dir):
    return _labelled(spark, sf_dir, "chain", default=False)


@query(_v4_sql(_V4))
def lpm_v4_explode(spark, sf_dir):
    return _labelled(spark, sf_dir, "explode")


@query(_v4_sql(_NO_DEFAULT))
def lpm_v4_segments(spark, sf_dir):
    return _labelled(spark, sf_dir, "segments", default=False)


@query(_v4_sql(_V4))
def lpm_v4_text(spark, sf_dir):
    table = PrefixTable.of(inputs.prefixes(spark, inputs.V4_PREFIXES))
    probe = inputs.with_ip(spark, sf_dir).select("event_id", A.ipv4_text(F.col("ip")).alias("addr"))
    return table.lookup(probe, "addr").select("event_id", F.col("value").alias("label"))


@query(_v4_sql(_V4))
def lpm_v4_raw(spark, sf_dir):
    table = PrefixTable.of(inputs.prefixes(spark, inputs.V4_PREFIXES))
    probe = inputs.with_ip(spark, sf_dir).select("event_id", F.unhex(inputs.digits("ip", 4)).alias("raw"))
    return table.lookup_cache_raw(probe, "raw").select("event_id", F.col("value").alias("label"))


def _hi(prefix: str) -> int:
    groups = prefix.split("/")[0].split("::")[0].split(":")
    return sum(int(g, 16) << (48 - 16 * i) for i, g in enumerate(groups))


_V6_SQL = f"""
WITH p(net, len, v) AS (VALUES {", ".join(f"(CAST({_hi(p)} AS HUGEINT), {p.split('/')[1]}, '{v}')" for _, p, v in inputs.V6_PREFIXES)}),
e AS (SELECT event_id, CAST({_hi("2001:db8::/32")} AS HUGEINT) + (user_id % 64) * 65536 + event_id % 16 AS hi FROM events),
m AS (SELECT event_id, arg_max(v, len) AS v FROM e JOIN p ON hi // CAST(pow(2, 64 - len) AS HUGEINT) = net // CAST(pow(2, 64 - len) AS HUGEINT) GROUP BY event_id)
SELECT event_id, v AS label FROM e LEFT JOIN m USING (event_id)"""


def _v6(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    addr = F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.expr("user_id % 64"))), F.lit(":"), F.hex(F.expr("event_id % 16")), F.lit("::"), F.hex(F.expr("event_id % 65536")))
    probe = inputs.events(spark, sf_dir).select("event_id", addr.alias("addr"))
    return PrefixTable.of(inputs.prefixes(spark, inputs.V6_PREFIXES)).lookup(probe, "addr", strategy).select("event_id", F.col("value").alias("label"))


@query(_V6_SQL)
def lpm_v6_lookup(spark, sf_dir):
    return _v6(spark, sf_dir, "explode")


@query(_V6_SQL)
def lpm_v6_segments(spark, sf_dir):
    return _v6(spark, sf_dir, "segments")


def _learned(spark: SparkSession, sf_dir: str) -> PrefixTable:
    """A table of many overlapping prefixes: one for each event, of four lengths, with many inserted again."""
    text = F.concat(A.ipv4_text(F.col("ip")), F.lit("/"), F.expr("cast(8 + 8 * (event_id % 4) as string)"))
    return PrefixTable.of(inputs.with_ip(spark, sf_dir).select(F.col("event_id").alias("seq"), text.alias("prefix"), F.col("event_type").alias("value")))


_LEARNED = f"""l AS (SELECT event_id AS seq, len, ip // (CAST(1 AS BIGINT) << (32 - len)) AS k, event_type AS v
  FROM (SELECT event_id, event_type, {inputs.IP} AS ip, 8 + 8 * (event_id % 4) AS len FROM events))"""
_TEXT = "concat(n // 16777216, '.', n // 65536 % 256, '.', n // 256 % 256, '.', n % 256)"


@query(f"WITH {_LEARNED} SELECT len AS plen, k AS prefix_bits, arg_min(v, seq) AS value FROM l GROUP BY len, k")
def lpm_first_wins(spark, sf_dir):
    bits = F.expr("shiftrightunsigned(hi, 64 - plen)")
    return longs(_learned(spark, sf_dir).rows.select("plen", bits.alias("prefix_bits"), "value"))


@query(f"WITH {_LEARNED}, d AS (SELECT len, k * (CAST(1 AS BIGINT) << (32 - len)) AS n, arg_min(v, seq) AS v FROM l GROUP BY ALL) SELECT {_TEXT} || '/' || len AS prefix, v AS value FROM d")
def lpm_dump_v4(spark, sf_dir):
    return _learned(spark, sf_dir).dump()


@query(f"""WITH {_LEARNED}, p AS (SELECT DISTINCT len, k FROM l),
t AS (SELECT DISTINCT d, k // (CAST(1 AS BIGINT) << (len - d)) AS b FROM (SELECT len, k, unnest(range(0, len + 1)) AS d FROM p))
SELECT CAST(4 AS BIGINT) AS family, (SELECT count(*) FROM t) AS n_nodes, (SELECT count(*) FROM p) AS n_values, (SELECT 32 * count(*) FROM t) AS trie_bytes""")
def lpm_info_v4(spark, sf_dir):
    return longs(_learned(spark, sf_dir).info())


_V6_LENGTHS = (32, 48, 60, 64)


def _learned_v6(spark: SparkSession, sf_dir: str) -> PrefixTable:
    """An IPv6 table of one prefix for each event, of four lengths, many inserted again."""
    plen = F.element_at(F.array(*map(F.lit, _V6_LENGTHS)), F.expr("cast(1 + event_id % 4 as int)"))
    text = F.concat(F.lit("2001:DB8:"), F.hex(F.expr("user_id % 64 + 1")), F.lit(":"), F.hex(F.expr("event_id % 15 * 256 + 256")), F.lit("::/"), plen.cast("string"))
    return PrefixTable.of(inputs.events(spark, sf_dir).select(F.col("event_id").alias("seq"), text.alias("prefix"), F.col("event_type").alias("value")))


_LEARNED_V6 = f"""l AS (SELECT event_id AS seq, (ARRAY{list(_V6_LENGTHS)})[1 + CAST(event_id % 4 AS INT)] AS len, event_type AS v, user_id % 64 + 1 AS x, event_id % 15 * 256 + 256 AS y,
  CAST({_hi("2001:db8::/32")} AS HUGEINT) + (user_id % 64 + 1) * 65536 + event_id % 15 * 256 + 256 AS hi FROM events),
q AS (SELECT len, hi // CAST(pow(2, 64 - len) AS HUGEINT) AS k, arg_min(v, seq) AS v, min(x) AS x, min(y) AS y FROM l GROUP BY ALL)"""


@query(f"""WITH {_LEARNED_V6}, t AS (SELECT DISTINCT d, k // CAST(pow(2, len - d) AS HUGEINT) AS b FROM (SELECT len, k, unnest(range(0, len + 1)) AS d FROM q))
SELECT CAST(6 AS BIGINT) AS family, (SELECT count(*) FROM t) AS n_nodes, (SELECT count(*) FROM q) AS n_values, (SELECT 32 * count(*) FROM t) AS trie_bytes""")
def lpm_info_v6(spark, sf_dir):
    return longs(_learned_v6(spark, sf_dir).info())


@query(f"""WITH {_LEARNED_V6} SELECT CASE len WHEN 32 THEN '2001:db8::' WHEN 48 THEN '2001:db8:' || lower(to_hex(x)) || '::'
ELSE '2001:db8:' || lower(to_hex(x)) || ':' || lower(to_hex(y)) || '::' END || '/' || len AS prefix, v AS value FROM q""")
def lpm_dump_v6(spark, sf_dir):
    return _learned_v6(spark, sf_dir).dump()


_V6_LOOKUP = f"""WITH {_LEARNED_V6}, e AS (SELECT event_id, CAST({_hi("2001:db8::/32")} AS HUGEINT) + (event_id % 70) * 65536 + user_id % 15 * 256 + user_id % 300 AS hi FROM events),
c AS (SELECT event_id, hi, unnest({list(_V6_LENGTHS)}) AS len FROM e), m AS (SELECT event_id, arg_max(v, len) AS v FROM c JOIN q USING (len) WHERE k = hi // CAST(pow(2, 64 - len) AS HUGEINT) GROUP BY event_id)
SELECT event_id, v AS label FROM e LEFT JOIN m USING (event_id)"""


def _v6_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.unhex(F.concat(F.lit("20010DB8"), inputs.digits("event_id % 70", 2), inputs.digits("user_id % 15 * 256 + user_id % 300", 2), inputs.digits("event_id", 8)))
    return inputs.events(spark, sf_dir).select("event_id", raw.alias("raw"))


@query(_V6_LOOKUP)
def lpm_v6_raw(spark, sf_dir):
    return _learned_v6(spark, sf_dir).lookup_raw(_v6_probe(spark, sf_dir), "raw").select("event_id", F.col("value").alias("label"))


@query(_V6_LOOKUP)
def lpm_v6_text(spark, sf_dir):
    probe = _v6_probe(spark, sf_dir).select("event_id", A.address_text(A.raw_address(F.col("raw"))).alias("addr"))
    return _learned_v6(spark, sf_dir).lookup(probe, "addr", "explode").select("event_id", F.col("value").alias("label"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '20010DB80000' || printf('%04X', user_id % 64 + 1) || repeat('0', 12) || printf('%04X', event_id % 65536) WHEN 1 THEN '0A00' || printf('%02X%02X', user_id % 256, event_id % 256) END AS raw FROM events")
def address_bytes(spark, sf_dir):
    """both families' texts to bytes; malformed ones to null."""
    six = F.concat(F.lit("2001:dB8:0:"), F.hex(F.expr("user_id % 64 + 1")), F.lit("::"), F.hex(F.expr("event_id % 65536")))
    four = F.concat(F.lit("10.0."), F.expr("cast(user_id % 256 as string)"), F.lit("."), F.expr("cast(event_id % 256 as string)"))
    text = F.when(F.expr("event_id % 3 = 0"), six).when(F.expr("event_id % 3 = 1"), four).otherwise(F.concat(four, F.lit(".9")))
    return inputs.events(spark, sf_dir).select("event_id", F.hex(A.format_addr(text)).alias("raw"))


@query(f"""WITH {_LEARNED}, p AS (SELECT len, k, arg_min(v, seq) AS v FROM l GROUP BY ALL), e AS {_EVENT_IP},
x AS (SELECT event_id, ip, unnest([8, 16, 24, 32]) AS len FROM e)
SELECT event_id, arg_max(v, len) AS label FROM x JOIN p USING (len) WHERE k = ip // (CAST(1 AS BIGINT) << (32 - len)) GROUP BY event_id""")
def lpm_learned_table(spark, sf_dir):
    return _learned(spark, sf_dir).lookup_number(inputs.with_ip(spark, sf_dir), "ip").select("event_id", F.col("value").alias("label"))


_COVERED = "ip // 1048576 = 167772160 // 1048576 + 1"


@query(f"SELECT event_id FROM {_EVENT_IP} WHERE {_COVERED}")
def lpm_semi(spark, sf_dir):
    probe = inputs.with_ip(spark, sf_dir).select("event_id", A.ipv4_text(F.col("ip")).alias("addr"))
    return PrefixTable.of(inputs.prefixes(spark, inputs.V4_PREFIXES[2:])).semi(probe, "addr").select("event_id")


@query(f"SELECT event_id FROM {_EVENT_IP} WHERE NOT ({_COVERED})")
def lpm_anti(spark, sf_dir):
    probe = inputs.with_ip(spark, sf_dir).select("event_id", A.ipv4_text(F.col("ip")).alias("addr"))
    return PrefixTable.of(inputs.prefixes(spark, inputs.V4_PREFIXES[2:])).anti(probe, "addr").select("event_id")


@query(f"SELECT label, count(*) AS n FROM ({_v4_sql(_V4)}) GROUP BY label")
def traffic_by_prefix(spark, sf_dir):
    table = PrefixTable.of(inputs.prefixes(spark, inputs.V4_PREFIXES))
    return flows.traffic_by_prefix(inputs.with_ip(spark, sf_dir), table, "ip")


@query(f"SELECT label, count(*) AS n FROM ({_v4_sql(_V4)}) GROUP BY label ORDER BY n DESC, label LIMIT 3")
def top_prefixes(spark, sf_dir):
    return traffic_by_prefix(spark, sf_dir).orderBy(F.desc("n"), "label").limit(3)


# Scalar functions

@query(f"SELECT event_id, {_TEXT.replace('n ', 'ip ')} AS addr, ip AS number FROM {_EVENT_IP}")
def ipv4_text_roundtrip(spark, sf_dir):
    shown = inputs.with_ip(spark, sf_dir).select("event_id", A.ipv4_text(F.col("ip")).alias("addr"))
    return shown.withColumn("number", A.ipv4_number(F.col("addr")))


@query(f"""SELECT event_id, CAST(4 AS BIGINT) AS family, len AS plen, ip // (CAST(1 AS BIGINT) << (32 - len)) * (CAST(1 AS BIGINT) << (32 - len)) AS net
FROM (SELECT event_id, ip, event_id % 33 AS len FROM {_EVENT_IP})""")
def prefix_parse(spark, sf_dir):
    text = F.concat(A.ipv4_text(F.col("ip")), F.lit("/"), F.expr("cast(event_id % 33 as string)"))
    parsed = inputs.with_ip(spark, sf_dir).select("event_id", A.prefix(text).alias("p"))
    return longs(parsed.select("event_id", "p.family", "p.plen", F.expr("shiftrightunsigned(p.hi, 32)").alias("net")))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '2001:db8:0:' || lower(to_hex(user_id % 64 + 1)) || '::' || lower(to_hex(event_id % 65535 + 1))
  WHEN event_id % 3 = 1 THEN '2001:db8::' || lower(to_hex(user_id % 64 + 1)) || ':0:0:' || lower(to_hex(event_id % 65535 + 1))
  ELSE '::ffff:10.0.' || (user_id % 256) || '.' || (event_id % 256) END AS addr FROM events""")
def ipv6_canonical(spark, sf_dir):
    a, b = F.hex(F.expr("user_id % 64 + 1")), F.hex(F.expr("event_id % 65535 + 1"))
    long = F.concat(F.lit("2001:0DB8:0000:"), a, F.lit(":0:0:0:"), b)
    tied = F.concat(F.lit("2001:db8:0:0:"), a, F.lit(":0:0:"), b)
    mapped = F.concat(F.lit("0:0:0:0:0:FFFF:10.0."), F.expr("cast(user_id % 256 as string)"), F.lit("."), F.expr("cast(event_id % 256 as string)"))
    text = F.when(F.expr("event_id % 3 = 0"), long).when(F.expr("event_id % 3 = 1"), tied).otherwise(mapped)
    return inputs.events(spark, sf_dir).select("event_id", A.address_text(A.address(text)).alias("addr"))


#: The CRC's table of 256 remainders, and the CRC of a column ``h`` of hex digits as UBIGINT ``crc``.
_CRC_TABLE = f"""steps(i, k, v) AS (SELECT range, 0, CAST(range AS UBIGINT) << 56 FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v >= 9223372036854775808 THEN xor((v - 9223372036854775808) << 1, CAST({crc64.POLYNOMIAL} AS UBIGINT)) ELSE v << 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM steps WHERE k = 8)"""


def _crc_sql(rows: str, columns: str) -> str:
    ones = "CAST(18446744073709551615 AS UBIGINT)"
    data = "list_transform(range(1, length(h), 2), lambda i: CAST(CAST('0x' || substr(h, i, 2) AS INT) AS UBIGINT))"
    folded = f"list_reduce({data}, lambda c, b: xor((c & 72057594037927935) << 8, tab[CAST(xor(c >> 56, b) AS INT) + 1]), {ones})"
    return f"WITH RECURSIVE {_CRC_TABLE}, d AS ({rows}) SELECT {columns}, to_hex(xor({folded}, {ones})) AS crc FROM d, crc_table"


_LOW_FIRST = "concat({0}[15:16], {0}[13:14], {0}[11:12], {0}[9:10], {0}[7:8], {0}[5:6], {0}[3:4], {0}[1:2])"
_FLOW_KEYS = f"""SELECT packet_id, {_LOW_FIRST.format("s")} || {_LOW_FIRST.format("t")} || printf('%02X', protocol) || printf('%02X%02X%02X%02X', sport % 256, sport // 256, dport % 256, dport // 256) AS h
FROM (SELECT packet_id, protocol, sport, dport, CASE kind WHEN 3 THEN repeat('0', 16) ELSE printf('%016X', event_id % 100) END AS s,
  CASE kind WHEN 4 THEN '00005EFE' || printf('%08X', user_id) ELSE printf('%016X', 1) END AS t FROM (@RECORD) WHERE tunnel IS NOT NULL)"""


@query("flow keys")
def flow_id_crc64(spark, sf_dir):
    return decode.decode(inputs.packets(spark, sf_dir), with_key=True).filter("flow_id is not null").select("packet_id", F.hex("flow_id").alias("flow_id"))


@query(_crc_sql("SELECT event_id, hex(encode(event_type)) AS h FROM events", "event_id"))
def crc64_of_text(spark, sf_dir):
    return inputs.events(spark, sf_dir).select("event_id", F.hex(crc64.crc64(F.encode(F.col("event_type"), "UTF-8"))).alias("crc"))


# Packets

_PACKET = "SELECT event_id AS packet_id, event_id, user_id, event_id % 8 AS kind FROM events"


@query(f"SELECT packet_id, CASE WHEN kind IN (0, 1) THEN 34525 ELSE 2048 END AS ethertype, CASE WHEN kind = 1 THEN event_id % 4096 ELSE 0 END AS vlan_id FROM ({_PACKET})")
def ethertype_vlan(spark, sf_dir):
    return longs(decode.with_ethernet(inputs.packets(spark, sf_dir)).select("packet_id", "ethertype", "vlan_id"))


@query(f"""SELECT packet_id, CASE kind WHEN 1 THEN 8 WHEN 6 THEN 8 ELSE 20 END AS plen, CASE kind WHEN 1 THEN 17 WHEN 6 THEN 58 ELSE 6 END AS protocol,
CASE kind WHEN 3 THEN '2002' || upper(printf('%012x', user_id)) || repeat('0', 16) ELSE '20010DB8' || upper(printf('%08x', user_id)) || '00000000' || upper(printf('%08x', event_id % 100)) END AS src
FROM ({_PACKET}) WHERE kind <> 7""")
def ipv6_header(spark, sf_dir):
    found = decode.with_ipv6(decode.with_tunnel_offsets(decode.with_udp(decode.with_ipv4(decode.with_ethernet(inputs.packets(spark, sf_dir))))))
    row = F.struct("packet_id", F.col("_plen").alias("plen"), F.col("_protocol").alias("protocol"), F.col("_src6").alias("src"))
    return longs(found.select(F.inline(F.filter(F.array(row), lambda r: r["plen"].isNotNull()))))


_AYIYA_OK = "event_id % 251 <= 120"
_RECORD = f"""SELECT *, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 3 WHEN 5 THEN CASE WHEN {_AYIYA_OK} THEN 5 END WHEN 6 THEN 6 END AS tunnel,
  CASE kind WHEN 1 THEN 17 WHEN 5 THEN CASE WHEN {_AYIYA_OK} THEN 6 ELSE 17 END WHEN 6 THEN 58 ELSE 6 END AS protocol,
  CASE kind WHEN 1 THEN 48 WHEN 6 THEN 48 WHEN 5 THEN CASE WHEN {_AYIYA_OK} THEN 60 ELSE 132 END WHEN 7 THEN 40 ELSE 60 END AS octets,
  CASE WHEN kind = 6 THEN 0 WHEN kind = 5 AND NOT {_AYIYA_OK} THEN 5072 ELSE 1024 + user_id % 5000 END AS sport,
  CASE WHEN kind = 6 THEN 0 WHEN kind = 5 AND NOT {_AYIYA_OK} THEN 1024 + user_id % 5000 ELSE event_id % 1024 END AS dport FROM ({_PACKET})"""


ORACLES["flow_id_crc64"] = _crc_sql(_FLOW_KEYS.replace("@RECORD", _RECORD), "packet_id").replace(" AS crc FROM", " AS flow_id FROM")


@query(f"""SELECT packet_id, sport AS src_port, dport AS dst_port, CASE WHEN protocol = 6 THEN event_id % 64 WHEN protocol = 17 THEN 0 END AS tcp_flags,
CASE WHEN kind = 6 THEN (128 + event_id % 2) * 256 + user_id % 4 END AS icmp_type_code FROM ({_RECORD})""")
def l4_ports_icmp(spark, sf_dir):
    return longs(decode.decode(inputs.packets(spark, sf_dir)).select("packet_id", "src_port", "dst_port", "tcp_flags", "icmp_type_code"))


@query(f"""SELECT packet_id, tunnel AS tunnel_type, octets, protocol, CASE WHEN tunnel > 1 THEN {inputs.IP} ELSE 0 END AS outer_src_ip4,
CASE WHEN tunnel > 1 THEN 84281096 ELSE 0 END AS outer_dst_ip4, (1700000000 + event_id) * 1000 AS start_ms FROM ({_RECORD})""")
def flow_records(spark, sf_dir):
    out = decode.decode(inputs.packets(spark, sf_dir))
    return longs(out.select("packet_id", "tunnel_type", "octets", "protocol", "outer_src_ip4", "outer_dst_ip4", F.unix_millis("flow_start").alias("start_ms")))


@query(f"SELECT packet_id FROM ({_PACKET}) WHERE kind = 5 AND {_AYIYA_OK}")
def ayiya_skew_filter(spark, sf_dir):
    return decode.decode(inputs.packets(spark, sf_dir)).filter(F.col("tunnel_type") == decode.AYIYA).select("packet_id")


@query(f"SELECT packet_id FROM ({_PACKET}) WHERE kind = 2")
def teredo_accept(spark, sf_dir):
    return decode.decode(inputs.packets(spark, sf_dir)).filter(F.col("tunnel_type") == decode.TEREDO).select("packet_id")


@query("""WITH c AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '2002' ELSE '2001' END AS s, CASE event_id % 7 WHEN 0 THEN '5efe' ELSE '0000' END AS si,
  CASE event_id % 11 WHEN 0 THEN '2002' ELSE '2001' END AS d, CASE event_id % 13 WHEN 0 THEN '5efe' ELSE '0000' END AS di, event_id % 17 = 0 AS relay FROM events)
SELECT event_id, CAST(CASE WHEN s = '2002' THEN 4 WHEN si = '5efe' THEN 3 WHEN d = '2002' THEN 4 WHEN di = '5efe' THEN 3 WHEN relay THEN 4 ELSE 6 END AS BIGINT) AS tunnel_type FROM c""")
def tunnel_classify(spark, sf_dir):
    six = lambda head, mark: F.concat(
        F.when(F.expr(f"event_id % {head} = 0"), "2002").otherwise("2001"), F.lit("0" * 16), F.when(F.expr(f"event_id % {mark} = 0"), "5EFE").otherwise("0000"), F.lit("0" * 8)
    )
    relay = F.when(F.expr("event_id % 17 = 0"), F.lit(decode.RELAY)).otherwise(1)
    return longs(inputs.events(spark, sf_dir).select("event_id", decode.tunnel_class(six(5, 7), six(11, 13), F.lit(2), relay).alias("tunnel_type")))


@query(f"SELECT tunnel AS tunnel_type, count(*) AS packets, CAST(sum(octets) AS BIGINT) AS octets FROM ({_RECORD}) GROUP BY tunnel")
def tunnel_mix(spark, sf_dir):
    return longs(flows.tunnel_mix(decode.decode(inputs.packets(spark, sf_dir))))


@query(f"""SELECT packet_id, CAST(CASE WHEN tunnel IS NOT NULL THEN 1 + CASE protocol WHEN 6 THEN 0 WHEN 17 THEN 2 ELSE 4 END + CASE WHEN kind = 1 AND event_id % 4096 > 0 THEN 1 ELSE 0 END
ELSE CASE protocol WHEN 17 THEN 9 ELSE 11 END END AS BIGINT) AS template_id FROM ({_RECORD})""")
def template_route(spark, sf_dir):
    records = decode.decode(inputs.packets(spark, sf_dir))
    return longs(records.select("packet_id", decode.template_id(F.col("ip_version"), F.col("protocol"), F.col("vlan_id")).alias("template_id")))


@query(f"""SELECT template_id, count(*) AS records, CAST(sum(octets) AS BIGINT) AS octets_out FROM (SELECT octets, CAST(CASE WHEN tunnel IS NOT NULL THEN 1 + CASE protocol WHEN 6 THEN 0 WHEN 17 THEN 2 ELSE 4 END
  + CASE WHEN kind = 1 AND event_id % 4096 > 0 THEN 1 ELSE 0 END ELSE CASE protocol WHEN 17 THEN 9 ELSE 11 END END AS BIGINT) AS template_id FROM ({_RECORD})) GROUP BY template_id""")
def template_export(spark, sf_dir):
    """K2: all records written once, by template, and read back from each template's folder."""
    path = f"{shared_folder(spark, 'export')}/records"
    decode.write_export(decode.decode(inputs.packets(spark, sf_dir)), path)
    parts = [decode.read_export(spark, path, k).select(F.lit(k).cast("bigint").alias("template_id"), "octets_out") for k in decode.templates()]
    return reduce(DataFrame.unionByName, parts).groupBy("template_id").agg(F.count("*").alias("records"), F.sum("octets_out").alias("octets_out"))


@query(f"""SELECT tunnel AS tunnel_type, protocol, sport AS src_port, (min(1700000000 + event_id)) * 1000 AS first_ms, (max(1700000000 + event_id)) * 1000 AS last_ms,
CAST(sum(octets) AS BIGINT) AS octets, count(*) AS packets, bit_or(CASE WHEN protocol = 6 THEN event_id % 64 ELSE 0 END) AS tcp_flags FROM ({_RECORD}) GROUP BY ALL""")
def flow_aggregate(spark, sf_dir):
    found = flows.aggregate_flows(decode.decode(inputs.packets(spark, sf_dir)), ["tunnel_type", "protocol", "src_port"])
    return longs(found.withColumns({"first_ms": F.unix_millis("flow_start"), "last_ms": F.unix_millis("flow_end")}).drop("flow_start", "flow_end"))


@query(f"""SELECT w * 60000 AS start_ms, count(*) / 60 AS packets_per_s, sum(octets) / 60 AS octets_per_s FROM (SELECT *, (1700000000 + event_id) // 60 AS w FROM ({_RECORD})) GROUP BY w""")
def packet_rate(spark, sf_dir):
    return flows.packet_rate(decode.decode(inputs.packets(spark, sf_dir)), 60).select(F.unix_millis("w.start").alias("start_ms"), "packets_per_s", "octets_per_s")


_LABEL = f"""WITH p(net, len, v) AS (VALUES {_V4}), r AS ({_RECORD}), a AS (SELECT packet_id, {inputs.IP} AS ip FROM r WHERE tunnel > 1),
m AS (SELECT packet_id, arg_max(v, len) AS v FROM a JOIN p ON ip // (CAST(1 AS BIGINT) << (32 - len)) = net // (CAST(1 AS BIGINT) << (32 - len)) GROUP BY packet_id)
SELECT packet_id, v AS src_label, 'default' AS dst_label FROM m"""


@query(_LABEL)
def label_tunnel_ends(spark, sf_dir):
    table = PrefixTable.of(inputs.prefixes(spark, inputs.V4_PREFIXES))
    records = decode.decode(inputs.packets(spark, sf_dir)).filter("tunnel_type > 1").select("packet_id", "outer_src_ip4", "outer_dst_ip4")
    return flows.label_ends(records, table, "outer_src_ip4", "outer_dst_ip4").select("packet_id", "src_label", "dst_label")


@query("SELECT event_id AS packet_id FROM events WHERE event_id % 10 = 0")
def packet_sample(spark, sf_dir):
    return decode.sample(inputs.packets(spark, sf_dir), 10).select("packet_id")


#: Captured lengths of snap_length, by packet: some end before, some after the headers that a record needs.
_SNAPS = (14, 34, 54, 68, 96, 1000)
_KEEPS = "CASE kind WHEN 0 THEN 68 WHEN 1 THEN 66 WHEN 2 THEN 96 WHEN 3 THEN 88 WHEN 4 THEN 88 WHEN 5 THEN 140 WHEN 6 THEN 76 ELSE 48 END"
_SNAP = f"(ARRAY[{', '.join(map(str, _SNAPS))}])[1 + CAST(event_id % {len(_SNAPS)} AS INT)]"


@query(f"""SELECT packet_id, CAST(CASE WHEN six THEN tunnel END AS BIGINT) AS tunnel_type, CASE WHEN six THEN sport WHEN snap > 34 THEN CASE kind WHEN 2 THEN 3544 WHEN 5 THEN 5072 WHEN 7 THEN sport END END AS src_port
FROM (SELECT *, snap >= {_KEEPS} AND tunnel IS NOT NULL AS six FROM (SELECT *, {_SNAP} AS snap FROM (SELECT * FROM ({_RECORD}))))
WHERE six OR kind > 1 AND snap >= 34""")
def snap_length(spark, sf_dir):
    """Every packet, decoded from as many bytes as were captured: those beyond are invisible, and what is cut falls back or gives no record."""
    snap = F.element_at(F.array(*map(F.lit, _SNAPS)), (1 + F.col("packet_id") % len(_SNAPS)).cast("int"))
    cut = inputs.packets(spark, sf_dir).withColumn("caplen", snap)
    return longs(decode.decode(cut).select("packet_id", "tunnel_type", "src_port"))


@query(f"SELECT packet_id, CAST(NULL AS BIGINT) AS port, CAST(CASE kind WHEN 0 THEN 34525 WHEN 1 THEN 33024 ELSE 2048 END AS BIGINT) AS ethertype FROM ({_PACKET})")
def snap_length_all(spark, sf_dir):
    """Of 14 captured bytes of every packet, the ethertype is all that is left."""
    data = captured(F.col("data"), F.lit(14))
    return inputs.packets(spark, sf_dir).select("packet_id", number_at(data, 54, 2).alias("port"), number_at(data, 12, 2).alias("ethertype"))


# Hard packets: extension headers, Teredo shims, other protocols, captures cut short

_HARD = f"SELECT event_id AS packet_id, event_id, user_id, event_id % {len(inputs.HARD_KINDS)} AS kind FROM events"
_HARD_AYIYA = "event_id % 251 <= 120"
_HARD_RECORD = f"""SELECT *, CASE WHEN kind < 8 OR kind = 23 THEN 1 WHEN kind IN (9, 10, 11, 13) THEN 2 WHEN kind IN (20, 22) THEN 4 WHEN kind = 15 AND {_HARD_AYIYA} THEN 5 END AS tunnel,
  CASE WHEN kind = 15 THEN CASE WHEN {_HARD_AYIYA} THEN 6 ELSE 17 END ELSE (ARRAY[6, 17, 6, 132, 43, 132, 33, 59, 1, 6, 6, 6, 17, 6, 17, 0, 0, 0, 41, 0, 6, 47, 6, 58])[1 + CAST(kind AS INT)] END AS protocol,
  CASE WHEN kind = 15 THEN CASE WHEN {_HARD_AYIYA} THEN 60 ELSE 132 END ELSE (ARRAY[76, 56, 76, 72, 68, 48, 48, 40, 28, 60, 60, 60, 88, 60, 88, 0, 0, 0, 80, 0, 60, 28, 60, 64])[1 + CAST(kind AS INT)] END AS octets
FROM ({_HARD}) WHERE kind NOT IN (16, 17, 19)"""
_HARD_PORTS = "(tunnel IS NOT NULL AND protocol IN (6, 17, 33, 132))"


@query(f"""SELECT packet_id, tunnel AS tunnel_type, protocol, octets,
  CASE WHEN {_HARD_PORTS} THEN 1024 + user_id % 5000 WHEN kind = 12 THEN 3544 WHEN kind = 14 THEN 98 WHEN kind = 15 THEN 5072 WHEN protocol IN (1, 58) THEN 0 END AS src_port,
  CASE WHEN {_HARD_PORTS} THEN event_id % 1024 WHEN kind IN (12, 14, 15) THEN 1024 + user_id % 5000 WHEN protocol IN (1, 58) THEN 0 END AS dst_port,
  CASE WHEN protocol = 6 THEN event_id % 64 WHEN protocol IN (17, 33, 132) THEN 0 END AS tcp_flags,
  CASE protocol WHEN 1 THEN 2051 WHEN 58 THEN (128 + event_id % 2) * 256 + user_id % 4 END AS icmp_type_code,
  CASE WHEN kind = 23 THEN 100 ELSE 0 END AS vlan_id, CASE WHEN tunnel > 1 THEN {inputs.IP} ELSE 0 END AS outer_src_ip4 FROM ({_HARD_RECORD})""")
def hard_flow_records(spark, sf_dir):
    """P6 to P17 on awkward frames: auth, origin and rejected Teredo, hop-by-hop and fragment headers, SCTP, DCCP, other protocols, cut captures."""
    out = decode.decode(inputs.hard_packets(spark, sf_dir))
    return longs(out.select("packet_id", "tunnel_type", "protocol", "octets", "src_port", "dst_port", "tcp_flags", "icmp_type_code", "vlan_id", "outer_src_ip4"))


@query(f"SELECT packet_id, kind IN (9, 10, 11, 13) AS accepted FROM ({_HARD_RECORD})")
def teredo_verdicts(spark, sf_dir):
    """P6 to P8 both ways: of every record, whether it was taken for Teredo."""
    out = decode.decode(inputs.hard_packets(spark, sf_dir))
    return out.select("packet_id", F.coalesce(F.col("tunnel_type") == decode.TEREDO, F.lit(False)).alias("accepted"))


@query(f"""SELECT packet_id, (ARRAY[6, 17, 6, 132, 43, 132, 33, 59, 0, 6, 6, 6, 6, 6, 6, 6, 0, 0, 6, 0, 6, 0, 6, 58])[1 + CAST(kind AS INT)] AS protocol,
(ARRAY[70, 62, 70, 78, 54, 54, 54, 54, 0, 100, 90, 108, 82, 82, 82, 126, 0, 0, 74, 0, 78, 0, 74, 74])[1 + CAST(kind AS INT)] AS upper_at FROM ({_HARD}) WHERE kind NOT IN (8, 16, 17, 19, 21)""")
def extension_headers(spark, sf_dir):
    """P12 and P13: where the upper header begins after hop-by-hop and fragment headers, in every packet with an IPv6 header."""
    found = decode.with_ipv6(decode.with_tunnel_offsets(decode.with_udp(decode.with_ipv4(decode.with_ethernet(inputs.hard_packets(spark, sf_dir, ports_shown=False))))))
    row = F.struct("packet_id", F.col("_protocol").alias("protocol"), F.col("_up").alias("upper_at"))
    return longs(found.select(F.inline(F.filter(F.array(row), lambda r: r["protocol"].isNotNull() & r["upper_at"].isNotNull()))))


@query(f"SELECT packet_id, data FROM (SELECT event_id AS packet_id, '00 00 00 00 00 00 00 00 00 00 00 00 ' || CASE event_id % 8 WHEN 0 THEN '86 DD' WHEN 1 THEN '81 00' ELSE '08 00' END AS data FROM events)")
def frame_dump(spark, sf_dir):
    """K8: the spaced hex of what was captured, here the Ethernet header."""
    cut = inputs.packets(spark, sf_dir).withColumn("caplen", F.lit(14))
    return decode.hex_dump(cut).withColumnRenamed("bytes", "data")


# Transport

@query("SELECT event_id, 'D ' || to_base64(encode(event_type)) AS line FROM events")
def wire_envelope(spark, sf_dir):
    return inputs.events(spark, sf_dir).select("event_id", transport.envelope(F.encode(F.col("event_type"), "UTF-8")).alias("line"))


@query("SELECT event_id, event_type AS payload FROM events")
def encrypted_roundtrip(spark, sf_dir):
    line = transport.envelope(F.encode(F.col("event_type"), "UTF-8"), key="secret")
    return inputs.events(spark, sf_dir).select("event_id", F.decode(transport.decoded(line, key="secret"), "UTF-8").alias("payload"))


@query("""SELECT event_id, CAST(CASE WHEN event_id % 8 IN (1, 2) THEN 510 WHEN event_id % 8 = 0 THEN CASE WHEN user_id % 4 = 0 THEN CASE WHEN length(event_type) > 0 THEN 200 ELSE 410 END ELSE 420 END
  WHEN user_id % 4 = 0 THEN 430 WHEN event_id % 8 IN (3, 5) THEN 410 WHEN length(event_type) > 0 THEN 200 ELSE 410 END AS BIGINT) AS status FROM events""")
def wire_status(spark, sf_dir):
    return longs(inputs.wire_lines(spark, sf_dir).select("event_id", transport.status(F.col("line"), F.col("has_key")).alias("status")))


@query("SELECT n AS attempt, CAST(least(pow(3, n), 243) AS BIGINT) AS delay_s FROM range(7) t(n)")
def backoff_schedule(spark, sf_dir):
    return transport.backoff(spark, 7)


_SEGMENTS = """WITH RECURSIVE d AS (SELECT user_id % 16 AS stream, event_id AS seq, 1700000000 + event_id * 2 + user_id % 11 AS at_s, user_id % 3 = 0 AS backlog, event_type,
  row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS k FROM events),
r AS (SELECT stream, seq, k, at_s, backlog, event_type, CAST(0 AS BIGINT) AS segment, CAST(0 AS BIGINT) AS pos, at_s AS began FROM d WHERE k = 1
  UNION ALL SELECT d.stream, d.seq, d.k, d.at_s, d.backlog, d.event_type, CASE WHEN cut THEN segment + 1 ELSE segment END, CASE WHEN cut THEN 0 ELSE pos + 1 END, CASE WHEN cut THEN r.at_s ELSE began END
  FROM (SELECT *, at_s - began > CASE WHEN backlog THEN 120 ELSE 1 END AS cut FROM r) r JOIN d ON d.stream = r.stream AND d.k = r.k + 1) """


@query(_SEGMENTS + "SELECT CAST(stream AS VARCHAR) AS stream_id, seq, segment, pos FROM r")
def queue_segments(spark, sf_dir):
    return transport.queue_segments(inputs.datagrams(spark, sf_dir)).select("stream_id", "seq", "segment", "pos")


@query(_SEGMENTS + "SELECT CAST(stream AS VARCHAR) || '-' || lpad(CAST(segment AS VARCHAR), 12, '0') AS segment_id, pos, to_base64(encode(event_type)) AS payload_b64 FROM r")
def sealed_segments(spark, sf_dir):
    """S8, K3, K4, W1, W2: the datagrams as a stream, cut into segments, sealed as files, and replayed as a stream to their end."""
    top = shared_folder(spark, "queue")
    rows = inputs.datagrams(spark, sf_dir).withColumn("payload_b64", transport.base64_text(F.col("payload"))).drop("payload")
    rows.write.parquet(f"{top}/in")
    stream = relay.stream_segments(spark.readStream.schema(rows.schema).parquet(f"{top}/in"))
    relay.seal_segments(stream, f"{top}/sealed", f"{top}/c1").awaitTermination()
    replayed = relay.replay(spark, f"{top}/sealed", 1000).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/c2")
    replayed.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(relay.SEGMENT_SCHEMA).parquet(f"{top}/out")


@query(f"SELECT {_TEXT.replace('n ', 'ip ')} || '/' || (event_id % 25 + 8) AS prefix, CAST(event_id AS VARCHAR) AS value FROM {_EVENT_IP}")
def prefix_snapshot(spark, sf_dir):
    """S12, P21: a text snapshot of prefixes and AS numbers, written and read."""
    path = f"{shared_folder(spark, 'snapshot')}/asns"
    line = F.concat(A.ipv4_text(F.col("ip")), F.lit("/"), F.expr("cast(event_id % 25 + 8 as string)"), F.lit(" "), F.col("event_id").cast("string"))
    inputs.with_ip(spark, sf_dir).select(line).write.text(path)
    return snapshots.read_snapshot(spark, path).select("prefix", "value")


@query(_v4_sql(_V4))
def lpm_added(spark, sf_dir):
    """A2, W5: prefixes added to a table are visible at once."""
    table = PrefixTable.of(inputs.prefixes(spark, inputs.V4_PREFIXES[3:])).add(inputs.prefixes(spark, inputs.V4_PREFIXES[:3]))
    return table.rebuild().lookup_number(inputs.with_ip(spark, sf_dir), "ip").select("event_id", F.col("value").alias("label"))


@query("SELECT segment_id, pos, payload_b64 FROM (SELECT strftime(make_timestamp((1700000000 + event_id // 100 * 300) * 1000000), '%Y-%m-%d.%H.%M.%S') AS segment_id, event_id % 100 AS pos, to_base64(encode(event_type)) AS payload_b64 FROM events) ORDER BY ALL")
def segment_replay_order(spark, sf_dir):
    created = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, 1700000000 + event_id div 100 * 300)")
    rows = inputs.events(spark, sf_dir).select(transport.segment_name(created).alias("segment_id"), F.expr("event_id % 100").alias("pos"), transport.base64_text(F.encode("event_type", "UTF-8")).alias("payload_b64"))
    return transport.replay_order(rows)


@query("SELECT event_id, least(length(t), 2048) AS n_bytes FROM (SELECT event_id, repeat(event_type, 1 + CAST(event_id % 500 AS INT)) AS t FROM events)")
def datagram_limit(spark, sf_dir):
    payload = F.encode(F.expr("repeat(event_type, cast(1 + event_id % 500 as int))"), "UTF-8")
    back = transport.decoded(transport.envelope(payload))
    return inputs.events(spark, sf_dir).select("event_id", F.octet_length(back).cast("bigint").alias("n_bytes"))


@query("""SELECT c_custkey AS file_id, CASE WHEN c_custkey % 10 > 0 THEN 42252 END AS magic, CASE WHEN c_custkey % 10 > 0 THEN 1 END AS version, CASE WHEN c_custkey % 10 > 0 THEN c_custkey % 16 END AS flags,
CASE WHEN c_custkey % 10 > 0 THEN c_custkey * 3 END AS num_blocks, CASE WHEN c_custkey % 10 > 0 THEN 'customer-' || c_custkey END AS ident FROM customer""")
def file_header(spark, sf_dir):
    return longs(inputs.header_files(spark, sf_dir).select("file_id", headers.header_fields(F.col("content")).alias("h")).select("file_id", "h.*"))


@query("""SELECT c_custkey AS file_id, CASE WHEN c_custkey % 10 > 0 THEN 'Magic:' || chr(9) || chr(9) || 'A50C' || chr(10) || 'Version:' || chr(9) || '1' || chr(10) || 'Flags:' || chr(9) || chr(9) || to_hex(c_custkey % 16)
|| chr(10) || 'NumBlocks:' || chr(9) || (c_custkey * 3) || chr(10) || 'StringIdent:' || chr(9) || 'customer-' || c_custkey END AS text FROM customer""")
def header_text(spark, sf_dir):
    return inputs.header_files(spark, sf_dir).select("file_id", headers.print_header(headers.header_fields(F.col("content"))).alias("text"))
