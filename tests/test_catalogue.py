import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from weirflow.functions.packet_bytes import number_at
from weirflow.plans import catalogue, inputs


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_oracle(spark, sf_dir, duck, name):
    frame = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLES:
        same_rows(frame, duck.execute(catalogue.ORACLES[name]))
    else:
        assert frame.count() > 0


def test_a_snap_length_query_covers_every_packet(spark, sf_dir):
    packets = inputs.packets(spark, sf_dir).withColumn("whole", number_at(F.col("data"), 34, 2))
    rows = packets.join(catalogue.QUERIES["snap_length_all"](spark, sf_dir), "packet_id").collect()
    assert len(rows) == packets.count() and {r.packet_id % 8 for r in rows} == set(range(8))
    assert all(r.port is None and r.whole is not None for r in rows)


@pytest.fixture(scope="module")
def colliding(tmp_path_factory):
    """Events whose users give the ports of AYIYA (5072) and Teredo (3544) to frames of every kind: (folder, DuckDB connection)."""
    import duckdb

    top, con = tmp_path_factory.mktemp("colliding"), duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, [2520, 4048, 7, 9048, 7520][1 + i // 24 % 5] AS user_id, 'view' AS event_type, 1.0 AS value, '' AS props FROM range(480) t(i)")
    con.execute(f"COPY events TO '{top}/events.parquet' (FORMAT parquet)")
    return str(top), con


_OF_PACKETS = ["flow_aggregate", "flow_id_crc64", "flow_records", "ipv6_header", "l4_ports_icmp", "label_tunnel_ends", "packet_rate", "snap_length", "template_export", "template_route", "teredo_accept", "tunnel_mix"]
_OF_HARD_PACKETS = ["extension_headers", "hard_flow_records", "teredo_verdicts"]


@pytest.mark.parametrize("name", _OF_PACKETS + _OF_HARD_PACKETS)
def test_query_equals_its_oracle_where_a_port_is_a_tunnels(spark, colliding, name):
    top, con = colliding
    same_rows(catalogue.QUERIES[name](spark, top), con.execute(catalogue.ORACLES[name]))


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
