import base64
import datetime
import os
import socket
import struct
import threading

from pyspark.sql import functions as F

from weirflow.operators import transport
from weirflow.sources import flow_files, headers, live, pcap, snapshots
from weirflow.streaming import relay


def test_statuses(spark):
    cases = [
        ("D AAEC", False, 200), ("D AAEC", True, 430), ("DE AAEC", False, 420), ("DE AAEC", True, 200), ("X AAEC", True, 510), ("", False, 510),
        ("   ", False, 510), ("D", False, 410), ("  D  AAEC  ", False, 200), ("D ?*", False, 410), ("D ?A*A EC", False, 200), ("D AA=EC", False, 200), (None, False, 510),
    ]
    frame = spark.createDataFrame([(i, line, key) for i, (line, key, _) in enumerate(cases)], "i long, line string, has_key boolean")
    rows = frame.select("i", transport.status(F.col("line"), F.col("has_key")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == [s for _, _, s in cases]
    lost = frame.filter("i = 0").select(transport.status(F.col("line"), F.col("has_key"), F.lit(False)).alias("s")).first()
    assert lost.s == 410
    answers = frame.limit(1).select(transport.reply(F.lit(200)).alias("a")).select("a", transport.acknowledged(F.col("a")).alias("ok")).first()
    assert answers == ("200 OK", True)


def test_envelopes_round_trip(spark):
    data = [b"", b"x", os.urandom(500), os.urandom(3000)]
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i long, payload binary")
    for key in (None, "secret"):
        line = transport.envelope(F.col("payload"), key)
        for r in frame.select("payload", line.alias("line"), transport.decoded(line, key).alias("back")).collect():
            assert bytes(r.back) == bytes(r.payload)[:2048] and "\n" not in r.line and "\r" not in r.line
            if key is None:
                assert r.line == "D " + base64.b64encode(bytes(r.payload)[:2048]).decode()
    assert frame.select(transport.decoded(transport.envelope(F.col("payload"), "a"), "b").alias("x")).filter("x is not null").count() == 0


def test_lenient_base64_and_words(spark):
    cases = [
        (b"D " + base64.b64encode(bytes(range(n))), bytes(range(n))) for n in range(6)
    ] + [
        (b"D AAE", b"\x00\x01"), (b"D AAECA", b"\x00\x01\x02"), (b"D A", b""), (b"D =AAEC", b""), (b"D A?A-E\xc3\xa9C", b"\x00\x01\x02"), (b"D A?AECA", b"\x00\x01\x02"),
        (b"\x0b\f D\x0b\tAAEC rest of it", b"\x00\x01\x02"), (b"D", b""), (b"X AAEC", None), (b"", None),
    ]
    frame = spark.createDataFrame([(i, line.decode()) for i, (line, _) in enumerate(cases)], "i long, line string")
    rows = frame.select("i", transport.decoded(F.col("line")).alias("back")).orderBy("i").collect()
    assert [None if r.back is None else bytes(r.back) for r in rows] == [back for _, back in cases]


def test_a_line_is_computed_once(spark):
    frame = spark.createDataFrame([(b"x" * 9,)], "payload binary")
    line = transport.envelope(F.col("payload"))
    for use in (transport.decoded(line), transport.status(line, F.lit(False))):
        plan = frame.select(use.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("substring(payload") == 1


def test_backoff(spark):
    assert [r.delay_s for r in transport.backoff(spark, 7).orderBy("attempt").collect()] == [1, 3, 9, 27, 81, 243, 243]
    assert [transport.next_delay(*x) for x in ((None, 0), (1, 5), (243, 5), (27, 3601))] == [1, 3, 243, 1]


ARRIVALS = [(0, False), (1, False), (3, True), (4, False), (5, True), (124, True), (125, True), (126, True), (247, True), (248, False)]


def test_segments_cut_by_age_and_backlog(spark):
    expected = list(transport.cuts(iter(ARRIVALS)))
    assert expected[:4] == [(0, 0), (0, 1), (0, 2), (0, 3)] and expected[4] == (1, 0)
    assert [s for s, _ in transport.cuts(iter([(0, True), (120, True), (121, True), (122, True)]))] == [0, 0, 0, 1]
    t0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(s, i, t0 + datetime.timedelta(seconds=a), b, b"x") for s in ("a", "b") for i, (a, b) in enumerate(ARRIVALS)]
    frame = spark.createDataFrame(rows, "stream_id string, seq long, recv_ts timestamp, backlog boolean, payload binary")
    found = transport.queue_segments(frame).orderBy("stream_id", "seq").collect()
    assert [(r.segment, r.pos) for r in found] == expected * 2


def test_streamed_segments_agree_over_batches(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    schema = "stream_id string, seq long, recv_ts timestamp, backlog boolean, payload_b64 string"
    for k, part in enumerate((ARRIVALS[:4], ARRIVALS[4:])):
        rows = [("a", 4 * k + i, t0 + datetime.timedelta(seconds=a), b, "eA==") for i, (a, b) in enumerate(part)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = relay.seal_segments(relay.stream_segments(stream), str(tmp_path / "queue"), str(tmp_path / "c1"))
    query.awaitTermination()
    sealed = spark.read.parquet(str(tmp_path / "queue"))
    found = [(int(r.segment_id.split("-")[1]), r.pos) for r in transport.replay_order(sealed).collect()]
    assert found == sorted(transport.cuts(iter(ARRIVALS)))

    sent, failures = [], [2]

    def deliver(lines):
        done = 0
        for line in lines:
            if failures and done == failures[0]:
                failures.pop()
                return done
            sent.append(line)
            done += 1
        return done

    naps = []
    relay.send(relay.replay(spark, str(tmp_path / "queue"), 100), str(tmp_path / "c2"), deliver, sleep=naps.append).awaitTermination()
    assert len(sent) == len(ARRIVALS) and set(sent) == {"D eA=="} and naps == [1]
    relay.send(relay.replay(spark, str(tmp_path / "queue"), 100), str(tmp_path / "c2"), deliver).awaitTermination()
    assert len(sent) == len(ARRIVALS)  # nothing is sent again after the checkpoint


def test_exchange_waits_for_each_reply():
    server = socket.create_server(("127.0.0.1", 0))
    got = []

    def serve():
        client, _ = server.accept()
        with client, client.makefile("rw", newline="\n") as file:
            for line in file:
                got.append(line.strip())
                file.write("200 OK\n" if len(got) < 3 else "410 Cannot pass data to collector.\n")
                file.flush()

    threading.Thread(target=serve, daemon=True).start()
    assert relay.exchange("127.0.0.1", server.getsockname()[1], iter(["D a", "D b", "D c", "D d"])) == 2
    assert got == ["D a", "D b", "D c"]


def test_forward_and_receive_datagrams(spark, tmp_path):
    sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    sock.bind(("127.0.0.1", 0))
    sock.settimeout(10)
    frame = spark.createDataFrame([(b"abc",), (b"",)], "payload binary")
    assert sorted(r.delivered for r in relay.forward(frame, "127.0.0.1", sock.getsockname()[1]).collect()) == [False, True]
    assert sock.recv(100) == b"abc"

    reader = live.DatagramReader({"port": "0", "host": "127.0.0.1", "wait_s": "2", "max_rows": "2"})
    reader.sock = reader.open()
    port = reader.sock.getsockname()[1]
    for part in (b"x" * 3000, b"y"):
        sock.sendto(part, ("127.0.0.1", port))
    rows, end = reader.read(reader.initialOffset())
    assert [len(r[2]) for r in rows] == [2048, 1] and end == {"n": 2}
    assert [r[0] for r in reader.readBetweenOffsets({"n": 1}, end)] == [1]
    reader.commit(end)
    assert not reader.kept


def test_receiver_answers_forwards_and_logs(spark, tmp_path):
    from weirflow.streaming import receiver

    got = []
    lines = ["D " + base64.b64encode(b"abc").decode(), "DE AAEC", "X y", "", "D", "D ?*", "D QU?I=Q"]
    with receiver.Receiver(lambda data: got.append(data) or True) as server, socket.create_connection(("127.0.0.1", server.port)) as sock:
        answers = sock.makefile("r", newline="\n")
        codes = []
        for line in lines:
            sock.sendall(line.encode() + b"\n")
            codes.append(answers.readline().strip())
    assert [int(c[:3]) for c in codes] == [200, 420, 510, 510, 410, 410, 200] and got == [b"abc", b"AB"]
    assert codes == [transport.REPLIES[int(c[:3])] for c in codes]

    # The same rules as the columns', and encrypted lines that Spark wrote.
    frame = spark.createDataFrame([(x,) for x in lines], "line string").select("line", transport.status(F.col("line"), F.lit(False)).alias("s"))
    assert [r.s for r in frame.collect()] == [int(c[:3]) for c in codes]
    sealed = spark.createDataFrame([(b"hidden",)], "payload binary").select(transport.envelope(F.col("payload"), "secret").alias("line")).first().line
    with receiver.Receiver(receiver.log_to(str(tmp_path / "log")), receiver.decrypter(spark, "secret")) as server:
        assert relay.exchange("127.0.0.1", server.port, iter([sealed, sealed])) == 2
        assert relay.exchange("127.0.0.1", server.port, iter(["DE AAEC", sealed])) == 0
        assert relay.exchange("127.0.0.1", server.port, iter(["D AAEC"])) == 0
    stream = receiver.received(spark, str(tmp_path / "log")).writeStream.format("memory").queryName("got").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert [bytes(r.payload) for r in spark.table("got").collect()] == [b"hidden"] * 2


def test_live_rows_survive_a_restart(tmp_path):
    options = {"port": "0", "host": "127.0.0.1", "wait_s": "2", "max_rows": "2", "log": str(tmp_path / "log")}
    reader = live.DatagramReader(options)
    reader.sock = reader.open()
    sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for part in (b"a", b"b"):
        sock.sendto(part, ("127.0.0.1", reader.sock.getsockname()[1]))
    rows, end = reader.read(reader.initialOffset())
    rows = list(rows)
    again = live.DatagramReader(options)
    assert list(again.readBetweenOffsets({"n": 0}, end)) == rows
    assert (lambda x: (list(x[0]), x[1]))(again.read({"n": 0})) == (rows, end)
    again.commit(end)
    assert not os.listdir(tmp_path / "log")
    try:
        live.DatagramReader({"port": "0"}).readBetweenOffsets({"n": 0}, end)
        raise AssertionError("lost rows")
    except RuntimeError:
        pass


def test_debug_levels(spark, caplog):
    from weirflow.streaming import logs

    logs.set_debug(1)
    with caplog.at_level("DEBUG", logger="weirflow"):
        logs.set_debug(1)
        logs.debug(1, "seen %s", 1)
        logs.debug(2, "hidden")
        logs.ProgressListener().onQueryStarted(type("E", (), {"id": "q"}))
    logs.set_debug(0)
    assert [r.message for r in caplog.records] == ["seen 1", "query q started"]
    spark.streams.removeListener(logs.listen(spark))


def test_cut_runs_equal_cuts_one_by_one():
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(50):
        times = np.cumsum([rng.choice([0, 0.5, 1, 1.5, 30, 130]) for _ in range(rng.randint(1, 200))])
        waits = np.array([rng.random() < 0.7 for _ in times])
        split = rng.randint(0, len(times) - 1)
        state, found = (0, 0, None), []
        for part in (slice(0, split), slice(split, None)):
            if len(times[part]):
                a, b, state = transport.cut_run(times[part], waits[part], state)
                found += zip(a.tolist(), b.tolist(), strict=True)
        assert found == list(transport.cuts(iter(zip(times.tolist(), waits.tolist(), strict=True))))


def test_headers(spark, tmp_path):
    content = struct.pack("<HHII128s", 0xA50C, 1, 2, 77, b"name")
    for name, data in (("whole", content + b"more"), ("short", content[:139]), ("none", b"")):
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r.header for r in headers.read_headers(spark, str(tmp_path)).collect()}
    assert tuple(rows["whole"]) == (0xA50C, 1, 2, 77, "name") and rows["short"] is None and rows.get("none") is None
    text = headers.head(spark, ["-r", str(tmp_path / "whole")])
    assert text.split("\n")[0] == "Magic:\t\tA50C" and text.split("\n")[3:] == ["NumBlocks:\t77", "StringIdent:\tname"]
    for wrong in (["-x", "f"], ["-r"]):
        try:
            headers.head(spark, wrong)
            raise AssertionError(wrong)
        except ValueError:
            pass


def test_capture_files(spark, tmp_path):
    pcap.register(spark)
    for order, name in (("<", "a.pcap"), (">", "b.pcap")):
        body = b"".join(struct.pack(f"{order}IIII", 1_700_000_000 + i, 250_000, i, 60) + bytes([i]) * i for i in range(5))
        (tmp_path / name).write_bytes(struct.pack(f"{order}IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + body + b"cut")
    frame = spark.read.format("pcap").option("chunk_mb", "0.00004").load(str(tmp_path / "*.pcap"))
    rows = frame.orderBy("packet_id").collect()
    assert [(r.packet_id >> 40, r.caplen, bytes(r.data)) for r in rows] == [(f, i, bytes([i]) * i) for f in range(2) for i in range(5)]
    assert frame.rdd.getNumPartitions() > 2 and rows[1].ts.microsecond == 250_000
    (tmp_path / "c.raw").write_bytes(struct.pack("<IHHiIIIIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101, 1, 0, 0, 0))
    try:
        spark.read.format("pcap").load(str(tmp_path / "c.raw")).collect()
        raise AssertionError("link type")
    except Exception as error:
        assert "link type 101" in str(error)


def test_captures_split_anywhere_give_each_packet_once(tmp_path):
    import random

    rng = random.Random(9)
    sizes = [rng.choice([0, 14, 60, 60, 1500, 400]) for _ in range(300)]
    bodies = [rng.randbytes(n) for n in sizes]
    data = b"".join(struct.pack("<IIII", 1_700_000_000 + i // 50, rng.randrange(10**6), len(b), len(b)) + b for i, b in enumerate(bodies))
    (tmp_path / "x.pcap").write_bytes(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + data + b"tail")
    for chunk in ("0.0005", "0.003", "0.05", "1"):
        reader = pcap.PcapReader({"path": str(tmp_path), "chunk_mb": chunk})
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert [r[3] for r in rows] == bodies and len({r[0] for r in rows}) == 300


def test_snapshots_and_registry(spark, tmp_path):
    (tmp_path / "asns.txt").write_text("1.0.0.0/24 13335\n::/0 1\n\n1.0.0.0/24 2\n")
    rows = snapshots.read_snapshot(spark, str(tmp_path / "asns.txt")).orderBy("seq").collect()
    assert [(r.prefix, r.value) for r in rows] == [("1.0.0.0/24", "13335"), ("::/0", "1"), ("1.0.0.0/24", "2")]
    flow_files.register_reader("own", lambda s, path, options: s.createDataFrame([(path, options["x"])], "p string, x string"))
    assert flow_files.read_flow_file(spark, "f", "own", x="1").first() == ("f", "1")


def test_netflow5_files(spark, tmp_path):
    def datagram(sequence, ports):
        head = struct.pack(">HHIIIIHH", 5, len(ports), 60_000, 1_700_000_060, 5000, sequence, 0, 0)
        return head + b"".join(struct.pack(">IIIHHIIIIHHBBBBHHBBH", 0x0A000001, 0x0A000002, 0, 1, 2, 3, 120, 1000, 2000, p, 80, 0, 0x12, 6, 0, 7, 8, 24, 16, 0) for p in ports)

    (tmp_path / "flows").write_bytes(datagram(10, [1, 2]) + datagram(12, [3]) + datagram(13, [4])[:-1])
    rows = flow_files.read_flow_file(spark, str(tmp_path / "flows"), "netflow5").orderBy("sequence").collect()
    assert [(r.sequence, r.src_port, r.octets, r.protocol, r.src_ip4, r.dst_as) for r in rows] == [(10, 1, 120, 6, 0x0A000001, 8), (11, 2, 120, 6, 0x0A000001, 8), (12, 3, 120, 6, 0x0A000001, 8)]
    assert (rows[0].flow_end - rows[0].flow_start).total_seconds() == 1 and rows[0].flow_start.microsecond == 5
