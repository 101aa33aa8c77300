"""The record relay as streams: queue segments on disk, replay in order, acknowledged sending and forwarding.

Delivery is at least once: a record leaves the queue only by the checkpoint of a
batch whose every record was acknowledged; a repeated batch sends the same records.
"""

from __future__ import annotations

import logging
import socket
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weirflow.operators import transport

log = logging.getLogger("weirflow.relay")
CONNECT_S, REPLY_S = 5, 60
SEGMENT_SCHEMA = "segment_id string, pos bigint, payload_b64 string"


def stream_segments(datagrams: DataFrame) -> DataFrame:
    """A stream of stream_id, seq, recv_ts, backlog and payload_b64 with segment and pos.

    The state of a stream is its segment, position and the time of its last cut.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # A batch's frames of a stream come in no order, so they are held together; the source bounds a batch (max_rows, maxFilesPerTrigger).
        parts = list(frames)
        keys = pd.concat([x[["seq", "recv_ts", "backlog"]] for x in parts], ignore_index=True)
        order = keys["seq"].argsort(kind="stable").to_numpy()
        before = (*state.get[:2], state.get[2]) if state.exists else (0, 0, None)
        times = keys["recv_ts"].to_numpy("datetime64[us]").astype("int64")[order] / 1e6
        segments, positions, after = transport.cut_run(times, keys["backlog"].fillna(False).to_numpy(bool)[order], before)
        back = order.argsort(kind="stable")
        segments, positions = segments[back], positions[back]
        state.update((int(after[0]), int(after[1]), float(after[2])))
        at = 0
        for part in parts:
            yield part[["stream_id", "seq", "recv_ts", "backlog", "payload_b64"]].assign(segment=segments[at : at + len(part)], pos=positions[at : at + len(part)])
            at += len(part)

    out = "stream_id string, seq bigint, recv_ts timestamp, backlog boolean, payload_b64 string, segment bigint, pos bigint"
    return datagrams.groupBy("stream_id").applyInPandasWithState(step, out, "segment bigint, pos bigint, began double", "append", GroupStateTimeout.NoTimeout)


def seal_segments(segmented: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes segmented records as files; the sink's commit log makes a batch's files visible all at once."""
    named = segmented.select(F.concat_ws("-", "stream_id", F.lpad(F.col("segment").cast("string"), 12, "0")).alias("segment_id"), "pos", "payload_b64")
    return named.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Sealed segments as a stream, ``files`` files a batch."""
    return spark.readStream.schema(SEGMENT_SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def exchange(host: str, port: int, lines: Iterator[str]) -> int:
    """Sends lines one after the other, each after the reply 200 to the one before; how many were acknowledged."""
    done = 0
    with socket.create_connection((host, port), CONNECT_S) as sock:
        sock.settimeout(REPLY_S)
        answers = sock.makefile("r", encoding="ascii", newline="\n")
        for line in lines:
            sock.sendall(line.encode() + b"\n")
            if answers.readline().rstrip("\n") != transport.REPLIES[200]:
                break
            done += 1
    return done


def send(records: DataFrame, checkpoint: str, deliver: Callable[[Iterator[str]], int], key: str | None = None, attempts: int = 8, sleep: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Sends each batch's records in order through ``deliver`` (as exchange() with a host and port), with growing delays.

    The one connection keeps the order, so a batch passes the driver row by row, not as a whole.
    """

    def batch(frame: DataFrame, number: int) -> None:
        line = transport.envelope(transport.base64_bytes(F.col("payload_b64")), key)
        ordered = frame.orderBy("segment_id", "pos").select(line.alias("line"))
        done, delay, total = 0, None, frame.count()
        for attempt in range(attempts):
            began = time.monotonic()
            try:
                waiting = (r.line for i, r in enumerate(ordered.toLocalIterator()) if i >= done)  # noqa: B023
                done += deliver(waiting)
            except OSError as error:
                log.warning("batch %s, attempt %s: %s", number, attempt, error)
            if done >= total:
                return
            delay = transport.next_delay(delay, time.monotonic() - began)
            sleep(delay)
        raise ConnectionError(f"batch {number}: {done} of {total} records were acknowledged")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def forward(payloads: DataFrame, host: str, port: int) -> DataFrame:
    """Sends each payload as a datagram from the executors; delivered says whether it went out whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as sock:
            for frame in frames:
                sent = []
                for payload in frame["payload"]:
                    try:
                        sent.append(bool(payload) and sock.sendto(bytes(payload), (host, port)) > 0)
                    except OSError:
                        sent.append(False)
                yield frame.assign(delivered=sent)

    return payloads.mapInPandas(run, payloads.select("*", F.lit(True).alias("delivered")).schema)


def flows_by_window(records: DataFrame, late: str = "2 minutes", width: str = "1 minute") -> DataFrame:
    """Packets and octets of a stream of flow records by time window and tunnel; what is later than ``late`` is left out."""
    return (
        records.withWatermark("flow_start", late)
        .groupBy(F.window("flow_start", width), "tunnel_type")
        .agg(F.sum("packets").alias("packets"), F.sum("octets").alias("octets"))
    )
