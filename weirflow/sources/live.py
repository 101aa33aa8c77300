"""Streaming sources of datagrams, lines and live captures, as Python data sources.

``udp_datagrams`` reads a UDP port, ``live_packets`` a network interface (Linux, with
the right to open raw sockets). Both number what they receive and keep it until
Spark commits the batch, so a batch that is repeated gives the same rows. With the
option ``log``, a folder that outlives the driver, each batch is written there before
Spark hears of it, and read again after a restart; without it a restart raises an error
where rows that were promised are gone. They read in the driver: a single socket can't
be split.
"""

from __future__ import annotations

import datetime
import os
import pickle
import select
import socket
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

DATAGRAM_BYTES, SNAP_LENGTH = 2048, 1000


class SocketReader(SimpleDataSourceStreamReader):
    """Numbers what arrives at a socket; what isn't committed yet stays in memory and in the log, if there is one."""

    def __init__(self, options: dict) -> None:
        self.wait = float(options.get("wait_s", "0.05"))
        self.most = int(options.get("max_rows", "10000"))
        self.options = options
        self.sock: socket.socket | None = None
        self.kept: dict[int, tuple] = {}
        self.log = options.get("log")
        if self.log:
            os.makedirs(self.log, exist_ok=True)
            for name in sorted(x for x in os.listdir(self.log) if x.endswith(".rows")):
                with open(os.path.join(self.log, name), "rb") as file:
                    rows = pickle.load(file)  # written by this class alone
                self.kept |= {row[0]: row for row in rows}

    def _write(self, rows: list[tuple]) -> None:
        path = os.path.join(self.log, f"{rows[0][0]:020d}-{rows[-1][0] + 1:020d}")
        with open(path, "wb") as file:
            pickle.dump(rows, file)
            file.flush()
            os.fsync(file.fileno())
        os.rename(path, path + ".rows")

    def open(self) -> socket.socket:
        raise NotImplementedError

    def row(self, number: int, moment: datetime.datetime, data: bytes, size: int) -> tuple:
        raise NotImplementedError

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.sock is None:
            self.sock = self.open()
        number = start["n"]
        if number in self.kept:  # received before a restart, but not part of a batch yet
            rows = []
            while number in self.kept and len(rows) < self.most:
                rows.append(self.kept[number])
                number += 1
            return iter(rows), {"n": number}
        rows, end = [], time.monotonic() + self.wait
        while len(rows) < self.most and (left := end - time.monotonic()) > 0:
            if not select.select([self.sock], [], [], left)[0]:
                break
            data = self.sock.recv(65_535)
            row = self.row(number, datetime.datetime.now(datetime.timezone.utc), data, len(data))
            self.kept[number] = row
            rows.append(row)
            number += 1
        if rows and self.log:
            self._write(rows)
        return iter(rows), {"n": number}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        lost = [i for i in range(start["n"], end["n"]) if i not in self.kept]
        if lost:
            raise RuntimeError(f"rows {lost[0]} to {lost[-1]} were received before a restart and are gone; set the option log")
        return iter([self.kept[i] for i in range(start["n"], end["n"])])

    def commit(self, end: dict) -> None:
        for i in [i for i in self.kept if i < end["n"]]:
            del self.kept[i]
        if self.log:
            for name in os.listdir(self.log):
                if name.endswith(".rows") and int(name.removesuffix(".rows").split("-")[1]) <= end["n"]:
                    os.remove(os.path.join(self.log, name))


class DatagramReader(SocketReader):
    def open(self) -> socket.socket:
        sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        sock.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        sock.bind((self.options.get("host", "0.0.0.0"), int(self.options["port"])))
        return sock

    def row(self, number: int, moment: datetime.datetime, data: bytes, size: int) -> tuple:
        return number, moment, data[:DATAGRAM_BYTES]


class PacketReader(SocketReader):
    def open(self) -> socket.socket:
        if not hasattr(socket, "AF_PACKET"):
            raise OSError("live capture needs Linux packet sockets")
        sock = socket.socket(socket.AF_PACKET, socket.SOCK_RAW, socket.ntohs(0x0003))
        sock.bind((self.options["interface"], 0))
        return sock

    def row(self, number: int, moment: datetime.datetime, data: bytes, size: int) -> tuple:
        snap = int(self.options.get("snap_length", SNAP_LENGTH))
        return number, moment, min(size, snap), data[:snap]


class DatagramSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "udp_datagrams"

    def schema(self) -> str:
        return "seq bigint, recv_ts timestamp, payload binary"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return DatagramReader(self.options)


class PacketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_packets"

    def schema(self) -> str:
        return "packet_id bigint, ts timestamp, caplen int, data binary"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return PacketReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DatagramSource)
    spark.dataSource.register(PacketSource)


def read_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a TCP connection, by Spark's own socket source (for tests and trials: it can't replay)."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load().withColumnRenamed("value", "line")
