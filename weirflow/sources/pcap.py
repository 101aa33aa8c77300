"""A batch data source of offline capture files: spark.read.format("pcap").load(path).

Options: path (a file, a folder or a glob; a path of any file system that Arrow knows,
as file:, hdfs:, s3: or gs:), chunk_mb. The driver only lists files and their sizes; a
file is split into ranges of bytes. A task finds the first packet of its range by
itself: the first place from which LOOK packet headers in a row, or all to the file's
end, make sense. packet_id is the file's number times 2**40 plus the packet's place in
it, so it is unique and in the order of the files. Link types other than Ethernet raise
an error; a last packet that wasn't written in full is left out.
"""

from __future__ import annotations

import datetime
import fnmatch
import os
import struct
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: First four bytes of a file: (byte order, fraction of a second in nanoseconds); fixed values of the format.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
FILE_HEADER, PACKET_HEADER, ETHERNET = 24, 16, 1
#: Packet headers that must follow one another to be believed; bytes read at a time; bytes of a packet at most, and
#: seconds between neighbours at most.
LOOK, READ, LARGEST, APART = 16, 4 << 20, 1 << 18, 86_400


class PcapRange(InputPartition):
    def __init__(self, path: str, number: int, start: int, end: int) -> None:
        self.path, self.number, self.start, self.end = path, number, start, end


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files of a file, folder or glob, in order of their names; metadata only."""
    system, inside = pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path.removeprefix('file:'))}")
    lead = path[: len(path) - len(inside)] if "://" in path else ""
    if any(c in inside for c in "*?["):
        top = os.path.dirname(inside[: min(inside.index(c) for c in "*?[" if c in inside)] + "x")
        found = [f for f in system.get_file_info(pafs.FileSelector(top, recursive=True)) if fnmatch.fnmatch(f.path, inside) and f.path.count("/") == inside.count("/")]
    else:
        info = system.get_file_info(inside)
        found = system.get_file_info(pafs.FileSelector(inside)) if info.type == pafs.FileType.Directory else [info]
    return [(lead + f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File]


def opened(path: str):
    system, inside = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system.open_input_file(inside)


class PcapReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = listed(options["path"])
        if not self.files:
            raise FileNotFoundError(options["path"])
        self.chunk = max(1, int(float(options.get("chunk_mb", "64")) * 1e6))

    def partitions(self) -> list[InputPartition]:
        out = [PcapRange(path, k, a, min(a + self.chunk, size)) for k, (path, size) in enumerate(self.files) for a in range(FILE_HEADER, size, self.chunk)]
        return out or [PcapRange(self.files[0][0], 0, 0, 0)]

    def read(self, partition: PcapRange) -> Iterator[tuple]:
        if partition.end == 0:
            return
        with opened(partition.path) as file:
            size = file.size()
            head = file.read(FILE_HEADER)
            order, unit = order_of(partition.path, head[:4])
            link = struct.unpack(f"{order}I", head[20:24])[0] & 0x0FFFFFFF if len(head) == FILE_HEADER else ETHERNET
            if link != ETHERNET:
                raise ValueError(f"{partition.path} holds link type {link}, not Ethernet")
            at = partition.start if partition.start == FILE_HEADER else first_packet(file, order, unit, partition.start, partition.end, size)
            held, base = b"", at
            while at < partition.end and at + PACKET_HEADER <= size:
                if at + PACKET_HEADER > base + len(held):
                    held, base = read_at(file, at, READ), at
                seconds, part, length, _ = struct.unpack_from(f"{order}IIII", held, at - base)
                if at + PACKET_HEADER + length > size:
                    return  # the last packet wasn't written in full
                if at + PACKET_HEADER + length > base + len(held):
                    held, base = read_at(file, at, max(READ, PACKET_HEADER + length)), at
                moment = datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc) + datetime.timedelta(microseconds=part * unit // 1000)
                body = at - base + PACKET_HEADER
                yield (partition.number << 40) + at, moment, length, held[body : body + length]
                at += PACKET_HEADER + length


def read_at(file, at: int, size: int) -> bytes:
    file.seek(at)
    return file.read(size)


def first_packet(file, order: str, unit: int, start: int, end: int, size: int) -> int:
    """The place of the first packet header in [start, end), or ``end``."""

    def sensible(at: int) -> tuple[int, int] | None:
        """(seconds, next place) of a header that makes sense by itself."""
        nonlocal held, base
        if not base <= at <= base + len(held) - PACKET_HEADER:
            held, base = read_at(file, at, READ), at
        seconds, part, length, whole = struct.unpack_from(f"{order}IIII", held, at - base)
        if part * unit >= 1_000_000_000 or length > whole or whole > LARGEST:
            return None
        return seconds, at + PACKET_HEADER + length

    held, base = read_at(file, start, READ), start
    for at in range(start, min(end, size - PACKET_HEADER + 1)):
        place, last = at, None
        for _ in range(LOOK):
            if place + PACKET_HEADER > size:  # what may be cut at the end
                break
            found = sensible(place)
            if found is None or last is not None and abs(found[0] - last) > APART:
                place = -1
                break
            last, place = found
        if place >= 0:
            return at
    return end


def order_of(path: str, magic: bytes) -> tuple[str, int]:
    if magic not in MAGIC:
        raise ValueError(f"{path} is no capture file")
    return MAGIC[magic]


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return "packet_id bigint, ts timestamp, caplen int, data binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PcapReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)
