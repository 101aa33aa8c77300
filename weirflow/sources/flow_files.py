"""Flow files beyond their headers: a registry of record readers, and a reader of NetFlow version 5.

Record and extension-map layouts belong to external programs, so a reader is a
function that is registered by name: (spark, path, options) -> DataFrame. Built in is
``netflow5``: files of export datagrams of the published version 5 layout, one after
the other (a header of 24 bytes, then up to 30 records of 48 bytes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Reader = Callable[[SparkSession, str, dict], DataFrame]
#: The published layouts, fixed values.
HEADER = np.dtype([("version", ">u2"), ("count", ">u2"), ("uptime_ms", ">u4"), ("seconds", ">u4"), ("nanos", ">u4"), ("sequence", ">u4"), ("engine", ">u2"), ("sampling", ">u2")])
RECORD = np.dtype([
    ("src_ip4", ">u4"), ("dst_ip4", ">u4"), ("next_hop", ">u4"), ("input_interface", ">u2"), ("output_interface", ">u2"), ("packets", ">u4"), ("octets", ">u4"), ("first_ms", ">u4"), ("last_ms", ">u4"),
    ("src_port", ">u2"), ("dst_port", ">u2"), ("pad1", "u1"), ("tcp_flags", "u1"), ("protocol", "u1"), ("tos", "u1"), ("src_as", ">u2"), ("dst_as", ">u2"), ("src_mask", "u1"), ("dst_mask", "u1"), ("pad2", ">u2"),
])
_PLAIN = [n for n in RECORD.names if n not in ("first_ms", "last_ms", "pad1", "pad2")]
NETFLOW5 = "path string, sequence bigint, flow_start timestamp, flow_end timestamp, " + ", ".join(f"{n} bigint" for n in _PLAIN)


def read_netflow5(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """A row for each record of the files; what follows a datagram that is cut short or of another version is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at, parts = content.as_buffer(), 0, []
                while at + HEADER.itemsize <= len(data):
                    head = np.frombuffer(data, HEADER, 1, at)[0]
                    end = at + HEADER.itemsize + int(head["count"]) * RECORD.itemsize
                    if head["version"] != 5 or end > len(data):
                        break
                    rows = np.frombuffer(data, RECORD, int(head["count"]), at + HEADER.itemsize)
                    began = (int(head["seconds"]) * 1000 - int(head["uptime_ms"])) * 1000 + int(head["nanos"]) // 1000
                    times = [pa.array(began + rows[c].astype(np.int64) * 1000).cast(pa.timestamp("us", "UTC")) for c in ("first_ms", "last_ms")]
                    lead = [pa.array([name] * len(rows), pa.string()), pa.array(int(head["sequence"]) + np.arange(len(rows)))]
                    parts.append(pa.RecordBatch.from_arrays([*lead, *times, *[pa.array(rows[c].astype(np.int64)) for c in _PLAIN]], ["path", "sequence", "flow_start", "flow_end", *_PLAIN]))
                    at = end
                yield from parts

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, NETFLOW5)


_READERS: dict[str, Reader] = {"netflow5": read_netflow5}


def register_reader(name: str, reader: Reader) -> None:
    _READERS[name] = reader


def read_flow_file(spark: SparkSession, path: str, layout: str, **options: str) -> DataFrame:
    """The records of flow files, by the reader registered for their layout."""
    if layout not in _READERS:
        raise LookupError(f"no reader is registered for {layout!r}; known: {sorted(_READERS)}")
    return _READERS[layout](spark, path, options)
