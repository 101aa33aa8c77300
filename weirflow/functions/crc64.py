"""CRC-64 (polynomial 42F0E1EBA9EA3693, most significant bit first, all ones in and out) over binary columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

POLYNOMIAL = 0x42F0E1EBA9EA3693


def crc_table() -> np.ndarray:
    """The remainder of each byte, from the polynomial: eight conditional subtractions a byte."""
    value = np.arange(256, dtype=np.uint64) << np.uint64(56)
    for _ in range(8):
        top = (value >> np.uint64(63)).astype(bool)
        value = (value << np.uint64(1)) ^ np.where(top, np.uint64(POLYNOMIAL), np.uint64(0))
    return value


def crc64_bytes(rows: list[bytes]) -> np.ndarray:
    """The CRC of each byte string, a byte position of all strings at a time."""
    table = crc_table()
    length = np.array([len(r) for r in rows], np.int64)
    width = int(length.max(initial=0))
    padded = np.zeros((len(rows), width), np.uint8)
    padded[np.arange(width) < length[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
    crc = np.full(len(rows), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(width):
        stepped = (crc << np.uint64(8)) ^ table[((crc >> np.uint64(56)) ^ padded[:, i]).astype(np.int64)]
        crc = np.where(i < length, stepped, crc)
    return ~crc


@F.pandas_udf(LongType())
def crc64(data: pd.Series) -> pd.Series:
    """The 64 bits of the CRC as a signed BIGINT; show them with hex(). Null stays null."""
    known = data.notna().to_numpy()
    out = pd.Series(np.zeros(len(data), np.int64), dtype="Int64")
    if known.any():
        out[known] = crc64_bytes([bytes(x) for x in data[known]]).view(np.int64)
    out[~known] = pd.NA
    return out


def reversed_bytes(data: Column, size: int) -> Column:
    """The first ``size`` bytes in reverse: a network-order number as a little-endian host holds it."""
    return F.concat(*[F.substring(data, i, 1) for i in range(size, 0, -1)])


def number_bytes(number: Column, size: int) -> Column:
    """A number's low ``size`` bytes, least significant first."""
    digits = F.lpad(F.hex(number.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))


def flow_id(src_ip6: Column, dst_ip6: Column, protocol: Column, src_port: Column, dst_port: Column) -> Column:
    """The compatible flow key: CRC-64 of the low halves of both addresses, protocol and ports, as a little-endian host lays them out.

    Missing ports count as 0. Hosts with equal interface ids in different networks share a key.
    """
    low = lambda ip: reversed_bytes(F.substring(ip, 9, 8), 8)
    port = lambda p: number_bytes(F.coalesce(p, F.lit(0)), 2)
    return crc64(F.concat(low(src_ip6), low(dst_ip6), number_bytes(protocol, 1), port(src_port), port(dst_port)))
