"""Unsigned big-endian numbers from packet bytes, at fixed or computed offsets.

All work on the binary column itself, where a slice costs its own length only; a
number that isn't whole inside it is null, so every guard is strict.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def captured(data: Column, caplen: Column | None = None) -> Column:
    """The captured bytes; those beyond ``caplen`` are invisible."""
    return data if caplen is None else F.substring(data, F.lit(1), F.coalesce(caplen.cast("int"), F.octet_length(data)))


def _column(value: Column | int | str) -> Column:
    """A column of an offset or, given as a name, of the bytes."""
    return F.lit(value) if isinstance(value, int) else F.col(value) if isinstance(value, str) else value


def holds(data: Column | str, offset: Column | int, size: Column | int) -> Column:
    """Whether ``size`` bytes from ``offset`` on were captured."""
    return F.coalesce(_column(offset) + size <= F.octet_length(_column(data)), F.lit(False))


def bytes_at(data: Column | str, offset: Column | int, size: int) -> Column:
    """``size`` bytes from a non-negative offset on, or null. The offset is named twice only: expressions stay small."""
    piece = F.substring(_column(data), (_column(offset) + 1).cast("int"), F.lit(size))
    return F.when(F.octet_length(piece) == size, piece)


def hex_at(data: Column | str, offset: Column | int, size: int) -> Column:
    """The upper-case hex of ``size`` bytes, or null."""
    return F.hex(bytes_at(data, offset, size))


def number_at(data: Column | str, offset: Column | int, size: int) -> Column:
    """The unsigned number of ``size`` (up to 7) bytes as BIGINT, or null."""
    return F.conv(hex_at(data, offset, size), 16, 10).cast("bigint")
