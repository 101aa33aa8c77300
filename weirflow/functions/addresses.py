"""IP addresses and prefixes as columns.

IPv4 works in built-in functions. IPv6 texts are read and written over Arrow
batches: the nested array functions that it takes otherwise run uncompiled, more
than ten times slower.

An address of either family is a struct (family, hi, lo): family 4 keeps its 32
bits at the top of hi, family 6 its 128 bits in hi and lo. So the first bits of
both are masked in the same way, and keys are longs that hash joins compare fast.

Texts are strict: four decimal numbers without leading zeros for IPv4, RFC 4291 for
IPv6 (with ``::`` and an IPv4 tail). Anything else is null.
"""

from __future__ import annotations

import socket

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

ADDRESS = "struct<family:int,hi:bigint,lo:bigint>"
PREFIX = "struct<family:int,plen:int,hi:bigint,lo:bigint>"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"


def format_addr(text: Column) -> Column:
    """The 4 or 16 network-order bytes of an address text of either family; null for null or malformed text."""
    return text_bytes(text)


def ipv4_number(text: Column) -> Column:
    """The 32 bits of a dotted quad as BIGINT, or null."""
    part = F.split(text, r"\.")
    octet = lambda i: F.get(part, F.lit(i)).cast("bigint")
    number = F.shiftleft(octet(0), 24) + F.shiftleft(octet(1), 16) + F.shiftleft(octet(2), 8) + octet(3)
    return F.when(text.rlike(rf"\A{_QUAD}\z"), number)


def ipv4_text(number: Column) -> Column:
    """A dotted quad of a BIGINT's low 32 bits."""
    octet = lambda shift: F.shiftright(number, shift).bitwiseAND(F.lit(255)).cast("string")
    return F.when(number.isNotNull(), F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)))


def _long(hex16: Column) -> Column:
    """The signed long with these 16 hex digits."""
    return F.conv(hex16, 16, -10).cast("bigint")


@F.arrow_udf(BinaryType())
def text_bytes(text: pa.Array) -> pa.Array:
    """The 4 or 16 network-order bytes of an address text of either family, or null."""
    return parse_addresses(text)


def parse_addresses(texts: pa.Array) -> pa.Array:
    """Both families at once over the texts' bytes, without a Python object for each; IPv6 texts with an IPv4 tail are read one by one."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    colons, dots = np.bincount(owner, data == 58, minlength=n), np.bincount(owner, data == 46, minlength=n)
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    four, six = known & (colons == 0) & (dots == 3) & (size <= 15), known & (colons > 0) & (dots == 0) & (size <= 39)
    fours, good_four = _groups(data, owner, offsets, four, 46, 10, 3)
    good_four &= (fours.max(1, initial=0) <= 255) & four
    sixes, good_six = _ipv6_groups(data, owner, offsets, six)
    out = np.zeros((n, 16), np.uint8)
    out[:, :4] = fours[:, :4]
    out[good_six] = sixes[good_six].astype(">u2").view(np.uint8).reshape(-1, 16)
    width = np.where(good_four, 4, np.where(good_six, 16, 0))
    values = out[np.arange(16) < width[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    valid = pa.array(good_four | good_six).buffers()[1]
    whole = pa.Array.from_buffers(pa.binary(), n, [valid, pa.py_buffer(ends), pa.py_buffer(values)])
    rest = np.flatnonzero(known & (colons > 0) & (dots > 0) & (size <= 45))
    if not len(rest):
        return whole
    mask = np.zeros(n, bool)
    mask[rest] = True
    return pc.replace_with_mask(whole, pa.array(mask), pa.array([_read_one(texts[i].as_py()) for i in rest.tolist()], pa.binary()))


def _read_one(text: str) -> bytes | None:
    try:
        return socket.inet_pton(socket.AF_INET6, text)
    except (OSError, ValueError):
        return None


def _digits(data: np.ndarray, base: int) -> np.ndarray:
    """Each byte's value as a digit, or -1."""
    table = np.full(256, -1, np.int64)
    for c in "0123456789abcdefABCDEF"[: 22 if base == 16 else 10]:
        table[ord(c)] = int(c, 16)
    return table[data]


def _cut(data: np.ndarray, owner: np.ndarray, offsets: np.ndarray, rows: np.ndarray, mark: int, base: int, most: int):
    """Of the texts in ``rows``: each group between marks as (text, value, digits), and whether a text has only digits and groups of at most ``most``."""
    bad = ~rows
    inside = rows[owner]
    is_mark = (data == mark) & inside
    digit = _digits(data, base)
    bad[owner[inside & ~is_mark & (digit < 0)]] = True
    # A group ends at each mark and at each text's end.
    before = np.concatenate([[0], np.cumsum(is_mark)])
    first = np.concatenate([[0], np.cumsum(np.where(rows, before[offsets[1:]] - before[offsets[:-1]] + 1, 0))])
    group = first[owner] + before[np.arange(len(data))] - before[offsets[owner]]
    take = inside & ~is_mark & (digit >= 0)
    size = np.bincount(group[take], minlength=first[-1])
    at = np.flatnonzero(take)
    # Places from the end of the group: marks and ends follow its last digit.
    ends = np.zeros(first[-1], np.int64)
    np.maximum.at(ends, group[take], at)
    text = np.repeat(np.arange(len(rows)), np.diff(first))
    bad[text[size > most]] = True
    power = ends[group[take]] - at
    short = power < most
    value = np.bincount(group[take][short], (digit[take] * float(base) ** np.minimum(power, most))[short], minlength=first[-1]).astype(np.int64)
    lead = np.zeros(first[-1], bool)
    starts = at - (size[group[take]] - 1 - power)
    lead[group[take]] = data[starts] == 48
    return text, value, size, lead, first, ~bad


def _groups(data: np.ndarray, owner: np.ndarray, offsets: np.ndarray, rows: np.ndarray, mark: int, base: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Four decimal groups of each text without leading zeros, and whether it has just these."""
    out = np.zeros((len(rows), 4), np.int64)
    text, value, size, lead, first, good = _cut(data, owner, offsets, rows, mark, base, most)
    good[text[(size == 0) | lead & (size > 1)]] = False
    own = good[text]
    out[text[own], (np.arange(len(text)) - first[text])[own]] = value[own]
    return out, good


def _ipv6_groups(data: np.ndarray, owner: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight groups of each text, with ``::`` filled up, and whether it is well formed."""
    out = np.zeros((len(rows), 8), np.int64)
    text, value, size, _, first, good = _cut(data, owner, offsets, rows, 58, 16, 4)
    n = np.diff(first)
    rank = np.arange(len(text)) - first[text]
    empty = size == 0
    # Empty groups: the first and the last only beside another, so that the text begins or ends with two colons.
    empties = np.bincount(text, empty, minlength=len(rows)).astype(np.int64)
    begins, ends = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    some = n > 0
    begins[some], ends[some] = empty[first[:-1][some]], empty[first[1:][some] - 1]
    inner = np.bincount(text, empty & (rank > 0) & (rank < n[text] - 1), minlength=len(rows)).astype(np.int64)
    gap = inner == 1
    good &= np.where(gap, True, inner == 0) & np.where(begins, gap & empty[np.minimum(first[:-1] + 1, max(len(empty) - 1, 0))], True) if len(empty) else good
    if len(empty):
        good &= np.where(ends, gap & empty[np.maximum(first[1:] - 2, 0)], True)
    full = n - empties
    good &= np.where(gap, full <= 7, (full == 8) & (empties == 0))
    # Groups before the gap count from the left, those behind it from the right.
    place = np.full(len(rows), 99)
    at = np.flatnonzero(empty & (rank > 0) & (rank < n[text] - 1))
    place[text[at]] = rank[at]
    behind = rank > place[text]
    column = np.where(behind, 8 - (n[text] - rank), rank) + np.where(behind, ends[text], 0) - np.where(~behind, begins[text], 0)
    own = good[text] & ~empty
    out[text[own], column[own]] = value[own]
    return out, good


@F.arrow_udf(StringType())
def ipv6_bytes_text(raw: pa.Array) -> pa.Array:
    """The canonical text of 16 bytes; null for any other length. Each distinct address of a batch is written once."""
    coded = raw.dictionary_encode()
    texts = pa.array([socket.inet_ntop(socket.AF_INET6, x) if len(x) == 16 else None for x in coded.dictionary.to_pylist()], pa.string())
    return texts.take(coded.indices)


def address(text: Column) -> Column:
    """The struct of an address text of either family, or null."""
    return raw_address(text_bytes(text))


def ipv4_address(text: Column) -> Column:
    """The struct of an IPv4 text in built-in functions alone; null for anything else."""
    return number_address(ipv4_number(text))


def raw_address(raw: Column) -> Column:
    """The struct of 4 or 16 network-order bytes; null for any other length."""
    digits = F.hex(raw)
    v4 = F.struct(F.lit(4).alias("family"), _long(F.concat(digits, F.lit("00000000"))).alias("hi"), F.lit(0).cast("bigint").alias("lo"))
    v6 = F.struct(F.lit(6).alias("family"), _long(F.substring(digits, 1, 16)).alias("hi"), _long(F.substring(digits, 17, 16)).alias("lo"))
    return F.when(F.octet_length(raw) == 4, v4).when(F.octet_length(raw) == 16, v6)


def number_address(ipv4: Column) -> Column:
    """The struct of an IPv4 address given as BIGINT."""
    return F.when(ipv4.isNotNull(), F.struct(F.lit(4).alias("family"), F.shiftleft(ipv4, 32).alias("hi"), F.lit(0).cast("bigint").alias("lo")))


def address_bytes(value: Column) -> Column:
    """The 4 or 16 network-order bytes of an address struct."""
    hi, lo = (F.lpad(F.hex(value[x]), 16, "0") for x in ("hi", "lo"))
    return F.unhex(F.when(value["family"] == 4, F.substring(hi, 1, 8)).otherwise(F.concat(hi, lo)))


def address_text(value: Column) -> Column:
    """The canonical text of an address struct of either family."""
    v4 = ipv4_text(F.shiftrightunsigned(value["hi"], 32))
    return F.when(value["family"] == 4, v4).when(value["family"] == 6, ipv6_bytes_text(address_bytes(value)))


def _mask(bits: Column) -> Column:
    """A long whose first ``bits`` (0 to 64) bits are set. Shifts take the count modulo 64, so 0 is apart."""
    return F.when(bits <= 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("bigint"), (64 - bits).cast("int")))


def masked(value: Column, plen: Column) -> tuple[Column, Column]:
    """(hi, lo) of an address or prefix struct with all but the first ``plen`` bits cleared."""
    hi = value["hi"].bitwiseAND(_mask(F.least(plen, F.lit(64))))
    lo = value["lo"].bitwiseAND(_mask(plen - 64))
    return hi, lo


def prefix(text: Column) -> Column:
    """The struct of ``address`` or ``address/length``, host bits cleared; null if either is malformed.

    Without a length, it is 32 or 128 by family.
    """
    parts = F.split(text, "/", -1)
    found, given, n_parts = address(F.get(parts, F.lit(0))), F.get(parts, F.lit(1)), F.size(parts)
    width = F.when(found["family"] == 4, 32).otherwise(128)
    plen = F.when(n_parts == 1, width).when(given.rlike(r"\A[0-9]{1,3}\z"), given.cast("int"))
    hi, lo = masked(found, plen)
    good = found.isNotNull() & (n_parts <= 2) & (plen <= width)
    return F.when(good, F.struct(found["family"].alias("family"), plen.alias("plen"), hi.alias("hi"), lo.alias("lo")))
