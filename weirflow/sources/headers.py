"""Flow-file headers: the first 140 bytes of a file, decoded from Spark's binaryFile source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_BYTES = 140


def header_fields(content: Column, big_endian: bool = False) -> Column:
    """struct(magic, version, flags, num_blocks, ident) of a header's bytes; null if there are fewer than 140."""
    digits = F.hex(F.substring(content, 1, HEADER_BYTES))

    def number(at: int, size: int) -> Column:
        places = range(at, at + size) if big_endian else range(at + size - 1, at - 1, -1)
        return F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in places]), 16, 10).cast("bigint")

    ident = F.regexp_extract(F.decode(F.substring(content, 13, 128), "ISO-8859-1"), r"(?s)\A([^\x00]*)", 1)
    fields = F.struct(
        number(0, 2).cast("int").alias("magic"), number(2, 2).cast("int").alias("version"), number(4, 4).alias("flags"), number(8, 4).alias("num_blocks"), ident.alias("ident")
    )
    return F.when(F.octet_length(content) >= HEADER_BYTES, fields)


def read_headers(spark: SparkSession, path: str, big_endian: bool = False) -> DataFrame:
    """path and header of each file; the header is null for short files, and an empty file gives no row."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", header_fields(F.col("content"), big_endian).alias("header"))


def print_header(header: Column) -> Column:
    """The five labelled lines of a header; magic, version and flags in upper-case hex."""
    return F.concat(
        F.lit("Magic:\t\t"), F.hex(header["magic"]), F.lit("\nVersion:\t"), F.hex(header["version"]), F.lit("\nFlags:\t\t"), F.hex(header["flags"]),
        F.lit("\nNumBlocks:\t"), header["num_blocks"].cast("string"), F.lit("\nStringIdent:\t"), header["ident"],
    )


def head(spark: SparkSession, arguments: list[str]) -> str:
    """The printed header of one file, given as ["-r", path]."""
    if not isinstance(arguments, list) or not all(isinstance(x, str) for x in arguments):
        raise TypeError("a list of strings is expected")
    if len(arguments) != 2 or arguments[0] != "-r":
        raise ValueError('exactly "-r" and a file are expected')
    row = read_headers(spark, arguments[1]).select(print_header(F.col("header")).alias("text")).first()
    return row.text if row else None
