"""Reliable record transport, row by row: envelopes, commands, statuses, retry delays and queue segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a datagram that are taken; the rest is cut off.
DATAGRAM_BYTES = 2048
#: Seconds after which a segment is cut, with and without a sealed one waiting.
BUSY_AGE, IDLE_AGE = 120, 1
#: Seconds of the longest retry delay, and of a session after which it begins anew.
LONGEST_DELAY, LONG_SESSION = 243, 3600
#: What a receiver answers, by status; fixed values of the protocol.
REPLIES = {
    200: "200 OK",
    410: "410 Cannot pass data to collector.",
    420: "420 Encryption not supported by server",
    430: "430 Encryption required by server",
    510: "510 Invalid command",
    520: "520 Invalid data from client",
}
_SEGMENT_NAME = "yyyy-MM-dd.HH.mm.ss"
#: What a regular expression takes for white space.
_SPACE = " \t\n\x0b\f\r"


def base64_text(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once a row: an expression that is named several times else runs as often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _padded(digits: Column) -> Column:
    """Base64 digits as whole units of four."""
    return F.concat(digits, F.repeat(F.lit("="), F.element_at(F.array(*map(F.lit, (0, 0, 2, 1))), F.octet_length(digits) % 4 + 1)))


def base64_bytes(text: Column) -> Column:
    """The bytes of Base64 text, leniently: foreign characters are skipped, the first ``=`` ends it, an odd last digit is dropped.

    Clean text is decoded at once; only what isn't goes through a regular expression.
    """

    def cleaned(digits: Column) -> Column:
        size = F.octet_length(digits)
        return F.unbase64(_padded(F.when(size % 4 == 1, F.substring(digits, F.lit(1), size - 1)).otherwise(digits)))

    slow = lambda head: once(F.regexp_replace(head, "[^A-Za-z0-9+/]", ""), cleaned)
    return once(F.substring_index(text, "=", 1), lambda head: F.coalesce(F.try_to_binary(_padded(head), F.lit("base64")), slow(head)))


def envelope(payload: Column, key: str | None = None) -> Column:
    """The line that carries a payload: ``D`` and Base64, or ``DE`` and Base64 of the encrypted payload.

    Encryption is AES-GCM; the old cipher isn't among Spark's functions.
    """
    cut = F.substring(payload, 1, DATAGRAM_BYTES)
    if not key:
        return F.concat(F.lit("D "), base64_text(cut))
    return F.concat(F.lit("DE "), base64_text(F.aes_encrypt(cut, secret(key))))


def secret(key: str) -> Column:
    """The 256-bit AES key of a passphrase."""
    return F.unhex(F.sha2(F.lit(key), 256))


def parse_line(line: Column) -> tuple[Column, Column]:
    """(command, data): the first two words of a line; null where missing."""
    return _command_and_data(_words(line))


def _words(line: Column) -> Column:
    """The first two words of a line, and its rest."""
    return F.split(F.ltrim(line, F.lit(_SPACE)), r"\s+", 3)


def _command_and_data(words: Column) -> tuple[Column, Column]:
    word = lambda i: F.nullif(F.get(words, F.lit(i)), F.lit(""))
    return word(0), word(1)


def decoded(line: Column, key: str | None = None) -> Column:
    """The payload of a line; missing data is empty, wrongly encrypted data null."""

    def payload(words: Column) -> Column:
        command, data = _command_and_data(words)
        raw = base64_bytes(F.coalesce(data, F.lit("")))
        if key:
            return F.when(command == "DE", F.try_aes_decrypt(raw, secret(key)))
        return F.when(command == "D", raw)

    return once(_words(line), payload)


def status(line: Column, has_key: Column, delivered: Column | None = None) -> Column:
    """What a receiver answers to a line: 200, 410, 420, 430, 510 or 520.

    ``delivered`` says whether the collector took the payload (by default, whether
    there is one); empty payloads are never taken. Data that isn't Base64 decodes to
    what digits it has, so nothing of it is 410; only a null line's data is 520.
    """

    def answer(words: Column) -> Column:
        command, data = _command_and_data(words)

        def verdict(raw: Column) -> Column:
            taken = (F.octet_length(raw) > 0) & (F.lit(True) if delivered is None else delivered)
            return F.when(raw.isNull(), 520).when(taken, 200).otherwise(410)

        return (
            F.when(command.isNull() | ~command.isin("D", "DE"), 510)
            .when((command == "DE") & ~has_key, 420)
            .when((command == "D") & has_key, 430)
            .otherwise(once(base64_bytes(F.coalesce(data, F.lit(""))), verdict))
        )

    return once(_words(line), answer)


def reply(code: Column) -> Column:
    """The line of a status."""
    found = F.lit(None).cast("string")
    for number, text in REPLIES.items():
        found = F.when(code == number, text).otherwise(found)
    return found


def acknowledged(answer: Column) -> Column:
    """Whether a sender may go on: only after the exact reply of 200."""
    return F.coalesce(answer == REPLIES[200], F.lit(False))


def backoff(spark: SparkSession, attempts: int) -> DataFrame:
    """attempt and delay_s: 1, 3, 9, ... seconds, LONGEST_DELAY at most."""
    steps = spark.range(attempts).withColumnRenamed("id", "attempt")
    return steps.select("attempt", F.least(F.pow(F.lit(3), F.least("attempt", F.lit(5))), F.lit(LONGEST_DELAY)).cast("bigint").alias("delay_s"))


def next_delay(previous: int | None, session_s: float) -> int:
    """The delay after a session that ended: tripled, or 1 at first and after a long session."""
    return 1 if previous is None or session_s > LONG_SESSION else min(3 * previous, LONGEST_DELAY)


def segment_name(created: Column) -> Column:
    """A segment's name, the UTC second in which it was created (in a UTC session)."""
    return F.date_format(created, _SEGMENT_NAME)


def cuts(ages: Iterator[tuple[float, bool]]) -> Iterator[tuple[int, int]]:
    """(segment, position) of each arrival, given (seconds, whether a sealed segment waits) in order.

    The age counts from the arrival that caused the last cut; the arrival that
    causes one still belongs to the old segment.
    """
    segment, position, began = 0, 0, None
    for at, backlog in ages:
        began = at if began is None else began
        yield segment, position
        position += 1
        if at - began > (BUSY_AGE if backlog else IDLE_AGE):
            segment, position, began = segment + 1, 0, at


def queue_segments(datagrams: DataFrame) -> DataFrame:
    """``datagrams`` (stream_id, seq, recv_ts, backlog, payload) with segment and pos, in order of seq.

    Each cut resets the age, so a stream is worked through in order. Its rows come
    sorted through Arrow batches and are never held together: a stream with a third
    of all rows needs no more memory than a small one.
    """
    taken = {c.lower() for c in datagrams.columns} & {"segment", "pos"}
    if taken:
        raise ValueError(f"the input has columns {sorted(taken)} already")
    schema = T.StructType([*datagrams.schema.fields, T.StructField("segment", T.LongType()), T.StructField("pos", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), (0, 0, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            streams = batch.column("stream_id")
            coded = streams.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, coded[1:] != coded[:-1]))
            times = batch.column("recv_ts").cast(pa.timestamp("us"), safe=False).cast(pa.int64()).to_numpy() / 1e6
            waits = batch.column("backlog").fill_null(False).to_numpy(zero_copy_only=False)
            segments, positions = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                own = streams[a].as_py()
                if own != last:
                    last, state = own, (0, 0, None)
                segments[a:b], positions[a:b], state = cut_run(times[a:b], waits[a:b], state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segments), pa.array(positions)], schema=pa.schema([*batch.schema, ("segment", pa.int64()), ("pos", pa.int64())]))

    return datagrams.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, schema)


def cut_run(times: np.ndarray, waits: np.ndarray, state: tuple) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(segments, positions, state) of arrivals of one stream in order, from a state (segment, position, time of the last cut).

    It goes from cut to cut: the next one is the first arrival that is old enough, with or without a segment waiting.
    """
    segment, position, began = state
    began = times[0] if began is None else began
    segments, positions = np.empty(len(times), np.int64), np.empty(len(times), np.int64)
    age, at = np.where(waits, BUSY_AGE, IDLE_AGE), 0
    while at < len(times):
        # Cuts are mostly near: a stretch that doubles is looked at.
        size, found = 16, -1
        while found < 0:
            part = slice(at, min(at + size, len(times)))
            old = np.flatnonzero(times[part] - began > age[part])
            if len(old):
                found = at + int(old[0])
            elif part.stop == len(times):
                break
            size *= 2
        end = found + 1 if found >= 0 else len(times)
        segments[at:end] = segment
        positions[at:end] = position + np.arange(end - at)
        if found >= 0:
            segment, position, began = segment + 1, 0, times[found]
        else:
            position += end - at
        at = end
    return segments, positions, (segment, position, began)


def replay_order(segments: DataFrame) -> DataFrame:
    """Records in the order in which they are sent: by segment name, then position; a range-partitioned sort."""
    return segments.orderBy("segment_id", "pos")
