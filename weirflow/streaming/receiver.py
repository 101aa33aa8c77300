"""The receiving end of the relay: accepts lines over TCP, passes payloads on and answers each line with a status.

An answer follows the line's delivery: ``datagrams_to`` forwards a payload as a UDP
datagram, ``log_to`` appends it to a folder before it is acknowledged; the folder is a
streaming source for Spark (``received``). The rules are those of transport.status.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import socket
import socketserver
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators import transport
from weirflow.streaming.logs import debug, log

Deliver = Callable[[bytes], bool]
#: Bytes of a line that are taken at most: an encrypted datagram in Base64 is far shorter.
LINE_BYTES = 1 << 16


def lenient_base64(text: str) -> bytes:
    """As transport.base64_bytes: foreign characters are skipped, the first ``=`` ends the data, an odd last digit is dropped."""
    digits = re.sub("[^A-Za-z0-9+/=]", "", text).partition("=")[0]
    digits = digits[: len(digits) - (len(digits) % 4 == 1)]
    return base64.b64decode(digits + "=" * (-len(digits) % 4))


def decrypter(spark: SparkSession, key: str) -> Callable[[bytes], bytes | None]:
    """Opens what transport.envelope encrypts, with the session's Java; None where that fails."""
    crypto, secret = spark.sparkContext._jvm.javax.crypto, hashlib.sha256(key.encode()).digest()

    def open_(data: bytes) -> bytes | None:
        if len(data) < 28:
            return None
        cipher = crypto.Cipher.getInstance("AES/GCM/NoPadding")
        cipher.init(2, crypto.spec.SecretKeySpec(secret, "AES"), crypto.spec.GCMParameterSpec(128, data[:12]))
        try:
            return bytes(cipher.doFinal(data[12:]))
        except Exception as error:  # noqa: BLE001, Java's of several kinds
            debug(1, "a payload can't be opened: %s", error)
            return None

    return open_


def answer(line: str, deliver: Deliver, opened: Callable[[bytes], bytes | None] | None = None) -> int:
    """The status of a line, after its payload was delivered; ``opened`` decrypts, where a key is set."""
    words = line.split()
    command, data = words[0] if words else None, words[1] if len(words) > 1 else ""
    if command not in ("D", "DE"):
        return 510
    if command == "DE" and opened is None:
        return 420
    if command == "D" and opened is not None:
        return 430
    payload = lenient_base64(data)
    if opened is not None:
        payload = opened(payload)
        if payload is None:
            return 520
    return 200 if payload and deliver(payload) else 410


def datagrams_to(host: str, port: int) -> Deliver:
    """Delivers a payload as one UDP datagram."""
    sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)

    def deliver(payload: bytes) -> bool:
        try:
            return sock.sendto(payload, (host, port)) > 0
        except OSError as error:
            log.warning("cannot pass data to %s:%s: %s", host, port, error)
            return False

    return deliver


def log_to(folder: str) -> Deliver:
    """Delivers a payload by writing it, durably, as a file of its own; a name is seen only once the file is whole."""
    os.makedirs(folder, exist_ok=True)

    def deliver(payload: bytes) -> bool:
        name = uuid.uuid4().hex
        try:
            with open(f"{folder}/.{name}", "wb") as file:
                file.write(payload)
                file.flush()
                os.fsync(file.fileno())
            os.rename(f"{folder}/.{name}", f"{folder}/{name}.payload")
        except OSError as error:
            log.warning("cannot write to %s: %s", folder, error)
            return False
        return True

    return deliver


def received(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """The payloads that log_to() has written, as a stream of received time and payload."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.payload").option("maxFilesPerTrigger", files).load(folder)
    return stream.select(F.col("modificationTime").alias("recv_ts"), F.col("content").alias("payload"))


class Receiver:
    """A TCP server with a thread for each connection: ``with Receiver(deliver) as r: ... r.port``."""

    def __init__(self, deliver: Deliver, opened: Callable[[bytes], bytes | None] | None = None, host: str = "127.0.0.1", port: int = 0) -> None:
        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                debug(1, "a sender connected from %s", self.client_address[0])
                while line := self.rfile.readline(LINE_BYTES):
                    status = answer(line.decode("ascii", "replace"), deliver, opened)
                    debug(2, "status %s", status)
                    self.wfile.write(transport.REPLIES[status].encode() + b"\n")

        class Server(socketserver.ThreadingTCPServer):
            allow_reuse_address, daemon_threads = True, True

        self.server = Server((host, port), Handler)
        self.port = self.server.server_address[1]

    def __enter__(self) -> Receiver:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_: object) -> None:
        self.server.shutdown()
        self.server.server_close()
