"""Hand-built Ethernet frames."""

import socket
import struct


def ethernet(kind, payload, vlan=None):
    return bytes(12) + (struct.pack(">HH", 0x8100, vlan) if vlan is not None else b"") + struct.pack(">H", kind) + payload


def ip4(protocol, payload, src="1.2.3.4", dst="5.6.7.8", ihl=5):
    head = struct.pack(">BBHHHBBH", 0x40 | ihl, 0, ihl * 4 + len(payload), 0, 0, 64, protocol, 0)
    return head + socket.inet_aton(src) + socket.inet_aton(dst) + bytes(4 * (ihl - 5)) + payload


def ip6(following, payload, src="2a00::1", dst="2a00::2", plen=None):
    head = struct.pack(">IHBB", 6 << 28, len(payload) if plen is None else plen, following, 64)
    return head + socket.inet_pton(socket.AF_INET6, src) + socket.inet_pton(socket.AF_INET6, dst) + payload


def udp(src, dst, payload):
    return struct.pack(">HHHH", src, dst, 8 + len(payload), 0) + payload


def tcp(src, dst, flags=0x12):
    return struct.pack(">HHIIBBHHH", src, dst, 0, 0, 0x50, flags, 0, 0, 0)


def icmp(kind, code):
    return bytes([kind, code, 0, 0, 0, 0, 0, 0])


def ayiya(skew, now):
    return struct.pack(">BBBBI", 0x40, 0x50, 0, 41, now + skew) + bytes(16) + bytes(20)
