"""Byte layouts of log records, command frames and replication frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

from tidelog.errors import CodecError
from tidelog.schema import COMMAND_IDS, MAX_U64, SET


class Record(NamedTuple):
    lsn: int
    command: int
    arguments: tuple[bytes, ...]


class Command(NamedTuple):
    name: str
    arguments: tuple[bytes, ...]


def uvarint(n: int) -> bytes:
    """LEB128: seven bits a byte, low first, the top bit set on all but the last."""
    if not 0 <= n <= MAX_U64:
        raise CodecError("number out of the unsigned 64-bit range")
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_uvarint(data: bytes, at: int, what: str) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise CodecError(f"failed to decode {what}")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            if value > MAX_U64:
                raise CodecError(f"failed to decode {what}")
            return value, at


def encode_record(lsn: int, command: int, arguments: Sequence[bytes]) -> bytes:
    parts = [uvarint(lsn), uvarint(command), uvarint(len(arguments))]
    for a in arguments:
        parts += [uvarint(len(a)), bytes(a)]
    return b"".join(parts)


def decode_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at ``at`` and where the next one begins."""
    lsn, at = read_uvarint(data, at, "LSN")
    command, at = read_uvarint(data, at, "command ID")
    n, at = read_uvarint(data, at, "arguments number")
    arguments = []
    for _ in range(n):
        size, at = read_uvarint(data, at, "argument length")
        if at + size > len(data):
            raise CodecError("failed to decode argument")
        arguments.append(bytes(data[at : at + size]))
        at += size
    return Record(lsn, command, tuple(arguments)), at


def records(data: bytes) -> Iterator[tuple[int, Record]]:
    """``(offset, record)`` to the end of ``data``; a torn or damaged record raises after the good ones."""
    at = 0
    while at < len(data):
        record, after = decode_record(data, at)
        yield at, record
        at = after


class Found(NamedTuple):
    """Records decoded together: LSN, command, byte offset and number of arguments of each, and all arguments in a row."""

    lsn: np.ndarray
    command: np.ndarray
    offset: np.ndarray
    n_arguments: np.ndarray
    arguments: list[bytes]


def _more(data: bytes, at: int, low: int) -> tuple[int, int]:
    """A varint's value and end, its first byte having been taken; IndexError where the data end or it exceeds 64 bits."""
    value, shift = low & 0x7F, 7
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            if value > MAX_U64:
                raise IndexError
            return value, at
        if shift > 63:
            raise IndexError


def decode_records(data: bytes, base: int = 0, most: int = 1 << 30) -> tuple[Found, int]:
    """The whole records from the start of ``data``, at most about ``most``, and where the rest begins: nothing, an unfinished record or damage,
    which ``decode_record`` tells apart."""
    lsns: list[int] = []
    commands: list[int] = []
    offsets: list[int] = []
    counts: list[int] = []
    arguments: list[bytes] = []
    at = start = whole = 0
    size, add = len(data), arguments.append
    try:
        while at < size and len(lsns) < most:
            start = at
            lsn = data[at]
            at += 1
            if lsn > 127:
                lsn, at = _more(data, at, lsn)
            command = data[at]
            at += 1
            if command > 127:
                command, at = _more(data, at, command)
            n = data[at]
            at += 1
            if n > 127:
                n, at = _more(data, at, n)
            for _ in range(n):
                length = data[at]
                at += 1
                if length > 127:
                    length, at = _more(data, at, length)
                end = at + length
                if end > size:
                    raise IndexError
                add(data[at:end])
                at = end
            if command > 0x7FFFFFFF:
                raise IndexError
            lsns.append(lsn)
            commands.append(command)
            offsets.append(base + start)
            counts.append(n)
            whole, start = len(arguments), at
    except IndexError:
        pass
    del arguments[whole:]
    return Found(np.array(lsns, np.uint64), np.array(commands, np.int32), np.array(offsets, np.int64), np.array(counts, np.int32), arguments), start


def scan_records(system, path: str, start: int = 0, end: int | None = None, piece: int = 4 << 20) -> Iterator[Found]:
    """Records of a stretch of a segment file, read piece by piece; a damaged or torn record raises after the good ones."""
    with system.open_input_file(path) as f:
        end = f.size() if end is None else min(end, f.size())
        f.seek(start)
        at, rest = start, b""
        while True:
            data = rest + f.read(max(0, min(piece, end - at - len(rest))))
            last = at + len(data) >= end
            found, used = decode_records(data, at)
            if len(found.lsn):
                yield found
            at, rest = at + used, data[used:]
            if last:
                if rest:
                    r, _ = decode_record(rest)
                    raise CodecError("failed to decode command ID" if r.command > 0x7FFFFFFF else "failed to decode record")
                return
            # A record longer than a piece: more at once, so that it is not begun over and over.
            piece = max(piece, 2 * len(rest))


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LEB128 of all values at once: length of each, and their bytes in a (values, 10) table."""
    shifts = np.arange(10, dtype=np.uint64) * np.uint64(7)
    groups = (values.astype(np.uint64)[:, None] >> shifts) & np.uint64(0x7F)
    length = np.maximum(1, 10 - np.argmax(groups[:, ::-1] != 0, axis=1))
    length[~groups.any(axis=1)] = 1
    more = np.arange(10) < (length - 1)[:, None]
    return length, (groups | np.where(more, np.uint64(0x80), np.uint64(0))).astype(np.uint8)


def encode_records(lsn: np.ndarray, command: np.ndarray, n_arguments: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All records end to end, and where each ends. ``sizes``, ``data``: bytes of each argument, and all their bytes in a row."""
    heads = [_varints(x) for x in (lsn, command, n_arguments)]
    head = sum(length for length, _ in heads)
    arg_length, arg_bytes = _varints(sizes)
    taken = np.concatenate([[0], np.cumsum(arg_length + sizes)])
    first = np.concatenate([[0], np.cumsum(n_arguments)])
    ends = np.cumsum(head + taken[first[1:]] - taken[first[:-1]])
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)

    def put(at: np.ndarray, length: np.ndarray, table: np.ndarray) -> None:
        for k in range(int(length.max(initial=0))):
            has = length > k
            out[at[has] + k] = table[has, k]

    at = starts
    for length, table in heads:
        put(at, length, table)
        at = at + length
    owner = np.repeat(np.arange(len(n_arguments)), n_arguments)
    arg_at = at[owner] + taken[:-1] - taken[first[:-1]][owner]
    put(arg_at, arg_length, arg_bytes)
    body = arg_at + arg_length
    before = np.cumsum(sizes) - sizes
    out[np.repeat(body - before, sizes) + np.arange(int(sizes.sum()))] = data
    return out.tobytes(), ends


def last_lsn(data: bytes) -> int | None:
    """LSN of the last record (not the greatest); None without records."""
    found = None
    for _, r in records(data):
        found = r.lsn
    return found


def encode_command(name: str, key: bytes = b"", value: bytes = b"") -> bytes:
    name_bytes = name.encode()
    for what, part, bits in (("command", name_bytes, 8), ("key", key, 16), ("value", value, 32)):
        if len(part) >= 2**bits:
            raise CodecError(f"{what} too long")
    sized = ((name_bytes, 1), (key, 2), (value, 4))
    return b"".join(len(part).to_bytes(width, "big") + part for part, width in sized)


def parse_command(data: bytes) -> Command:
    """The command in a frame; what follows the value is ignored."""
    if not data:
        raise CodecError("empty command")

    def take(at: int, width: int) -> tuple[bytes, int]:
        start = at + width
        if start > len(data) or (end := start + int.from_bytes(data[at:start], "big")) > len(data):
            raise CodecError("invalid protocol format")
        return data[start:end], end

    name, at = take(0, 1)
    if not name:
        raise CodecError("invalid protocol format")
    if (text := name.decode("utf-8", "replace")) not in COMMAND_IDS:
        raise CodecError("unknown command")
    key, at = take(at, 2)
    value, _ = take(at, 4)
    if (COMMAND_IDS[text] == SET) != bool(value):
        raise CodecError("invalid arguments number")
    return Command(text, (key, value) if value else (key,))


def frame(payload: bytes) -> bytes:
    return len(payload).to_bytes(4, "big") + payload


def read_frame(data: bytes, at: int = 0, max_bytes: int = 2**32 - 1) -> tuple[bytes, int]:
    """The payload of the frame at ``at`` and where the next one begins."""
    if at + 4 > len(data):
        raise CodecError("failed to read message header")
    size = int.from_bytes(data[at : at + 4], "big")
    if size > max_bytes:
        raise CodecError("message too large")
    if at + 4 + size > len(data):
        raise CodecError("failed to read message data")
    return data[at + 4 : at + 4 + size], at + 4 + size
