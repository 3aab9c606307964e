"""Golden bytes, damage and round trips."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidelog.errors import CodecError
from tidelog.sources import codec


def test_golden_records():
    assert codec.encode_record(1, 1, [b"k", b"v"]).hex() == "01010201" "6b0176"
    assert codec.encode_record(3, 3, [b"k"]).hex() == "030301016b"
    assert codec.encode_record(2**64 - 1, 1, [b""]).hex() == "ff" * 9 + "01" + "010100"


# Damaged streams, the error each ends with, and how many records come before it.
DAMAGED = [
    ("ff", "failed to decode LSN", 0),
    ("01ff", "failed to decode command ID", 0),
    ("0101ff", "failed to decode arguments number", 0),
    ("010101ff", "failed to decode argument length", 0),
    ("0101010a" + b"short".hex(), "failed to decode argument", 0),
    ("01", "failed to decode command ID", 0),
    ("030301016b" + "0201", "failed to decode arguments number", 1),
]


@pytest.mark.parametrize("data,error,good", DAMAGED)
def test_damage(data, error, good):
    found = []
    with pytest.raises(CodecError, match=error):
        for _, r in codec.records(bytes.fromhex(data)):
            found.append(r)
    assert len(found) == good


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**31 - 1), st.lists(st.binary(max_size=300), max_size=4))))
def test_record_round_trip(rows):
    data = b"".join(codec.encode_record(*r) for r in rows)
    assert [(r.lsn, r.command, list(r.arguments)) for _, r in codec.records(data)] == rows
    assert codec.last_lsn(data) == (rows[-1][0] if rows else None)


@given(st.sampled_from(["SET", "GET", "DEL"]), st.binary(max_size=400), st.binary(min_size=1, max_size=400), st.binary(max_size=9))
def test_command_round_trip(name, key, value, trailing):
    sent = codec.encode_command(name, key, value if name == "SET" else b"")
    assert codec.parse_command(sent + trailing) == (name, (key, value) if name == "SET" else (key,))


@pytest.mark.parametrize(
    "data,error",
    [
        (b"", "empty command"),
        (b"\x0a", "invalid protocol format"),
        (codec.encode_command("INVALID", b"k", b"v"), "unknown command"),
        (codec.encode_command("set", b"k", b"v"), "unknown command"),
        (codec.encode_command("SET", b"k"), "invalid arguments number"),
        (codec.encode_command("GET", b"k", b"v"), "invalid arguments number"),
        (codec.encode_command("SET", b"k", b"v")[:-1], "invalid protocol format"),
    ],
)
def test_refused_commands(data, error):
    with pytest.raises(CodecError, match=error):
        codec.parse_command(data)


def test_lengths_that_do_not_fit():
    with pytest.raises(CodecError):
        codec.encode_command("GET", b"k" * 2**16)


@given(st.lists(st.binary(max_size=100)))
def test_frames(payloads):
    data, at = b"".join(map(codec.frame, payloads)), 0
    for p in payloads:
        got, at = codec.read_frame(data, at)
        assert got == p
    with pytest.raises(CodecError):
        codec.read_frame(data, at)
    with pytest.raises(CodecError, match="too large"):
        codec.read_frame(codec.frame(b"12345"), 0, 4)
