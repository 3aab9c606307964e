"""``spark.read.format("wal")``: the binary log as a batch source, a streaming source and a sink.

    from tidelog.sources.wal import register
    register(spark)
    spark.read.format("wal").load(folder)                                  # lsn, command, arguments, segment, ordinal, error
    spark.readStream.format("wal").option("startingLsn", 42).load(folder)
    df.select("lsn", "command", "arguments").write.format("wal").mode("append").save(folder)

Options: ``mode`` (FAILFAST, default, or PERMISSIVE: damage becomes a row with ``error`` set), ``segmentBytes`` (a
segment is closed when the next batch would reach it, default 10 MiB), ``batchRecords`` (records that are never split over
segments, 100). Segments are skipped by the manifest only while their LSNs ascend; a write that breaks this says so in it.

The folder is a path or a URI that driver and executors share (``sources/files.py``). Records travel as Arrow batches: segments
are read in pieces and written in whole batches, and the driver reads no closed segment.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from tidelog.errors import CodecError, InvalidArgument
from tidelog.schema import MAX_U64
from tidelog.sources.codec import Found, decode_records, encode_records, scan_records
from tidelog.sources.files import place, size_of, sync
from tidelog.sources.manifest import Segment, append_manifest, greatest_lsn, load_manifest, next_lsn, read_manifest, segment_for_lsn

SCHEMA = "lsn decimal(20,0), command int, arguments array<binary>, segment string, ordinal bigint, error string"
WRITE_SCHEMA = "lsn decimal(20,0), command int, arguments array<binary>"
SEGMENT_BYTES, BATCH_RECORDS = 10 << 20, 100

_ARROW = pa.schema(
    [
        ("lsn", pa.decimal128(20, 0)), ("command", pa.int32()), ("arguments", pa.list_(pa.field("element", pa.binary()))),
        ("segment", pa.string()), ("ordinal", pa.int64()), ("error", pa.string()),
    ]
)


def _number(options, name: str, default: int, low: int = 1) -> int:
    text = str(options.get(name, default))
    if not text.isdigit() or int(text) < low:
        raise InvalidArgument(f"{name} must be a whole number from {low}, not {text!r}")
    return int(text)


def _failfast(options) -> bool:
    mode = options.get("mode", "FAILFAST").upper()
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise InvalidArgument(f"mode must be FAILFAST or PERMISSIVE, not {mode!r}")
    return mode == "FAILFAST"


def _folder(options) -> str:
    if not options.get("path"):
        raise InvalidArgument("give the log's folder as path")
    return options["path"].rstrip("/")


@dataclass
class Slice(InputPartition):
    folder: str
    segment: str
    number: int
    start: int
    end: int | None
    low: int
    high: int
    failfast: bool


def _decimals(values: np.ndarray) -> pa.Array:
    words = np.zeros((len(values), 2), np.uint64)
    words[:, 0] = values
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(values), [None, pa.py_buffer(words.tobytes())])


def _batch(part: Slice, found: Found) -> pa.RecordBatch | None:
    offsets = np.concatenate([[0], np.cumsum(found.n_arguments)]).astype(np.int32)
    arguments = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.arguments, pa.binary()))
    n = len(found.lsn)
    columns = [
        _decimals(found.lsn), pa.array(found.command), arguments.cast(_ARROW.field("arguments").type),
        pa.repeat(pa.scalar(part.segment), n), pa.array((part.number << 40) + found.offset), pa.nulls(n, pa.string()),
    ]
    batch = pa.RecordBatch.from_arrays(columns, schema=_ARROW)
    wanted = (found.lsn >= np.uint64(part.low)) & (found.lsn <= np.uint64(part.high))
    return batch if wanted.all() else batch.filter(pa.array(wanted))


def _read(part: Slice) -> Iterator[pa.RecordBatch]:
    """Records of one stretch of a segment whose LSN lies within the bounds; ordinal is (segment number, offset)."""
    if part.low > part.high:
        return
    system, folder = place(part.folder)
    at = part.start
    try:
        for found in scan_records(system, f"{folder}/{part.segment}", part.start, part.end):
            at = int(found.offset[-1]) + 1
            batch = _batch(part, found)
            if batch.num_rows:
                yield from (batch.slice(k, 10_000) for k in range(0, batch.num_rows, 10_000))
    except (CodecError, OSError) as e:
        if part.failfast:
            raise
        why = str(e) if isinstance(e, CodecError) else f"failed to read segment: {os.strerror(e.errno) if e.errno else e}"
        columns = [pa.nulls(1, f.type) for f in _ARROW][:3] + [pa.array([part.segment]), pa.array([(part.number << 40) + at], pa.int64()), pa.array([why])]
        yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class WalReader(DataSourceReader):
    """One task per segment; bounds on ``lsn`` skip whole segments and are applied again to every record."""

    def __init__(self, options):
        self.folder, self.failfast = _folder(options), _failfast(options)
        self.low, self.high = 0, MAX_U64

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            kind = type(f)
            if kind in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and f.attribute == ("lsn",):
                v = f.value
                if kind in (EqualTo, GreaterThanOrEqual):
                    self.low = max(self.low, int(v) + (int(v) != v and v > 0))
                if kind is GreaterThan:
                    self.low = max(self.low, int(v // 1) + 1)
                if kind in (EqualTo, LessThanOrEqual):
                    self.high = min(self.high, int(v // 1))
                if kind is LessThan:
                    self.high = min(self.high, int(-(-v // 1)) - 1)
            # The engine filters again: damaged records, which have no LSN, are then dropped as it defines.
            yield f

    def partitions(self) -> list[Slice]:
        m = load_manifest(self.folder)
        kept = range(len(m.segments))
        if m.segments and m.ordered:
            last = next((i for i, s in enumerate(m.segments) if s.lsn_start > self.high), len(m.segments))
            kept = range(segment_for_lsn(m.segments, self.low), last)
        if self.low > self.high or self.high < 0 or self.low > MAX_U64:
            kept = range(0)
        out = [Slice(self.folder, m.segments[i].name, i, 0, None, self.low, self.high, self.failfast) for i in kept]
        return out or [Slice(self.folder, "", 0, 0, 0, 1, 0, False)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        yield from _read(partition)


class WalStreamReader(DataSourceStreamReader):
    """Follows a log over segment borders. The offset is ``{segment number, byte}``; sizes are taken once per batch."""

    def __init__(self, options):
        self.folder, self.failfast = _folder(options), _failfast(options)
        self.low = _number(options, "startingLsn", 0, 0)
        self.known: dict[int, int] = {}

    def initialOffset(self) -> dict:
        return {"segment": 0, "byte": 0}

    def latestOffset(self) -> dict:
        """The end of the last complete record; one still being written is left for the next batch.

        Only what the open segment has gained since the last batch is looked at, piece by piece.
        """
        segments = read_manifest(self.folder)
        if not segments:
            return self.initialOffset()
        last = len(segments) - 1
        at = self.known.get(last, 0)
        system, folder = place(self.folder)
        with system.open_input_file(f"{folder}/{segments[last].name}") as f:
            end = f.size()
            f.seek(at)
            rest = b""
            while at + len(rest) < end:
                data = rest + f.read(max(4 << 20, len(rest)))
                _, used = decode_records(data, at)
                at, rest = at + used, data[used:]
        self.known = {last: at}
        return {"segment": last, "byte": at}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        segments = read_manifest(self.folder)
        out = []
        for i in range(start["segment"], min(end["segment"] + 1, len(segments))):
            begin = start["byte"] if i == start["segment"] else 0
            stop = end["byte"] if i == end["segment"] else None
            if stop is None or stop > begin:
                out.append(Slice(self.folder, segments[i].name, i, begin, stop, self.low, MAX_U64, self.failfast))
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        yield from _read(partition)


def _encoded(batch: pa.RecordBatch) -> tuple[np.ndarray, bytes, np.ndarray]:
    """LSNs of a batch, its records as bytes, and where each ends."""
    lsn, command, arguments = (batch.column(batch.schema.get_field_index(c)) for c in ("lsn", "command", "arguments"))
    lsn = lsn.cast(pa.decimal128(20, 0))
    values = arguments.flatten()
    if lsn.null_count or command.null_count or arguments.null_count or values.null_count:
        raise CodecError("a log record must not hold nulls")
    words = np.frombuffer(lsn.buffers()[1], np.uint64).reshape(-1, 2)[lsn.offset : lsn.offset + len(lsn)]
    command = command.cast(pa.int64()).to_numpy(zero_copy_only=False)
    if words[:, 1].any() or (command < 0).any():
        raise CodecError("number out of the unsigned 64-bit range")
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    body = values.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    counts = arguments.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return words[:, 0], *encode_records(words[:, 0], command, counts, np.diff(offsets), data)


class SegmentWriter:
    """Appends batches to segment files of a folder; a batch that would fill a segment to ``limit`` opens the next one."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder.rstrip("/"), limit
        self.system, self.path = place(folder)
        self.system.create_dir(self.path, recursive=True)
        self.done: list[list] = []  # least LSN, greatest LSN, name
        self.out, self.size, self.name = None, 0, ""

    def resume(self, name: str, size: int) -> bool:
        """Go on in a partly filled segment, where the file system can append."""
        try:
            self.out = self.system.open_append_stream(f"{self.path}/{name}")
        except (NotImplementedError, OSError):
            return False
        self.name, self.size = name, size
        return True

    def write(self, data: bytes, low: int, high: int) -> bool:
        """Whether the batch opened a segment."""
        opens = self.out is None or self.size + len(data) >= self.limit
        if opens:
            self.close()
            self.name = f"wal_{uuid.uuid4().hex}.log"
            self.out, self.size = self.system.open_output_stream(f"{self.path}/{self.name}"), 0
            self.done.append([low, high, self.name])
        elif self.done:
            self.done[-1][:2] = [min(self.done[-1][0], low), max(self.done[-1][1], high)]
        self.out.write(data)
        self.size += len(data)
        return opens

    def flush(self) -> None:
        if self.out is not None:
            self.out.flush()
            sync(self.system, f"{self.path}/{self.name}")

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            sync(self.system, f"{self.path}/{self.name}")
            self.out = None


@dataclass
class Written(WriterCommitMessage):
    segments: list[tuple[int, int, str]]


class WalWriter(DataSourceArrowWriter):
    """Each task writes its own segments; the manifest names them, by first LSN, once all tasks have succeeded."""

    def __init__(self, options):
        self.folder = _folder(options)
        self.segment_bytes, self.batch = _number(options, "segmentBytes", SEGMENT_BYTES), _number(options, "batchRecords", BATCH_RECORDS)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out = SegmentWriter(self.folder, self.segment_bytes)
        rest, held = b"", np.zeros(0, np.uint64)  # records of a batch that is not full yet
        for b in iterator:
            lsn, data, ends = _encoded(b)
            data, ends, lsn = rest + data, np.concatenate([[0] * len(held), ends + len(rest)]).astype(np.int64), np.concatenate([held, lsn])
            begin = at = 0
            for at in range(self.batch, len(lsn) + 1, self.batch):
                part = lsn[at - self.batch : at]
                out.write(data[begin : ends[at - 1]], int(part.min()), int(part.max()))
                begin = int(ends[at - 1])
            whole = len(lsn) - len(lsn) % self.batch
            rest, held = data[begin:], lsn[whole:]
        if len(held):
            out.write(rest, int(held.min()), int(held.max()))
        out.close()
        return Written([tuple(s) for s in out.done])

    def commit(self, messages: list[Written | None]) -> None:
        segments = sorted(s for m in messages if m for s in m.segments)
        if not segments:
            return
        top, ordered = greatest_lsn(self.folder), load_manifest(self.folder).ordered
        broken = False
        for low, high, _ in segments:
            broken |= low <= top
            top = max(top, high)
        append_manifest(self.folder, [Segment(name, low) for low, _, name in segments], top, ordered and broken)

    def abort(self, messages: list[Written | None]) -> None:
        system, path = place(self.folder)
        for m in messages:
            for *_, name in m.segments if m else ():
                if size_of(system, f"{path}/{name}") is not None:
                    system.delete_file(f"{path}/{name}")


class LogAppender:
    """The log of one writer, kept open: small batches go to the end of its last segment, each on disk before ``append`` returns.

    A partly filled last segment is continued; one that is full, ends in a torn record or lies where nothing can be
    appended is left as it is, and the next batch opens a new one. One appender at a time.
    """

    def __init__(self, folder: str, segment_bytes: int = SEGMENT_BYTES):
        self.folder = folder
        self.out = SegmentWriter(folder, segment_bytes)
        m = load_manifest(folder)
        self.next_lsn, self.ordered = next_lsn(folder) if m.segments else 0, m.ordered
        if m.segments and (size := size_of(self.out.system, at := f"{self.out.path}/{m.segments[-1].name}")) is not None and size < segment_bytes:
            try:
                for _ in scan_records(self.out.system, at):
                    pass
                self.out.resume(m.segments[-1].name, size)
            except CodecError:
                pass

    def append(self, records: Sequence[tuple[int, int, Sequence[bytes]]]) -> None:
        """Write ``(lsn, command, arguments)`` records as one batch."""
        if not records:
            return
        lsn = np.array([r[0] for r in records], np.uint64)
        sizes = np.array([len(a) for r in records for a in r[2]], np.int64)
        data = np.frombuffer(b"".join(bytes(a) for r in records for a in r[2]), np.uint8)
        body, _ = encode_records(lsn, np.array([r[1] for r in records], np.int64), np.array([len(r[2]) for r in records], np.int64), sizes, data)
        low, high = int(lsn.min()), int(lsn.max())
        opened = self.out.write(body, low, high)
        self.out.flush()
        breaks = self.ordered and low < self.next_lsn
        if opened or breaks:
            append_manifest(self.folder, [Segment(self.out.name, low)] if opened else [], None, breaks)
        self.ordered &= not breaks
        self.next_lsn = max(self.next_lsn, high + 1)

    def close(self) -> None:
        if self.out.out is not None:
            self.out.close()
            append_manifest(self.folder, [], self.next_lsn - 1)

    def __enter__(self) -> LogAppender:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class WalDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WalReader:
        return WalReader(self.options)

    def streamReader(self, schema) -> WalStreamReader:
        return WalStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> WalWriter:
        return WalWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WalDataSource)
