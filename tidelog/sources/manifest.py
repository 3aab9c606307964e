"""The segment manifest: a text file of ``name,first LSN`` lines in the order in which segments were opened.

Two more kinds of line, which other readers skip as malformed, spare reading segments: ``#top=n/bytes``, the greatest LSN of all
segments above it while the last of them has so many bytes, and ``#unordered``, after which starts no longer bound what lies between.
"""

from __future__ import annotations

from typing import NamedTuple

from tidelog.errors import CodecError
from tidelog.sources.codec import scan_records
from tidelog.sources.files import append_text, place, read_text, size_of

MANIFEST = "metadata.txt"
UNORDERED = "#unordered"
TOP = "#top="

# Fixed value: how far the next LSN is set ahead when the log cannot be read to its end.
LOST_LSN_STEP = 10_000


class Segment(NamedTuple):
    name: str
    lsn_start: int


class Manifest(NamedTuple):
    """``segments`` in file order; ``top``: the greatest LSN of the first ``counted`` of them, -1 for none, as of ``last_bytes`` bytes in the last of
    those; ``ordered``: whether each segment's LSNs lie above those before it."""

    segments: list[Segment]
    top: int
    counted: int
    last_bytes: int
    ordered: bool


def load_manifest(folder: str) -> Manifest:
    """Malformed lines are skipped; without a file there are no segments."""
    system, path = place(folder)
    segments, top, counted, size, ordered = [], -1, 0, 0, True
    for line in (read_text(system, f"{path}/{MANIFEST}") or "").splitlines():
        line = line.strip()
        name, comma, start = line.rpartition(",")
        if comma and name and start.strip().isdigit():
            segments.append(Segment(name.strip(), int(start)))
        elif line.startswith(TOP) and all(x.isdigit() for x in line[len(TOP) :].split("/")) and line.count("/") == 1:
            lsn, size = map(int, line[len(TOP) :].split("/"))
            top, counted = max(top, lsn), len(segments)
        elif line == UNORDERED:
            ordered = False
    return Manifest(segments, top, counted, size, ordered)


def read_manifest(folder: str) -> list[Segment]:
    return load_manifest(folder).segments


def is_ordered(folder: str) -> bool:
    return load_manifest(folder).ordered


def append_manifest(folder: str, segments: list[Segment], top: int | None = None, unordered: bool = False) -> None:
    """Entries become visible together, after their bytes are on disk."""
    system, path = place(folder)
    lines = [f"{s.name},{s.lsn_start}" for s in segments] + ([UNORDERED] if unordered else [])
    if top is not None and top >= 0:
        last = segments[-1] if segments else read_manifest(folder)[-1]
        lines.append(f"{TOP}{top}/{size_of(system, f'{path}/{last.name}')}")
    if lines:
        append_text(system, f"{path}/{MANIFEST}", "".join(f"{line}\n" for line in lines))


def segment_for_lsn(segments: list[Segment], lsn: int) -> int:
    """Index of the last segment in file order that starts at or before ``lsn``; below the first, the first."""
    found = 0
    for i, s in enumerate(segments):
        if s.lsn_start > lsn:
            break
        found = i
    return found


def greatest_lsn(folder: str) -> int:
    """The greatest LSN of the log, -1 if it holds none. Only segments that the manifest has no ``#top`` for are read, in pieces."""
    m = load_manifest(folder)
    system, path = place(folder)
    top, counted = m.top, m.counted
    if counted and size_of(system, f"{path}/{m.segments[counted - 1].name}") != m.last_bytes:
        counted -= 1  # somebody has gone on writing to it
    for s in m.segments[counted:]:
        for found in scan_records(system, f"{path}/{s.name}"):
            top = max(top, int(found.lsn.max(initial=0)) if len(found.lsn) else -1)
    return top


def next_lsn(folder: str) -> int:
    """The LSN after everything in the log; after damage one that cannot have been given out yet."""
    try:
        return greatest_lsn(folder) + 1
    except (CodecError, FileNotFoundError):
        m = load_manifest(folder)
        return max(max(s.lsn_start for s in m.segments) + LOST_LSN_STEP, m.top + 1)
