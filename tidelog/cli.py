"""A small interactive client: ``python -m tidelog.cli FOLDER``; commands GET key, SET key value, DEL key, HELP, EXIT."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from tidelog.errors import TidelogError

HELP = {"DEL": "DEL key", "EXIT": "EXIT", "GET": "GET key", "HELP": "HELP", "SET": "SET key value"}


def answer(table, line: str) -> str | None:
    """What the client prints for a line; None to end. Command names may be in lower case; words are split at blanks."""
    words = line.split()
    if not words:
        return ""
    name, args = words[0].upper(), [w.encode() for w in words[1:]]
    if name in ("EXIT", "QUIT"):
        return None
    if name == "HELP":
        return "\n".join(HELP[k] for k in sorted(HELP))
    if name not in HELP:
        return f"unknown command: {words[0]}"
    if len(args) != len(HELP[name].split()) - 1:
        return f"usage: {HELP[name]}"
    try:
        if name == "GET":
            return table.get(*args).decode("utf-8", "replace")
        table.set(*args) if name == "SET" else table.delete(*args)
        return "OK"
    except TidelogError as e:
        return f"error: {e}"


def session(table, lines: Iterable[str]) -> Iterator[str]:
    for line in lines:
        if (said := answer(table, line)) is None:
            return
        if said:
            yield said


def main() -> None:
    from tidelog.session import local_session
    from tidelog.table import KvTable

    table = KvTable(local_session(), sys.argv[1])
    for said in session(table, sys.stdin):
        print(said, flush=True)


if __name__ == "__main__":
    main()
