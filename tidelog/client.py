"""A client of a table: one key at a time, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable

from tidelog.config import ClientConfig
from tidelog.errors import InvalidArgument
from tidelog.retry import retry
from tidelog.sources.codec import encode_command
from tidelog.table import KvTable


class Client:
    """``get``, ``set``, ``delete`` and ``ping``; keys and values are bytes or text (``get_text`` gives text back).

    What fails for the connection's sake is tried again by the configuration's back-off; refusals are not. A command whose frame
    exceeds ``max_message_size`` is refused before anything is sent.
    """

    def __init__(self, table: KvTable, config: ClientConfig = ClientConfig(), sleep: Callable[[float], None] = time.sleep):
        self.table, self.config, self._sleep = table, config.check(), sleep

    def _do[T](self, work: Callable[[], T], name: str, key: bytes = b"", value: bytes = b"") -> T:
        if len(encode_command(name, key, value)) > self.config.max_message_size:
            raise InvalidArgument("message too large")
        return retry(work, self.config.backoff, self._sleep)

    @staticmethod
    def _bytes(x: bytes | str) -> bytes:
        return x.encode() if isinstance(x, str) else bytes(x)

    def get(self, key: bytes | str) -> bytes:
        k = self._bytes(key)
        return self._do(lambda: self.table.get(k), "GET", k)

    def get_text(self, key: bytes | str) -> str:
        return self.get(key).decode("utf-8", "replace")

    def set(self, key: bytes | str, value: bytes | str) -> None:
        k, v = self._bytes(key), self._bytes(value)
        self._do(lambda: self.table.set(k, v), "SET", k, v)

    def delete(self, key: bytes | str) -> None:
        k = self._bytes(key)
        self._do(lambda: self.table.delete(k), "DEL", k)

    def ping(self) -> bool:
        return retry(self.table.ping, self.config.backoff, self._sleep)
