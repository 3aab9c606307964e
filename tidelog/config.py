"""Configuration with its bounds: the server's sections, as its YAML file names them, and the client's."""

from __future__ import annotations

import ipaddress
import os
import warnings
from dataclasses import dataclass, field, fields, replace

from tidelog.errors import InvalidArgument
from tidelog.retry import Backoff

SIZE_UNITS = {"": 1, "B": 1, "KB": 2**10, "MB": 2**20, "GB": 2**30}

# Names and bounds of the settings.
ENGINES = ("in_memory",)
LEVELS = ("debug", "info", "warn", "error", "fatal")
ROLES = ("master", "slave")
PORTS = (1024, 65535)
CONNECTIONS = (1, 10_000)
FLUSH = (5, 1000)
SEGMENT = (4 << 10, 100 << 20)


def _within(name: str, value, low: int, high: int | None) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or value < low or (high is not None and value > high):
        raise InvalidArgument(f"{name} must be a whole number from {low}{f' to {high}' if high is not None else ' on'}, not {value!r}")


def _one_of(name: str, value, known: tuple[str, ...]) -> None:
    if value not in known:
        raise InvalidArgument(f"{name} must be one of {', '.join(known)}, not {value!r}")


def _port(name: str, value) -> None:
    _within(name, int(value) if str(value).isdigit() else value, *PORTS)


@dataclass(frozen=True)
class EngineConfig:
    type: str = "in_memory"

    def check(self) -> None:
        _one_of("engine.type", self.type, ENGINES)


@dataclass(frozen=True)
class NetworkConfig:
    """Of these, ``max_message_size`` bounds commands (``KvTable.apply``); the rest is kept for the server's sake."""

    ip: str = "127.0.0.1"
    port: int = 3223
    max_connections: int = 100
    max_message_size: int = 4096
    idle_timeout: int = 300
    graceful_shutdown_timeout: int = 5

    def check(self) -> None:
        try:
            ipaddress.ip_address(self.ip)
        except ValueError:
            raise InvalidArgument(f"network.ip is not an address: {self.ip!r}") from None
        _port("network.port", self.port)
        _within("network.max_connections", self.max_connections, *CONNECTIONS)
        _within("network.max_message_size", self.max_message_size, 1, None)
        _within("network.idle_timeout", self.idle_timeout, 1, None)
        _within("network.graceful_shutdown_timeout", self.graceful_shutdown_timeout, 0, None)


@dataclass(frozen=True)
class LoggingConfig:
    level: str = "info"
    output: str = "stdout"

    def check(self) -> None:
        _one_of("logging.level", self.level, LEVELS)


@dataclass(frozen=True)
class WalConfig:
    flush_batch_size: int = 100
    flush_batch_timeout: int = 10
    max_segment_size: int = 10 << 20
    data_directory: str = "data/wal"

    def check(self) -> None:
        _within("wal.flush_batch_size", self.flush_batch_size, *FLUSH)
        _within("wal.flush_batch_timeout", self.flush_batch_timeout, *FLUSH)
        _within("wal.max_segment_size", self.max_segment_size, *SEGMENT)
        if not self.data_directory:
            raise InvalidArgument("wal.data_directory must not be empty")


@dataclass(frozen=True)
class ReplicationConfig:
    role: str = "master"
    master_address: str = ""
    master_port: int | str = ""
    slave_id: str = ""

    def check(self) -> None:
        _one_of("replication.role", self.role, ROLES)
        if self.role == "slave" and not (self.master_address and self.master_port):
            raise InvalidArgument("a slave needs replication.master_address and replication.master_port")


@dataclass(frozen=True)
class Config:
    """A server's settings, and the table's own: ``shards``, ``read_only`` and ``log_format`` (``parquet`` or ``wal``).

    Replication needs a log, as a replica is one. A slave's tables are read-only.
    """

    engine: EngineConfig = EngineConfig()
    network: NetworkConfig = NetworkConfig()
    logging: LoggingConfig = LoggingConfig()
    wal: WalConfig | None = field(default_factory=WalConfig)
    replication: ReplicationConfig | None = None
    shards: int = 8
    read_only: bool = False
    log_format: str = "parquet"

    def check(self) -> Config:
        for section in (self.engine, self.network, self.logging, self.wal, self.replication):
            if section is not None:
                section.check()
        _within("shards", self.shards, 1, 1 << 16)
        _one_of("log_format", self.log_format, ("parquet", "wal"))
        if self.replication and not self.wal:
            raise InvalidArgument("WAL configuration is required when replication is enabled")
        return self

    @property
    def refuses_writes(self) -> bool:
        return self.read_only or (self.replication is not None and self.replication.role == "slave")


@dataclass(frozen=True)
class ClientConfig:
    """A client's settings; ``with_`` gives a copy with some of them changed. Times are in milliseconds."""

    host: str = "127.0.0.1"
    port: int = 3223
    connection_timeout_ms: int = 10_000
    operation_timeout_ms: int = 5_000
    max_message_size: int = 4096
    retry_attempts: int = 3
    retry_base_delay_ms: int = 100
    retry_max_delay_ms: int = 5_000
    retry_jitter: bool = True

    def check(self) -> ClientConfig:
        rules = (
            (bool(self.host), "host cannot be empty"),
            (0 < self.port <= 65535, "port must be between 1 and 65535"),
            (self.connection_timeout_ms > 0, "connection timeout must be positive"),
            (self.operation_timeout_ms > 0, "operation timeout must be positive"),
            (self.max_message_size > 0, "max message size must be positive"),
            (self.retry_attempts >= 0, "retry attempts cannot be negative"),
            (self.retry_base_delay_ms >= 0, "retry base delay cannot be negative"),
            (self.retry_max_delay_ms >= 0, "retry max delay cannot be negative"),
            (not 0 < self.retry_max_delay_ms < self.retry_base_delay_ms, "retry base delay cannot be greater than max delay"),
        )
        for good, why in rules:
            if not good:
                raise InvalidArgument(why)
        return self

    def with_(self, **changes) -> ClientConfig:
        return replace(self, **changes)

    @property
    def backoff(self) -> Backoff:
        return Backoff(self.retry_attempts, self.retry_base_delay_ms, self.retry_max_delay_ms, self.retry_jitter)


def parse_size(text: str | int) -> int:
    """``10MB`` and the like in bytes."""
    if isinstance(text, int):
        return text
    digits = text.strip().rstrip("KMGBkmgb")
    unit = text.strip()[len(digits) :].upper()
    if not digits.isdigit() or unit not in SIZE_UNITS:
        raise InvalidArgument(f"not a size: {text!r}")
    return int(digits) * SIZE_UNITS[unit]


def load(path: str | None = None) -> Config:
    """Settings of a YAML file (by default the one in CONFIG_FILEPATH, else config.yaml).

    Settings that it leaves out have defaults, and so do the sections but ``wal`` and ``replication``, which are off unless they are there.
    Settings that are not known are left alone with a warning.
    """
    import yaml

    with open(path or os.environ.get("CONFIG_FILEPATH", "config.yaml"), encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}

    def known(cls, d: dict, where: str) -> dict:
        names = {x.name for x in fields(cls)}
        if extra := set(d) - names:
            warnings.warn(f"unknown settings: {', '.join(where + x for x in sorted(extra))}", stacklevel=3)
        return {k: v for k, v in d.items() if k in names}

    sections = {"engine": EngineConfig, "network": NetworkConfig, "logging": LoggingConfig, "wal": WalConfig, "replication": ReplicationConfig}
    out = {"wal": None} | known(Config, data, "")
    for name, cls in sections.items():
        if isinstance(d := out.get(name), dict):
            if name == "wal" and "max_segment_size" in d:
                d = d | {"max_segment_size": parse_size(d["max_segment_size"])}
            out[name] = cls(**known(cls, d, f"{name}."))
        elif name in out and (d is not None or name not in ("wal", "replication")):
            raise InvalidArgument(f"{name} must be a section")
    return replace(Config(), **out).check()
