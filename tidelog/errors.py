"""Errors of the client surface and of the codecs."""

from __future__ import annotations


class TidelogError(Exception):
    code = "error"


class CodecError(TidelogError, ValueError):
    code = "codec"


class KeyNotFound(TidelogError, KeyError):
    code = "key not found"

    def __str__(self) -> str:
        return f"key not found: {self.args[0]!r}" if self.args else "key not found"


class InvalidArgument(TidelogError, ValueError):
    code = "invalid argument"


class ConnectionFailed(TidelogError):
    code = "connection"


class NetworkFailed(TidelogError):
    code = "network"


class ServerError(TidelogError):
    code = "server"


class ReadOnly(ServerError):
    code = "read only"


class Cancelled(TidelogError):
    code = "cancelled"
