"""Keyset cursors: the ordering they were made under and the last row's key and id."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..schema import EngineError

VERSION = 1
_TOKEN = re.compile(r"flc(\d+):(id|valid_from|observed_at):(asc|desc):(-?\d+):(\d+)")


@dataclass(frozen=True)
class Cursor:
    order: str
    newest_first: bool
    key: int
    id: int

    def encode(self) -> str:
        return f"flc{VERSION}:{self.order}:{'desc' if self.newest_first else 'asc'}:{self.key}:{self.id}"

    @staticmethod
    def decode(token: str) -> Cursor:
        m = _TOKEN.fullmatch(token) if isinstance(token, str) and token.isascii() else None
        if m and int(m[1]) != VERSION:
            raise EngineError(f"a cursor of version {m[1]}; this engine's have {VERSION}")
        if m is None or int(m[5]) == 0 or max(abs(int(m[4])), int(m[5])) >= 1 << 63:
            raise EngineError(f"'{token}' is no cursor")
        return Cursor(m[2], m[3] == "desc", int(m[4]), int(m[5]))
