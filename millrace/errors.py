"""Errors with MySQL numbers."""

from __future__ import annotations

#: SQLSTATE by error number; other numbers are HY000.
STATES = {1022: "23000", 1044: "42000", 1046: "3D000", 1050: "42S01", 1051: "42S02", 1054: "42S22", 1062: "23000", 1064: "42000", 1136: "21S01", 1142: "42000", 1146: "42S02", 1222: "21000", 1305: "42000", 1329: "02000", 1451: "23000", 1452: "23000", 1582: "42000", 3819: "HY000"}


class EngineError(Exception):
    def __init__(self, code: int, message: str, state: str | None = None):
        super().__init__(f"ERROR {code} ({state or STATES.get(code, 'HY000')}): {message}")
        self.code, self.state, self.message = code, state or STATES.get(code, "HY000"), message
