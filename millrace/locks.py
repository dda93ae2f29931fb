"""Advisory locks by name, held by sessions of one driver."""

from __future__ import annotations

import threading
import time

_held: dict[str, tuple[int, int]] = {}  # name -> (session, times taken)
_changed = threading.Condition()


def get_lock(session: int, name: str, timeout: float) -> int:
    """1 if the lock was taken within ``timeout`` seconds (below 0: for ever), else 0; a session may take it again."""
    end = None if timeout < 0 else time.monotonic() + timeout
    with _changed:
        while (owner := _held.get(name)) and owner[0] != session:
            left = None if end is None else end - time.monotonic()
            if left is not None and left <= 0:
                return 0
            _changed.wait(left)
        _held[name] = (session, owner[1] + 1 if owner else 1)
        return 1


def release_lock(session: int, name: str) -> int | None:
    """1 if released, 0 if another session holds it, None if none does."""
    with _changed:
        owner = _held.get(name)
        if not owner:
            return None
        if owner[0] != session:
            return 0
        if owner[1] > 1:
            _held[name] = (session, owner[1] - 1)
        else:
            del _held[name]
            _changed.notify_all()
        return 1


def is_used_lock(name: str) -> int | None:
    with _changed:
        return _held[name][0] if name in _held else None


def release_all(session: int) -> int:
    with _changed:
        own = [(n, o) for n, o in _held.items() if o[0] == session]
        for n, _ in own:
            del _held[n]
        _changed.notify_all()
        return sum(o[1] for _, o in own)
