"""What a Python worker remembers between tasks, for one kind of work at a time.

Workers live longer than stages. When a task of another kind begins, what the
kinds before remembered is dropped and given back to the system, so memory is
that of the largest kind and not of all of them together.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa

_forget: dict[str, Callable[[], None]] = {}
_now: list[str] = []


def remembers(kind: str, forget: Callable[[], None]) -> None:
    """Name how the memory of a kind of work is dropped."""
    _forget[kind] = forget


def enter(kind: str) -> None:
    """A task of this kind begins in this worker."""
    if _now != [kind]:
        for other, forget in _forget.items():
            if other != kind:
                forget()
        give_back()
        _now[:] = [kind]


def give_back() -> None:
    """Free pages that the allocators hold go back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)
