"""Memories of Python workers, which outlive tasks: those of other operators go when an operator starts to work."""

from __future__ import annotations

from collections.abc import Callable

_FORGET: dict[str, Callable[[], None]] = {}


def register(name: str, forget: Callable[[], None]) -> None:
    _FORGET[name] = forget


def use(name: str) -> None:
    """Call at the start of a task: everything but ``name`` is forgotten."""
    for other, forget in _FORGET.items():
        if other != name:
            forget()
