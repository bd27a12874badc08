"""Dataclasses to plain dictionaries and back."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from enum import Enum


def plain(x):
    """``x`` as dictionaries, lists, strings, numbers, booleans and None."""
    if isinstance(x, Serial):
        return x.to_dict()
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return {f.name.lstrip("_"): plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
    if isinstance(x, Enum):
        return x.value
    if isinstance(x, dict):
        return {str(plain(k)): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set, frozenset)):
        return [plain(v) for v in x]
    return x


def built(kind, x):
    """The inverse of ``plain`` for a type hint."""
    if x is None:
        return None
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        return built(next(a for a in args if a is not type(None)), x)
    if origin is dict:
        return {built(args[0], k): built(args[1], v) for k, v in x.items()}
    if origin in (list, tuple):
        values = [built(args[0], v) for v in x]
        return values if origin is list else tuple(values)
    if isinstance(kind, type) and issubclass(kind, Enum):
        return kind(x)
    if isinstance(kind, type) and issubclass(kind, Serial):
        return kind.from_dict(x)
    return x


class Serial:
    """A dataclass with ``to_dict``, ``from_dict``, ``to_json`` and ``from_json``; leading underscores of names are dropped."""

    def to_dict(self) -> dict:
        return {f.name.lstrip("_"): plain(getattr(self, f.name)) for f in dataclasses.fields(self)}

    @classmethod
    def from_dict(cls, data: dict):
        hints = typing.get_type_hints(cls)
        out = cls.__new__(cls)
        for f in dataclasses.fields(cls):
            name = f.name.lstrip("_")
            if name in data:
                value = built(hints[f.name], data[name])
            elif f.default is not dataclasses.MISSING:
                value = f.default
            elif f.default_factory is not dataclasses.MISSING:
                value = f.default_factory()
            else:
                raise KeyError(f"{cls.__name__} needs {name!r}")
            object.__setattr__(out, f.name, value)
        return out

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, default=str)

    @classmethod
    def from_json(cls, text: str):
        return cls.from_dict(json.loads(text))
