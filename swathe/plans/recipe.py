"""Saving pipeline parts as JSON: dataclasses, nested, with paths and tuples kept apart from strings and lists."""

from __future__ import annotations

import dataclasses
import json
from pathlib import PurePath
from typing import Any

_KIND = "$kind"


def encode(value: Any) -> Any:
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {_KIND: type(value).__name__, "fields": {f.name: encode(getattr(value, f.name)) for f in dataclasses.fields(value)}}
    if isinstance(value, PurePath):
        return {_KIND: "$path", "value": str(value)}
    if isinstance(value, tuple):
        return {_KIND: "$tuple", "value": [encode(v) for v in value]}
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("keys of saved dictionaries are strings")
        plain = {k: encode(v) for k, v in value.items()}
        return {_KIND: "$dict", "value": plain} if _KIND in value else plain
    if isinstance(value, list):
        return [encode(v) for v in value]
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    raise TypeError(f"a {type(value).__name__} can't be saved")


def decode(value: Any, symbols: dict[str, type]) -> Any:
    """``symbols``: the dataclasses that may be made, by name; others raise."""
    if isinstance(value, list):
        return [decode(v, symbols) for v in value]
    if not isinstance(value, dict):
        return value
    kind = value.get(_KIND)
    if kind is None:
        return {k: decode(v, symbols) for k, v in value.items()}
    if kind == "$path":
        from pathlib import Path

        return Path(value["value"])
    if kind == "$tuple":
        return tuple(decode(v, symbols) for v in value["value"])
    if kind == "$dict":
        return {k: decode(v, symbols) for k, v in value["value"].items()}
    if kind not in symbols:
        raise ValueError(f"unknown part: {kind}")
    return symbols[kind](**{k: decode(v, symbols) for k, v in value["fields"].items()})


def dumps(value: Any) -> str:
    return json.dumps(encode(value), indent=2, sort_keys=True)


def loads(text: str, symbols: dict[str, type]) -> Any:
    return decode(json.loads(text), symbols)
