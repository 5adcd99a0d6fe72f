"""Canonical JSON: one byte sequence for one value, and its fingerprint."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from tidemill.errors import GraphDocumentFormatError

MAX_DEPTH, MAX_BYTES = 64, 256 * 1024


def _text(s: str) -> str:
    out = []
    for c in s:
        if c in '"\\':
            out.append("\\" + c)
        elif c < " ":
            out.append(f"\\u{ord(c):04x}")
        else:
            out.append(c)
    return '"' + "".join(out) + '"'


def write(value: Any, *, sort: bool = True, depth: int = 0) -> str:
    """Minified; integers only; keys by UTF-16 code unit if sort, else in the order given."""
    if depth > MAX_DEPTH:
        raise ValueError(f"a value is nested deeper than {MAX_DEPTH} levels")
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise ValueError(f"{value} does not fit in 64 bits")
        return str(value)
    if isinstance(value, str):
        return _text(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(write(x, sort=sort, depth=depth + 1) for x in value) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass")) if sort else list(value)
        return "{" + ",".join(f"{_text(k)}:{write(value[k], sort=sort, depth=depth + 1)}" for k in keys) + "}"
    raise ValueError(f"{type(value).__name__} has no canonical form; parameters hold no floats")


def payload(value: Any) -> str:
    text = write(value)
    if len(text.encode()) > MAX_BYTES:
        raise ValueError(f"a payload is larger than {MAX_BYTES} bytes")
    return text


def _unique(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise GraphDocumentFormatError("a member is given twice")
    return out


def _refuse(text: str) -> Any:
    raise GraphDocumentFormatError(f"{text} is not a whole number")


def read(text: str | bytes) -> Any:
    """Parse strictly: no duplicate members, no fractions or exponents, no other constants."""
    try:
        return json.loads(text, object_pairs_hook=_unique, parse_float=_refuse, parse_constant=_refuse)
    except (json.JSONDecodeError, UnicodeDecodeError) as e:
        raise GraphDocumentFormatError(str(e)) from e


def fingerprint(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()
