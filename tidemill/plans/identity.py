"""Identity grammar of graphs, nodes, ports and stages."""

from __future__ import annotations

import re

_SEGMENT = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*\Z")
MAX_SEGMENT, MAX_SEGMENTS, MAX_NODE_ID = 64, 16, 256


def segment(what: str, text: str) -> str:
    """One lower-case name: letters and digits, single hyphens inside, 64 characters at most."""
    if not isinstance(text, str) or len(text) > MAX_SEGMENT or not _SEGMENT.match(text):
        raise ValueError(f"{what} {text!r} is not a valid identifier")
    return text


def node_id(text: str) -> str:
    """Up to 16 segments joined by slashes, 256 characters at most."""
    parts = text.split("/") if isinstance(text, str) else []
    if not parts or len(parts) > MAX_SEGMENTS or len(text) > MAX_NODE_ID:
        raise ValueError(f"node id {text!r} is not valid")
    for p in parts:
        segment("node id segment", p)
    return text


def major_version(what: str, n: int) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError(f"{what} must be a whole number from 1, not {n!r}")
    return n


def automatic_name(n: int) -> str:
    if n > 9999:
        raise ValueError("a graph has at most 9999 stages without a name")
    return f"stage-{n:04d}"
