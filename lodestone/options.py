"""Configuration: nested mappings, loose coercion of their values, and a reader for the YAML that configurations use."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

from .errors import InvalidArguments, SystemFailure

_INT = re.compile(r"\s*[+-]?\d+")
_FLOAT = re.compile(r"\s*[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)")


def to_int(v: Any) -> int:
    """Integers as they are, floats truncated, text by its leading integer, all else 0."""
    if isinstance(v, (bool, int, float)):
        return int(v)
    found = _INT.match(v) if isinstance(v, str) else None
    return int(found.group()) if found else 0


def to_float(v: Any) -> float:
    """Numbers as they are, text by its leading number, all else 0."""
    if isinstance(v, (bool, int, float)):
        return float(v)
    found = _FLOAT.match(v) if isinstance(v, str) else None
    return float(found.group()) if found else 0.0


def to_bool(v: Any) -> bool:
    """Integers unless 0; every float; "true", "on" and text that starts with a non-zero integer; any list or mapping; bytes unless empty."""
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v != 0
    if isinstance(v, str):
        return v.strip().lower() in ("true", "on") or to_int(v) != 0
    if isinstance(v, (bytes, bytearray)):
        return len(v) > 0
    return v is not None


def to_text(v: Any) -> str:
    """A JSON-like dump; null as (null), bytes escaped, floats in scientific form."""
    if v is None:
        return "(null)"
    if isinstance(v, str):
        return v
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:e}"
    if isinstance(v, (bytes, bytearray)):
        return "".join(f"\\x{b:02x}" for b in v)
    quoted = lambda x: json.dumps(x) if isinstance(x, str) else to_text(x)
    if isinstance(v, dict):
        return "{" + ", ".join(f"{json.dumps(str(k))}: {quoted(v[k])}" for k in sorted(v, key=str)) + "}"
    return "[" + ", ".join(map(quoted, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


class SparseList(list):
    """A list that grows when an index beyond its end is read or set; its length is the highest index touched plus 1."""

    def _grow(self, i: int) -> None:
        while len(self) <= i:
            self.append(None)

    def __getitem__(self, i):
        if isinstance(i, int) and i >= 0:
            self._grow(i)
        return super().__getitem__(i)

    def __setitem__(self, i, v):
        if isinstance(i, int) and i >= 0:
            self._grow(i)
        super().__setitem__(i, v)


def parse_yaml(text: str) -> Any:
    """The block YAML of configurations: nested maps, sequences and scalars. Every scalar is text."""
    rows = []
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line.rstrip())
        if line.strip() and line.strip() not in ("---", "..."):
            rows.append((len(line) - len(line.lstrip()), line.strip()))

    def scalar(s: str) -> Any:
        if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
            return s[1:-1]
        return None if s in ("", "~", "null") else s

    def block(i: int, indent: int) -> tuple[Any, int]:
        if rows[i][1].startswith("-") and (rows[i][1] == "-" or rows[i][1][1] == " "):
            out: list = []
            while i < len(rows) and rows[i][0] == indent and rows[i][1].startswith("-"):
                rest = rows[i][1][1:].strip()
                if not rest:
                    v, i = block(i + 1, rows[i + 1][0])
                elif re.match(r"[^'\"\s][^:]*:(\s|$)", rest):
                    rows[i] = (indent + len(rows[i][1]) - len(rest), rest)
                    v, i = block(i, rows[i][0])
                else:
                    v, i = scalar(rest), i + 1
                out.append(v)
            return out, i
        found: dict = {}
        while i < len(rows) and rows[i][0] == indent:
            key, colon, rest = rows[i][1].partition(":")
            if not colon:
                raise InvalidArguments(f"not a key: {rows[i][1]}")
            rest, i = rest.strip(), i + 1
            if rest:
                found[scalar(key.strip())] = scalar(rest)
            elif i < len(rows) and (rows[i][0] > indent or rows[i][0] == indent and rows[i][1].startswith("- ")):
                found[scalar(key.strip())], i = block(i, rows[i][0])
            else:
                found[scalar(key.strip())] = None
        return found, i

    if not rows:
        return {}
    out, end = block(0, rows[0][0])
    if end < len(rows):
        raise InvalidArguments(f"unexpected indentation: {rows[end][1]}")
    return out


def load(config: dict | str | Path) -> dict:
    """A configuration from a mapping, or from a YAML or JSON file."""
    if isinstance(config, dict):
        return config
    try:
        text = Path(config).read_text(encoding="utf-8")
    except OSError as e:
        raise SystemFailure(str(e)) from e
    out = json.loads(text) if str(config).endswith(".json") else parse_yaml(text)
    if not isinstance(out, dict):
        raise InvalidArguments("a configuration is a mapping")
    return out


def get(config: dict, path: str, default: Any = None) -> Any:
    """The value at a dotted path, or the default where any part is missing or null."""
    for part in path.split("."):
        config = config.get(part) if isinstance(config, dict) else None
    return default if config is None else config
