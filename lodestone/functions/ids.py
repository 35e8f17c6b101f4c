"""Content ids: 40 hexadecimal digits of SHA-1, and predicates on their prefixes."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArguments

_ID = re.compile(r"[0-9a-fA-F]{40}")
_HEX = re.compile(r"[0-9a-fA-F]{1,40}")


def content_id(content: Column) -> Column:
    return F.sha1(content)


def content_id_of(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()


def to_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def from_hex(text: Column) -> Column:
    """20 bytes, null unless the text is exactly 40 hexadecimal digits."""
    return F.when(text.rlike("^[0-9a-fA-F]{40}$"), F.unhex(text))


def parse_id(value: str | bytes) -> str:
    """An id given as 40 hexadecimal digits or 20 bytes."""
    if isinstance(value, (bytes, bytearray)) and len(value) == 20:
        return bytes(value).hex()
    if isinstance(value, str) and _ID.fullmatch(value):
        return value.lower()
    raise InvalidArguments(f"not an id: {value!r}")


def shard(item_id: Column, spec: str | list[str]) -> Column:
    """Rows of a shard: a prefix, or an inclusive range of prefixes of one width; a list must hold altogether.

    Each is a disjunction of startswith(), which a scan can be pruned by when the id is a stored column. Prefixes keep
    their width, so "00-0f" is sixteen prefixes of two digits.
    """
    if isinstance(spec, (list, tuple)):
        if not spec:
            raise InvalidArguments("a shard needs a prefix")
        return reduce(lambda a, b: a & b, [shard(item_id, s) for s in spec])
    low, dash, high = str(spec).strip().partition("-")
    high = high if dash else low
    if not (_HEX.fullmatch(low) and _HEX.fullmatch(high)) or len(low) != len(high) or int(low, 16) > int(high, 16):
        raise InvalidArguments(f"not a shard: {spec!r}")
    if int(high, 16) - int(low, 16) >= 256:  # one comparison of strings that a scan is pruned by, too
        return (item_id >= low.lower()) & (F.substring(item_id, 1, len(high)) <= high.lower())
    return reduce(lambda a, b: a | b, [item_id.startswith(f"{v:0{len(low)}x}") for v in range(int(low, 16), int(high, 16) + 1)])
