"""Reading loosely typed JSON values: what is missing, what is a number, how names compare."""

from __future__ import annotations

import json
import re

#: Texts that stand for a missing value, trimmed and in upper case (fixed values).
MISSING_TEXTS = frozenset({"", "NA", "N/A", "NULL"})
_NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_NOT_NAME = re.compile(r"[^A-Z0-9]+")


def plain_name(name: str) -> str:
    """A field name in upper case without all but letters A-Z and digits."""
    return _NOT_NAME.sub("", name.upper())


def _refuse(text: str):
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_constant=_refuse)


def json_object(text: str | None) -> dict | None:
    """The object a text holds; None for null, broken, partial or other JSON (NaN and Infinity aren't JSON)."""
    if text is None:
        return None
    try:
        value = _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None
    return value if type(value) is dict else None


def is_missing(value) -> bool:
    """Whether a JSON value is null or a text that stands for a missing value."""
    return value is None or type(value) is str and value.strip().upper() in MISSING_TEXTS


def as_number(value) -> float | None:
    """A JSON number, or a trimmed text of sign, digits, decimal part and exponent; else None (booleans are none)."""
    kind = type(value)
    if kind is float:
        return value
    if kind is int:
        try:
            return float(value)
        except OverflowError:
            return float("inf") if value > 0 else float("-inf")
    if kind is str and _NUMBER.fullmatch(text := value.strip()):
        return float(text)
    return None


def words_of(value) -> str:
    """A value that is not missing as trimmed text; what is no text as its JSON."""
    return value.strip() if type(value) is str else json.dumps(value, ensure_ascii=False)
