"""JSON texts as values: reading, equality, kinds and shapes. Pure Python, wrapped once per operator by Arrow UDFs."""

from __future__ import annotations

import json
import re
import sys
from hashlib import blake2b

ARRAY, BOOLEAN, NUMBER, OBJECT, STRING, NULL = "array", "boolean", "number", "object", "string", "null"
_KINDS = {dict: OBJECT, list: ARRAY, str: STRING, bool: BOOLEAN, int: NUMBER, float: NUMBER, type(None): NULL}
_EXACT = 2**53

if hasattr(sys, "set_int_max_str_digits"):  # a long number is a number, not an error
    sys.set_int_max_str_digits(0)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_constant=_no_constant)
_ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"))


_STRING_OR_SCALAR = json.JSONDecoder(parse_constant=_no_constant).raw_decode
_BLANK = re.compile(r"[ \t\n\r]*")


def decode_deep(text: str):
    """The value of a JSON text of any depth: containers on a stack of its own, scalars by the library's reader."""
    skip = lambda at: _BLANK.match(text, at).end()
    at, stack, value, have = skip(0), [], None, False  # stack: [container, key of the member that comes next]
    while True:
        if not have:
            sign = text[at : at + 1]
            if sign in ("{", "["):
                stack.append([{} if sign == "{" else [], None])
                at = skip(at + 1)
                if text[at : at + 1] == ("}" if sign == "{" else "]"):
                    value, have, at = stack.pop()[0], True, at + 1
                elif sign == "{":
                    stack[-1][1], at = _member(text, at, skip)
                continue
            if not sign:
                raise ValueError("text ends too early")
            value, at = _STRING_OR_SCALAR(text, at)
            have = True
            continue
        at = skip(at)
        if not stack:
            if at != len(text):
                raise ValueError("text goes on after the value")
            return value
        top, sign = stack[-1], text[at : at + 1]
        if type(top[0]) is dict:
            top[0][top[1]] = value
        else:
            top[0].append(value)
        if sign == ",":
            at, have = skip(at + 1), False
            if type(top[0]) is dict:
                top[1], at = _member(text, at, skip)
        elif sign == ("}" if type(top[0]) is dict else "]"):
            value, at = stack.pop()[0], at + 1
        else:
            raise ValueError(f"no JSON at {at}")


def _member(text: str, at: int, skip) -> tuple[str, int]:
    """(name, place of the value) of an object's member."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no name at {at}")
    name, at = _STRING_OR_SCALAR(text, at)
    at = skip(at)
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return name, skip(at + 1)


def _decode(text: str):
    try:
        return _DECODER.decode(text)
    except RecursionError:  # nested deeper than the library's reader goes; the same values, only slower
        return decode_deep(text)


def readable(text: str | None) -> dict | None:
    """The object that text holds, directly or as a string that itself holds such text; None for anything else. Any depth."""
    value = text
    try:
        while isinstance(value, str):
            value = _decode(value)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def kind(value: object) -> str:
    return _KINDS[type(value)]


def _plain(value):
    """Numbers of equal value get one spelling: 5.0 and 5e0 are 5."""
    kind_of = type(value)
    if kind_of is float:
        return int(value) if value.is_integer() and abs(value) < _EXACT else value
    if kind_of is dict:
        return {k: _plain(v) for k, v in value.items()}
    if kind_of is list:
        return [_plain(v) for v in value]
    return value


def canonical(value: object) -> str:
    """One ASCII text per JSON value: sorted keys, no blanks, one spelling of each number and string. Any depth."""
    try:
        return _ENCODER.encode(_plain(value))
    except RecursionError:
        return canonical_deep(value)


def canonical_deep(value: object) -> str:
    """What canonical() gives, by a stack of its own."""
    out: list[str] = []
    todo: list = [(value,)]  # (value,) is still to be written, a str is written as it is
    while todo:
        item = todo.pop()
        if type(item) is str:
            out.append(item)
            continue
        v = item[0]
        if type(v) is dict:
            parts: list = ["{"]
            for i, k in enumerate(sorted(v)):
                parts += [("," if i else "") + _ENCODER.encode(k) + ":", (v[k],)]
            todo += reversed([*parts, "}"])
        elif type(v) is list:
            parts = ["["]
            for i, c in enumerate(v):
                parts += [",", (c,)] if i else [(c,)]
            todo += reversed([*parts, "]"])
        else:
            out.append(_ENCODER.encode(_plain(v)))
    return "".join(out)


def digest(text: str) -> int:
    """A signed 64-bit hash."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def value_digest(value: object) -> int:
    """Equal for equal JSON values; strings, the most frequent kind, skip the encoder."""
    return digest('"' + value) if type(value) is str else digest(canonical(value))


def clean(text: str) -> str:
    """Text that UTF-8 can hold: lone surrogates, possible through escapes, become U+FFFD."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")


def pointer_step(key: str) -> str:
    """One reference token of a JSON Pointer."""
    return "/" + key.replace("~", "~0").replace("/", "~1")
