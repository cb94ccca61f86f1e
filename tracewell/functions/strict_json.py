"""JSON as RFC 8259 has it: no duplicate keys, no NaN, nothing after the value, no lone surrogates.

Spark's own readers are more lenient (``from_json`` keeps the last of duplicate keys, ``try_parse_json``
lets trailing text pass), so operators that must tell readable from unreadable use this inside Arrow
batches. Values may be nested to any depth: what is too deep for the library's recursion is read and
written with a stack of its own.
"""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from typing import Any

_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


class IntegerText(str):
    """An integer literal as it is spelled."""


class FloatText(str):
    """A literal with a fraction or exponent as it is spelled."""


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("duplicate key")
    return found


def _refuse(name: str) -> Any:
    raise ValueError(f"{name} is no JSON")


_plain = json.JSONDecoder(object_pairs_hook=_unique, parse_constant=_refuse)
_as_text = json.JSONDecoder(object_pairs_hook=_unique, parse_constant=_refuse, parse_int=IntegerText, parse_float=FloatText)


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}
_WORD = re.compile("true|false|null")


def _scalar(text: str, at: int, numbers_as_text: bool) -> tuple[Any, int]:
    if text[at : at + 1] == '"':
        value, end = scanstring(text, at + 1, True)
        value.encode()  # a lone surrogate is an error
        return value, end
    if m := _WORD.match(text, at):
        return _WORDS[m.group()], m.end()
    if m := _NUMBER.match(text, at):
        whole = m.group(2) is None and m.group(3) is None
        if numbers_as_text:
            return (IntegerText if whole else FloatText)(m.group()), m.end()
        return (int if whole else float)(m.group()), m.end()
    raise ValueError(f"no value at {at}")


def _deep(text: str, numbers_as_text: bool) -> Any:
    """``loads`` with a stack instead of recursion."""
    space = lambda at: _SPACE.match(text, at).end()
    stack: list[tuple[Any, str | None]] = []  # what is open, with the key whose value is read in it
    at = space(0)

    def key(at: int) -> tuple[str, int]:
        name, at = _scalar(text, at, False) if text[at : at + 1] == '"' else (None, at)
        at = space(at)
        if name is None or text[at : at + 1] != ":":
            raise ValueError(f"no key at {at}")
        return name, space(at + 1)

    while True:
        if text[at : at + 1] in ("{", "["):
            new: Any = {} if text[at] == "{" else []
            at = space(at + 1)
            if text[at : at + 1] != ("}" if isinstance(new, dict) else "]"):
                name = None
                if isinstance(new, dict):
                    name, at = key(at)
                stack.append((new, name))
                continue
            value, at = new, at + 1
        else:
            value, at = _scalar(text, at, numbers_as_text)
        while True:  # ``value`` is whole: put it where it belongs
            at = space(at)
            if not stack:
                if at != len(text):
                    raise ValueError(f"more after the value at {at}")
                return value
            holder, name = stack.pop()
            if isinstance(holder, dict):
                if name in holder:
                    raise ValueError("duplicate key")
                holder[name] = value
            else:
                holder.append(value)
            sign, at = text[at : at + 1], space(at + 1)
            if sign == ",":
                name = None
                if isinstance(holder, dict):
                    name, at = key(at)
                stack.append((holder, name))
                break
            if sign != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(f"neither more nor an end at {at}")
            value = holder


def loads(text: str, numbers_as_text: bool = False) -> Any:
    """The value of ``text``, however deep it is; ValueError if it isn't strict JSON."""
    try:
        value = (_as_text if numbers_as_text else _plain).decode(text)
        if _SURROGATE.search(text):
            json.dumps(value, ensure_ascii=False).encode()
    except RecursionError:
        return _deep(text, numbers_as_text)
    return value


def compact(value: Any) -> str:
    """``value`` as JSON without spaces, however deep it is."""
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[bool, Any]] = [(False, value)]  # (written as it is, value or text), the next one last
    while todo:
        plain, x = todo.pop()
        if plain:
            out.append(x)
        elif isinstance(x, (dict, list)) and x:
            parts: list[tuple[bool, Any]] = []
            for y in x.items() if isinstance(x, dict) else x:
                parts += [(True, "," if parts else "{" if isinstance(x, dict) else "[")]
                parts += [(True, json.dumps(y[0], ensure_ascii=False) + ":"), (False, y[1])] if isinstance(x, dict) else [(False, y)]
            todo += [(True, "}" if isinstance(x, dict) else "]"), *reversed(parts)]
        else:
            out.append(json.dumps(x, ensure_ascii=False, separators=(",", ":")))
    return "".join(out)


_any_keys = json.JSONDecoder(parse_constant=_refuse)


def loads_but_keys(text: str) -> Any:
    """``loads`` without a look at keys that come twice: the last one counts. Nothing of Python's runs per object, so it is much quicker."""
    try:
        value = _any_keys.decode(text)
        if _SURROGATE.search(text):
            json.dumps(value, ensure_ascii=False).encode()
    except RecursionError:
        return _deep(text, False)
    return value


def loads_or_none(text: str | None) -> Any:
    """The value of ``text``, or None if it is null or isn't strict JSON."""
    if text is None:
        return None
    try:
        return loads(text)
    except ValueError:
        return None


def observation(text: str | None, embedded: tuple[str, ...] = ("payload",)) -> Any:
    """A ledger document, in which the ``embedded`` fields may be stored as strings that hold JSON."""
    value = loads_or_none(text)
    if isinstance(value, dict):
        for name in embedded:
            if isinstance(value.get(name), str):
                inner = loads_or_none(value[name])
                if isinstance(inner, (dict, list)):
                    value[name] = inner
    return value
