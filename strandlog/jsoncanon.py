"""Canonical text of JSON values: equal texts if and only if the parsed values are equal."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from typing import Any


def _reject(name: str) -> None:
    raise ValueError(name)


def _number(text: str) -> int | float:
    """A number by value: whole ones as int (1, 1.0 and 1e0 are equal), others as double."""
    exact = Decimal(text)
    if exact.adjusted() < 400 and exact == exact.to_integral_value():
        return int(exact)
    return float(text)


def _integer(text: str) -> int | float:
    return int(text) if len(text) < 4000 else float(text)


def _make() -> json.JSONDecoder:
    return json.JSONDecoder(parse_float=_number, parse_int=_integer, parse_constant=_reject)


_DECODER = _make()
_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false|null")


def _parse_deep(text: str) -> Any:
    """A parser without recursion, for values nested deeper than the interpreter's stack."""
    root: list = []
    stack: list[tuple[Any, str | None]] = []
    holder: Any = root
    pos, size = _SPACE.match(text).end(), len(text)
    key: str | None = None
    expect_value = True

    def skip(p: int) -> int:
        return _SPACE.match(text, p).end()

    def put(value: Any) -> None:
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)

    def read_key(p: int) -> int:
        nonlocal key
        if p >= size or text[p] != '"':
            raise ValueError("name expected")
        key, p = json.decoder.scanstring(text, p + 1, True)
        p = skip(p)
        if p >= size or text[p] != ":":
            raise ValueError("colon expected")
        return skip(p + 1)

    while True:
        if expect_value:
            if pos >= size:
                raise ValueError("value expected")
            c = text[pos]
            if c in "{[":
                value: Any = {} if c == "{" else []
                put(value)
                stack.append((holder, key))
                holder, pos = value, skip(pos + 1)
                if pos < size and text[pos] == ("}" if c == "{" else "]"):
                    expect_value = False
                elif c == "{":
                    pos = read_key(pos)
                continue
            if c == '"':
                value, pos = json.decoder.scanstring(text, pos + 1, True)
            else:
                m = _ATOM.match(text, pos)
                if not m:
                    raise ValueError("value expected")
                value, pos = _DECODER.decode(m[0]), m.end()
            put(value)
            expect_value, pos = False, skip(pos)
            continue
        if not stack:
            if pos != size:
                raise ValueError("text after the value")
            return root[0]
        if pos >= size:
            raise ValueError("unfinished")
        c = text[pos]
        if c == ("}" if isinstance(holder, dict) else "]"):
            holder, key = stack.pop()
            pos = skip(pos + 1)
        elif c == ",":
            pos = skip(pos + 1)
            if isinstance(holder, dict):
                pos = read_key(pos)
            expect_value = True
        else:
            raise ValueError("comma expected")


def parse(text: str | None) -> Any:
    """The value of a JSON text by JSON's grammar, at any depth; ValueError if it is none.

    A repeated name keeps its last value. Whole numbers become int however spelled.
    """
    if text is None:
        raise ValueError("null")
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _parse_deep(text)


def canonical(value: Any, ascii: bool = True) -> str:
    """Sorted names, no blanks, numbers by value; without recursion beyond the stack. ``ascii`` escapes all other characters."""
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii)
    except RecursionError:
        return _write_deep(value, ascii)


def _write_deep(value: Any, ascii: bool = True) -> str:
    out: list[str] = []
    todo: list[Any] = [value]
    literal = type("Literal", (str,), {})
    while todo:
        v = todo.pop()
        if isinstance(v, literal):
            out.append(str(v))
        elif isinstance(v, dict):
            parts: list[Any] = [literal("{")]
            for i, k in enumerate(sorted(v)):
                parts += [literal(("," if i else "") + json.dumps(k, ensure_ascii=ascii) + ":"), v[k]]
            todo += [*parts, literal("}")][::-1]
        elif isinstance(v, list):
            parts = [literal("[")]
            for i, x in enumerate(v):
                parts += [literal(","), x] if i else [x]
            todo += [*parts, literal("]")][::-1]
        else:
            out.append(json.dumps(v, ensure_ascii=ascii))
    return "".join(out)


def _side(text: str | None, drop_nulls: bool) -> str:
    if text is None:
        return "{}"
    try:
        value = parse(text)
    except ValueError:
        return "!" + text  # no JSON text begins so
    if drop_nulls and isinstance(value, dict):
        value = {k: v for k, v in value.items() if v is not None}
    return canonical(value)


def canonical_content(props: str | None, refs: str | None, null_refs: bool = True) -> bytes:
    """Props and refs as one canonical text: equal if and only if the contents are equal.

    Null means ``{}``; top-level properties with null do not count, nor, without
    ``null_refs``, references with null.
    """
    return (_side(props, True) + "\n" + _side(refs, not null_refs)).encode("utf-8", "surrogatepass")
