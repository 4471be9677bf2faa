"""Exact JSON: one value as VARIANT with the last of equal keys, or the place and reason of the first fault.

Spark's parser takes nearly every line.  What it cannot settle goes to a
pushdown scan in an Arrow UDF: texts it refuses (faulty ones, and objects with a
key twice), and those where it is too lenient: nesting of over ``MOST_NESTED``
levels, numbers beyond a double, and halves of surrogate pairs.  The scan reads
bytes once from left to right with an explicit stack, so no nesting exhausts
Python's own; it keeps one dictionary for each open object, whose last value wins.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import as_column, let
from .strict_json import known_json, strict_json

#: Levels of arrays and objects that a text may have.
MOST_NESTED = 127
#: Reasons of faults.
EOF_LIST, EOF_OBJECT, EOF_STRING, EOF_VALUE = (f"EOF while parsing {x}" for x in ("a list", "an object", "a string", "a value"))
COLON, LIST_COMMA, OBJECT_COMMA = "expected `:`", "expected `,` or `]`", "expected `,` or `}`"
IDENT, VALUE, ESCAPE, NUMBER, RANGE = "expected ident", "expected value", "invalid escape", "invalid number", "number out of range"
CONTROL, KEY = "control character (\\u0000-\\u001F) found while parsing a string", "key must be a string"
SURROGATE, HALF = "lone leading surrogate in hex escape", "unexpected end of hex escape"
COMMA, TRAILING, DEEP = "trailing comma", "trailing characters", "recursion limit exceeded"

_BLANK, _PLAIN = re.compile(rb"[ \t\n\r]*"), re.compile(rb'[^"\\\x00-\x1f]*')
_DIGITS, _HEX = re.compile(rb"[0-9]*"), re.compile(rb"[0-9a-fA-F]{4}")
#: Most strings and numbers: without escapes, and whole numbers far below a double's end.
_PLAIN_STRING, _PLAIN_NUMBER = re.compile(rb'"[^"\\\x00-\x1f]*"'), re.compile(rb"-?(?:0|[1-9][0-9]{0,299})(?![0-9.eE])")
_WORDS = {b"t": b"true", b"f": b"false", b"n": b"null"}


class Fault(Exception):
    """The byte ``at`` cannot stand where it does; the length of the text where it ends too soon."""

    def __init__(self, at: int, reason: str):
        self.at, self.reason = at, reason


def _string_end(raw: bytes, at: int) -> int:
    """The place behind the string that opens at ``at``."""
    if plain := _PLAIN_STRING.match(raw, at):
        return plain.end()
    i, n = at + 1, len(raw)

    def code(i: int) -> int:
        """The number of the four hex digits at ``i``."""
        if i + 4 > n:
            raise Fault(n, EOF_STRING)
        if not _HEX.match(raw, i):
            raise Fault(i + 3, ESCAPE)
        return int(raw[i : i + 4], 16)

    while True:
        i = _PLAIN.match(raw, i).end()
        if i == n:
            raise Fault(n, EOF_STRING)
        if raw[i] == 0x22:
            return i + 1
        if raw[i] != 0x5C:
            raise Fault(i, CONTROL)
        if i + 1 == n:
            raise Fault(n, EOF_STRING)
        if raw[i + 1] not in b'"\\/bfnrtu':
            raise Fault(i + 1, ESCAPE)
        if raw[i + 1] != 0x75:
            i += 2
            continue
        first, i = code(i + 2), i + 6
        if 0xDC00 <= first <= 0xDFFF:
            raise Fault(i - 1, SURROGATE)
        if 0xD800 <= first <= 0xDBFF:
            for want in b"\\u":
                if i == n:
                    raise Fault(n, EOF_STRING)
                if raw[i] != want:
                    raise Fault(i, HALF)
                i += 1
            second, i = code(i), i + 4
            if not 0xDC00 <= second <= 0xDFFF:
                raise Fault(i - 1, SURROGATE)


def _number_end(raw: bytes, at: int) -> int:
    if plain := _PLAIN_NUMBER.match(raw, at):
        return plain.end()
    n, i = len(raw), at + (raw[at] == 0x2D)

    def digits(i: int, at_end: str) -> int:
        end = _DIGITS.match(raw, i).end()
        if end == i:
            raise Fault(min(i, n), at_end if i == n else NUMBER)
        return end

    end = digits(i, NUMBER)
    if raw[i] == 0x30 and end > i + 1:
        raise Fault(i + 1, NUMBER)
    i = end
    if raw[i : i + 1] == b".":
        i = digits(i + 1, EOF_VALUE)
    if raw[i : i + 1] in (b"e", b"E"):
        i = digits(i + 1 + (raw[i + 1 : i + 2] in (b"+", b"-")), EOF_VALUE)
    if float(raw[at:i]) in (float("inf"), float("-inf")):
        raise Fault(i - 1, RANGE)
    return i


def scan_bytes(raw: bytes) -> bytes:
    """The same value with the last of equal keys alone and no blanks between its parts, or ``Fault``."""
    n, i = len(raw), 0
    # an open list is its items; an open object is (values by decoded key, the key that waits for its value)
    stack: list = []
    blank = lambda i: i if i < n and raw[i] > 0x20 else _BLANK.match(raw, i).end()

    def key_at(i: int) -> int:
        """Reads the key at ``i`` and its colon; the place behind them."""
        if raw[i] != 0x22:
            raise Fault(i, KEY)
        end = _string_end(raw, i)
        stack[-1][1] = raw[i:end]
        i = blank(end)
        if i == n:
            raise Fault(n, EOF_OBJECT)
        if raw[i] != 0x3A:
            raise Fault(i, COLON)
        return i + 1

    while True:
        i = blank(i)
        if i == n:
            raise Fault(n, EOF_VALUE)
        c = raw[i : i + 1]
        if c in b"[{":
            if len(stack) >= MOST_NESTED:
                raise Fault(i, DEEP)
            is_list = c == b"["
            stack.append([] if is_list else [{}, None])
            i = blank(i + 1)
            if i == n:
                raise Fault(n, EOF_LIST if is_list else EOF_OBJECT)
            if raw[i] != (0x5D if is_list else 0x7D):
                if not is_list:
                    i = key_at(i)
                continue
            stack.pop()
            i, value = i + 1, b"[]" if is_list else b"{}"
        else:
            if c == b'"':
                end = _string_end(raw, i)
            elif c in b"-0123456789":
                end = _number_end(raw, i)
            elif c in _WORDS:
                word = _WORDS[c]
                for k, letter in enumerate(word):
                    if i + k == n:
                        raise Fault(n, EOF_VALUE)
                    if raw[i + k] != letter:
                        raise Fault(i + k, IDENT)
                end = i + len(word)
            else:
                raise Fault(i, VALUE)
            i, value = end, raw[i:end]
        # the value is whole: it goes to what holds it, which may be whole by that, too
        while stack:
            top = stack[-1]
            is_list = not top or not isinstance(top[0], dict)
            if is_list:
                top.append(value)
            else:
                key = top[1]
                top[0][json.loads(key) if b"\\" in key else key[1:-1].decode()] = key + b":" + value
            i = blank(i)
            if i == n:
                raise Fault(n, EOF_LIST if is_list else EOF_OBJECT)
            if raw[i] == 0x2C:
                i = blank(i + 1)
                if i == n:
                    raise Fault(n, EOF_VALUE)
                if raw[i] == (0x5D if is_list else 0x7D):
                    raise Fault(i, COMMA)
                if not is_list:
                    i = key_at(i)
                break
            if raw[i] != (0x5D if is_list else 0x7D):
                raise Fault(i, LIST_COMMA if is_list else OBJECT_COMMA)
            stack.pop()
            i, value = i + 1, b"[" + b",".join(top) + b"]" if is_list else b"{" + b",".join(top[0].values()) + b"}"
        else:
            i = blank(i)
            if i < n:
                raise Fault(i, TRAILING)
            return value


def scan(text: str) -> dict:
    """``text`` as ``scan_bytes`` gives it, or line, column (in bytes, both from 1) and reason of the fault."""
    raw = text.encode(errors="replace")
    try:
        return {"text": scan_bytes(raw).decode(), "line": None, "column": None, "reason": None}
    except Fault as fault:
        end = min(fault.at + 1, len(raw))
        begin = raw.rfind(b"\n", 0, end) + 1
        return {"text": None, "line": raw.count(b"\n", 0, begin) + 1, "column": end - begin, "reason": fault.reason}


SCANNED = T.StructType([T.StructField("text", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("reason", T.StringType())])
_FIELDS = {"text": pa.string(), "line": pa.int32(), "column": pa.int32(), "reason": pa.string()}


def struct_array(rows: list[dict | None], fields: dict[str, pa.DataType]) -> pa.Array:
    """One struct of ``fields`` for each of ``rows``; what a row lacks is null."""
    return pa.array([r or {} for r in rows], pa.struct(fields.items()))


@F.arrow_udf(SCANNED)
def scanned(texts: pa.Array) -> pa.Array:
    return struct_array([None if x is None else scan(x) for x in texts.to_pylist()], _FIELDS)


def is_lenient(text: Column) -> Column:
    """Whether Spark's parser may take what is no JSON: deep nesting, numbers out of range, halves of surrogate pairs."""
    openers = F.length(text) - F.length(F.translate(text, "[{", ""))
    bare = F.regexp_replace(F.regexp_replace(text, r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), r"[^\[\]{}]+", "")
    # each step closes the innermost level; what is left after the last one was deeper
    left = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_NESTED)), bare, lambda brackets, _: F.regexp_replace(brackets, r"\[\]|\{\}", ""))
    deep = F.when(openers > MOST_NESTED, left != "").otherwise(F.lit(False))
    return text.rlike(r"(?i)\\ud[89a-f]") | text.rlike(r"[0-9.]{308}|[eE]\+?0*[1-9][0-9]{2}") | deep


def doubtful(text: Column, value: Column) -> Column:
    """Whether only the scan can tell what ``text`` is; ``value`` is what ``strict_json`` makes of it."""
    return value.isNull() | is_lenient(text)


def exact_json(text: Column | str) -> Column:
    """Struct (value VARIANT, error struct(line, column, reason)) of a text; both null for a null text."""
    c = as_column(text)
    # Spark evaluates what a UDF reads apart from what reads the UDF's result: the test for doubts stands in the first alone
    tried = let(c, lambda t: F.struct(t.alias("raw"), strict_json(t).alias("value")))
    found = scanned(let(tried, lambda x: F.when(doubtful(x["raw"], x["value"]), x["raw"])))

    def settled(x: Column) -> Column:
        seen = x["scanned"]
        value = F.when(seen["text"].isNotNull(), F.try_parse_json(seen["text"])).when(seen["reason"].isNull(), known_json(x["raw"]))
        error = F.when(seen["reason"].isNotNull(), F.struct(seen["line"].alias("line"), seen["column"].alias("column"), seen["reason"].alias("reason")))
        return F.struct(value.alias("value"), error.alias("error"))

    return let(F.struct(c.alias("raw"), found.alias("scanned")), settled)


def fault_text(error: Column) -> Column:
    return F.concat(error["reason"], F.lit(" at line "), error["line"].cast("string"), F.lit(" column "), error["column"].cast("string"))
