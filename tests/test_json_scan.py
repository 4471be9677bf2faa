"""The JSON scan against Python's own parser and a character-wise oracle, and against what Spark takes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siftwell.functions import json_scan as js


#: Written as escapes.
E_ACUTE, SMILE = (json.dumps(x) for x in ("é", "😀"))


def over(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[1] for r in rows.select("i", column.alias("r")).orderBy("i").collect()]


def json_texts(n=3000, seed=1):
    """Random JSON texts, about half of them damaged by one edit."""
    rng = random.Random(seed)
    spaces = lambda: rng.choice(["", "", " ", "\n", "\t "])

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind == 0:
            return rng.choice(["true", "false", "null"])
        if kind in (1, 2):
            return rng.choice(["0", "-0", "7", "120", "-3.5", "1e5", "2E-3", "6.02e+23", "0.5", "1e308"])
        if kind in (3, 4):
            return rng.choice(['""', '"a"', '"é☂"', r'"\n\"\\"', E_ACUTE, SMILE, '"[{,:"'])
        parts = [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 5:
            return "[" + spaces() + ("," + spaces()).join(parts) + spaces() + "]"
        return "{" + spaces() + ",".join(f'"{rng.choice("abc")}"{spaces()}:{spaces()}{p}' for p in parts) + spaces() + "}"

    texts = []
    for _ in range(n):
        t = spaces() + value(4) + spaces()
        if rng.random() < 0.5:
            at = rng.randrange(len(t) + 1)
            t = rng.choice([t[:at], t[:at] + t[at + 1 :], t[:at] + rng.choice('{}[],:"\\tnu0-.eE x\n\x01é') + t[at:]])
        texts.append(t)
    return texts


def parse(text):
    """Python's parser, with what it takes beyond JSON refused."""

    def refuse(x):
        raise ValueError(x)

    value = json.loads(text, parse_constant=refuse)
    json.dumps(value, ensure_ascii=False).encode()  # a half of a surrogate pair cannot be written
    return value


def viable(text):
    """Whether something can follow ``text`` that makes it one JSON value: tried by closing all that is open."""
    endings, stack, inside, escaped = ["", "0", '0"'], "", False, False
    for c in text:
        if inside:
            escaped, inside = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c == '"':
            inside = True
        elif c in "[{":
            stack = ("]" if c == "[" else "}") + stack
        elif c in "]}":
            stack = stack[1:]
    middles = ['"', 'n"', '\\"', 'u00e9"', '00e9"', '0e9"', 'e9"', '9"', '\\ude00"', 'ude00"', 'de00"', 'e00"', '00"', '0"', 'd83d\\ude00"', '83d\\ude00"', '3d\\ude00"', 'd\\ude00"'] if inside else ["", "0", '"k":0', ":0", ",0", *[w[k:] for w in ("true", "false", "null") for k in range(1, 5)]]
    endings = [m + t for m in middles for t in ([":0", ""] if inside else [""])]
    for e in endings:
        try:
            parse(text + e + stack)
            return True
        except (ValueError, UnicodeEncodeError):
            pass
    return False


def test_scan_takes_what_the_parser_takes_and_nothing_else():
    taken = 0
    for t in json_texts():
        found = js.scan(t)
        try:
            want = parse(t)
        except (ValueError, UnicodeEncodeError):
            assert found["text"] is None and found["reason"], t
            continue
        taken += 1
        assert found["reason"] is None and parse(found["text"]) == want, t
    assert 1000 < taken < 2600


def test_scan_names_the_first_byte_that_cannot_stand():
    """What stands before the place can go on; with the byte at the place it cannot."""
    checked = 0
    for t in json_texts(2500, 2):
        raw, found = t.encode(), js.scan(t)
        if found["text"] is not None or found["reason"] in (js.RANGE,):
            continue
        lines = raw.split(b"\n")
        end = sum(len(x) + 1 for x in lines[: found["line"] - 1]) + found["column"]
        eof = found["reason"].startswith("EOF") or (found["reason"] == js.NUMBER and t.endswith("-") and end == len(raw))
        assert (end == len(raw)) if eof else True, t
        before = raw[: end if eof else end - 1].decode(errors="ignore")
        if found["reason"] in (js.SURROGATE, js.ESCAPE, js.HALF):
            continue  # told at the end of the four digits
        assert viable(before), (t, found)
        if not eof and raw[:end].decode(errors="ignore") != before:
            assert not viable(raw[:end].decode()), (t, found)
        checked += 1
    assert checked > 500


@pytest.mark.parametrize(
    "text, line, column, reason",
    [
        ("", 1, 0, js.EOF_VALUE), ("[1", 1, 2, js.EOF_LIST), ('{"k"', 1, 4, js.EOF_OBJECT), ('["ab', 1, 4, js.EOF_STRING), ("[\n1,,", 2, 3, js.VALUE), ('{"k" 1}', 1, 6, js.COLON),
        ("[1 2]", 1, 4, js.LIST_COMMA), ('{"k":1]', 1, 7, js.OBJECT_COMMA), ("nil", 1, 2, js.IDENT), (r'["\q"]', 1, 4, js.ESCAPE), ("[01]", 1, 3, js.NUMBER), ("[-1e999]", 1, 7, js.RANGE),
        ('"a\x02"', 1, 3, js.CONTROL), ("{1:2}", 1, 2, js.KEY), (SMILE[:7] + SMILE[1:7] + '"', 1, 13, js.SURROGATE), (r'"\ud800x"', 1, 8, js.HALF), ("[1,]", 1, 4, js.COMMA), ("1 2", 1, 3, js.TRAILING), ("[" * 128, 1, 128, js.DEEP),
    ],
)
def test_every_reason_has_its_place(text, line, column, reason):
    assert js.scan(text) == {"text": None, "line": line, "column": column, "reason": reason}


def test_column_settles_what_spark_cannot(spark):
    deep = lambda n: "[" * n + "]" * n
    wide = "[" + ",".join(["[1,{}]"] * 500) + "]"
    texts = ['{"a":1,"b":{"c":1,"c":[2]},"a":3}', deep(127), deep(128), deep(3000), wide, "1e400", "-1e-400", "1" * 400, SMILE[:7] + '"', SMILE, "", None, '"e999"', "[1}"]
    found = over(spark, texts, F.struct(F.to_json(js.exact_json("x")["value"]).alias("v"), js.exact_json("x")["error"].alias("e")))
    assert json.loads(found[0]["v"]) == {"a": 3, "b": {"c": [2]}}
    assert [r["e"]["reason"] if r["e"] else None for r in found] == [None, None, js.DEEP, js.DEEP, None, js.RANGE, None, js.RANGE, js.HALF, None, js.EOF_VALUE, None, None, js.LIST_COMMA]
    assert [r["v"] is not None for r in found] == [True, True, False, False, True, False, True, False, False, True, False, False, True, False]


def test_column_over_random_texts(spark):
    texts = json_texts(1500, 3)
    found = over(spark, texts, F.struct(F.to_json(js.exact_json("x")["value"]).alias("v"), js.exact_json("x")["error"].alias("e")))
    for t, r in zip(texts, found, strict=True):
        try:
            want = parse(t)
        except (ValueError, UnicodeEncodeError):
            assert r["v"] is None and r["e"]["reason"], t
            continue
        assert r["e"] is None and json.loads(r["v"]) == want, t
