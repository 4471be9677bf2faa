"""Random lines and schedules, judged by small parsers that are written for these tests alone."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from siftwell.functions import cron, logfmt

SPACES = "\t\n\x0b\x0c\r \x85\xa0   　"


def over(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[1] for r in rows.select("i", column.alias("r")).orderBy("i").collect()]


# ---- logfmt


def logfmt_lines(n, seed):
    rng, lines = random.Random(seed), []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            word = "".join(rng.choices("kv9.é☂\t", k=rng.randrange(4)))
            quoted = '"' + "".join(rng.choice(["a", " ", "=", "ß", "\n", r"\"", r"\\", r"\n", r"\t", r"\q"]) for _ in range(rng.randrange(5))) + '"'
            parts.append(rng.choice([word, word + "=", f"{word}={word}", f"{word}={quoted}", quoted, f"k={quoted}", "k=1"]))
        line = rng.choice([" ", "  ", ""]).join(parts)
        if rng.random() < 0.3 and line:
            at = rng.randrange(len(line))
            line = line[:at] + rng.choice(['"', "=", "\\", " ", ""]) + line[at + rng.randrange(2) :]
        lines.append(line)
    return lines


def read_logfmt(line):
    """(pairs, (byte, message) or None), one character after another."""
    pairs, key, state, value, i = [], "", "gap", "", 0
    at = lambda k: len(line[:k].encode())
    while i <= len(line):
        c = line[i] if i < len(line) else None
        if state == "gap":
            if c is None:
                return pairs, None
            if c in '="':
                return pairs, (at(i), "expected key")
            state, key = ("gap", "") if c == " " else ("key", c)
        elif state == "key":
            if c == "=":
                state, value = "start", ""
            elif c is None or c in ' "':
                pairs.append((key, ""))
                state = "gap"
                continue
            else:
                key += c
        elif state in ("start", "bare"):
            if c == '"' and state == "start":
                state = "quoted"
            elif c is None or c in ' "=':
                pairs.append((key, value))
                state = "gap"
                continue
            else:
                state, value = "bare", value + c
        elif c is None:
            return pairs, (at(i), "unterminated quoted string")
        elif c == '"':
            pairs.append((key, value))
            state = "gap"
        elif c == "\\":
            if i + 1 == len(line):
                return pairs, (at(i + 1), "unterminated escape sequence")
            value += line[i : i + 2]
            i += 1
        else:
            value += c
        i += 1
    return pairs, None


def plain(value):
    return re.sub(r"(?s)\\(.)", lambda m: {'"': '"', "\\": "\\", "n": "\n", "t": "\t"}.get(m[1], m[0]), value)


def test_logfmt_over_random_lines(spark):
    lines = [*logfmt_lines(4000, 1), "", None]
    parsed, maps = over(spark, lines, logfmt.logfmt_parse("x")), over(spark, lines, logfmt.logfmt_map("x"))
    said = over(spark, lines, logfmt.logfmt_error_text(logfmt.logfmt_parse("x")["error"]))
    assert parsed[-1] is None and said[-1] is None
    faults = set()
    for line, p, m, text in zip(lines[:-1], parsed, maps, said, strict=False):
        pairs, fault = read_logfmt(line)
        assert ([tuple(x) for x in p["pairs"]], p["error"] and tuple(p["error"]), p["ok"]) == (pairs, fault, fault is None), line
        assert m["fields"] == (None if fault else {k: plain(v) for k, v in pairs}), line
        assert text == (fault and f"logfmt parse error at position {fault[0]}: {fault[1]}")
        faults.add(fault and fault[1])
    assert len(faults) == 4


# ---- cron

NAMES = ["seconds", "minutes", "hours", "day-of-month", "month", "day-of-week"]


def schedules(n, seed, valid=False):
    rng, found = random.Random(seed), []
    top = (59, 59, 23, 31, 12, 7)
    for _ in range(n):
        six, fields = rng.random() < 0.3, []
        for k in range(0 if six else 1, 6):
            items = []
            for _ in range(rng.choice([1, 1, 1, 2])):
                a, b = sorted((rng.randrange(top[k] + 2), rng.randrange(top[k] + 2)))
                base = rng.choice(["*", "*", str(a), f"0{a}", f"{a}-{b}"] + ([] if valid else [f"{b}-{a}", "256", "", "x", "0" * 30 + "7", "9" * 30]))
                items.append(base + rng.choice(["", "", "", f"/{rng.randrange(1, 20)}"] + ([] if valid else ["/0", "/", "/x"])))
            fields.append(",".join(items))
        text = " ".join(fields) if valid or rng.random() < 0.6 else "".join(f + rng.choice(SPACES if rng.random() < 0.2 else [" ", "  "]) for f in fields)
        if not valid and rng.random() < 0.2:
            text = rng.choice([text + " 1", text + "junk", text[:-2], text.replace(",", "", 1), " " + text, "é" + text])
        found.append(text)
    return found


def read_cron(text):
    """The fields as lists of (low, high, step), or (byte, field, expected, found): tokens of a regular expression, consumed by a pattern of kinds."""
    count = len(re.findall(f"[^{SPACES} -    ]+", text))
    if count not in (5, 6):
        return 0, "minutes", "5 or 6 whitespace-separated fields", None
    spans = [(m.start(), m[0]) for m in re.finditer(r"(?s)[0-9]+|.", text)] + [(len(text), "")]
    place, fields = 0, []
    fault = lambda k, field, expected, found: (len(text[: spans[k][0]].encode()), field, expected, found)
    for field in NAMES[6 - count :]:
        while spans[place][1] == " ":
            place += 1
        items = []
        while True:
            low = high = step = None
            begin = place
            if spans[place][1] == "*":
                place += 1
            else:
                for turn in (0, 1):
                    number = spans[place][1]
                    if not re.fullmatch("[0-9]+", number):
                        return fault(place, field, "digit", number[:1] or None)
                    if len(number.lstrip("0")) > 3 or int(number) > 255:
                        return fault(place, field, "number 0-255", None)
                    low, high, place = (int(number), None, place + 1) if turn == 0 else (low, int(number), place + 1)
                    if turn == 0 and spans[place][1] != "-":
                        break
                    place += turn == 0
                if high is not None and low > high:
                    return fault(begin, field, "ascending range (start <= end)", "-")
            if spans[place][1] == "/":
                number = spans[place + 1][1]
                if not re.fullmatch("[0-9]+", number):
                    return fault(place + 1, field, "digit", number[:1] or None)
                if len(number.lstrip("0")) > 3 or int(number) > 255:
                    return fault(place + 1, field, "number 0-255", None)
                if int(number) == 0:
                    return fault(place + 1, field, "non-zero step value", "0")
                step, place = int(number), place + 2
            items.append((low, high, step))
            if spans[place][1] != ",":
                break
            place += 1
        fields.append(items)
    return fields


def shown(items):
    return ",".join(("*" if a is None else str(a) if b is None else f"{a}-{b}") + ("" if k is None else f"/{k}") for a, b, k in items)


def test_cron_over_random_schedules(spark):
    texts = schedules(4000, 2)
    kinds = set()
    for text, row in zip(texts, over(spark, texts, cron.cron_parse("x")), strict=True):
        want = read_cron(text)
        if isinstance(want, tuple):
            assert not row["ok"] and tuple(row["error"]) == want, text
            kinds.add(want[2])
        else:
            assert row["ok"] and [row[n] for n in cron.FIELDS[6 - len(want) :]] == [shown(f) for f in want], text
    assert len(kinds) == 5


def values(items, low, high):
    found = set()
    for a, b, k in items:
        first = low if a is None else a
        found |= set(range(first, high + 1, k)) if k else set(range(first, (high if a is None else a if b is None else b) + 1))
    return found


def brute_next(text, after):
    fields = read_cron(text)
    seconds = min(values(fields[0], 0, 59)) if len(fields) == 6 else 0
    minutes, hours, doms, months, dows = (values(f, *r) for f, r in zip(fields[-5:], ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True))
    any_dom, any_dow = (f == [(None, None, None)] for f in (fields[-3], fields[-1]))
    dows, day, start = {d % 7 for d in dows}, after.date(), after.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    while dt.datetime.combine(day, dt.time()) <= after + dt.timedelta(days=1465):
        by_dom, by_dow = day.day in doms, day.isoweekday() % 7 in dows
        if day.month in months and (by_dom or any_dom) & (by_dow or any_dow) | (not any_dom and not any_dow and (by_dom or by_dow)):
            for h in sorted(hours & set(range(24))):
                for m in sorted(minutes & set(range(60))):
                    t = dt.datetime.combine(day, dt.time(h, m))
                    if t >= start:
                        return t + dt.timedelta(seconds=seconds) if t <= after + dt.timedelta(days=1465) and seconds < 60 else None
        day += dt.timedelta(days=1)
    return None


def test_cron_next_over_random_schedules(spark):
    rng = random.Random(4)
    texts = schedules(600, 3, valid=True) + ["0 0 29 2 *", "59 23 31 12 *", "0 0 31 2 *", "0 0 29 2 1", "*/7 */5 31 */2 6-9", "0 0 * 2 14", "5 4 30 2 *"]
    rows = [(t, dt.datetime(2023, 1, 1) + dt.timedelta(seconds=rng.randrange(5 * 366 * 86400), microseconds=rng.randrange(2) * 5)) for t in texts]
    rows += [("0 0 29 2 *", dt.datetime(2096, 2, 29)), ("0 0 29 2 *", dt.datetime(2096, 2, 28, 23, 58)), ("0 0 1 1 *", dt.datetime(2024, 12, 31, 23, 59)), ("59 23 * * *", dt.datetime(2024, 2, 29, 23, 59, 30))]
    found = spark.createDataFrame(rows, "s string, t timestamp_ntz").select("s", "t", cron.cron_next_after("s", "t").alias("next")).collect()
    for r in found:
        assert r["next"] == brute_next(r["s"], r["t"]), r
    assert 20 < sum(r["next"] is None for r in found) < 400


@pytest.mark.parametrize("c, want", [("a", "'a'"), ("é", "'é'"), ("\t", r"'\t'"), ("'", r"'\''"), ('"', "'\"'"), ("\\", r"'\\'"), ("\0", r"'\0'"), ("\xa0", r"'\u{a0}'"), ("́", r"'\u{301}'"), ("​", r"'\u{200b}'"), ("😀", "'😀'"), ("\U000e0001", r"'\u{e0001}'"), (" ", "' '")])
def test_quoted_characters(spark, c, want):
    assert over(spark, [c], cron.quoted_char(F.col("x"))) == [want]
