"""Cron schedules: fields, English description, next firing time.

A schedule has five fields, or six with seconds first.  Values are 0 to 255
whatever the field, an item is ``*``, ``n``, ``n-m``, each with an optional
``/k``, and what follows the last field is not looked at.  Null gives null; a
malformed schedule gives ``ok = false`` and an error.

Parsing, description and firing times are SQL expressions; the place of an error
is found by an Arrow UDF that gets only rejected schedules.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import WHITE_SPACE, as_column, let, null_of

FIELDS = ["seconds", "minutes", "hours", "dom", "month", "dow"]
#: Names of the fields in error messages, fixed.
FIELD_NAMES = {"seconds": "seconds", "minutes": "minutes", "hours": "hours", "dom": "day-of-month", "month": "month", "dow": "day-of-week"}
_ITEM = r"(?:\*|[0-9]++(?:-[0-9]++|(?!-)))(?:/[0-9]++|(?!/))"
_FIELD = rf"({_ITEM}(?:,{_ITEM})*+(?!,))"
_FIVE, _SIX = ("(?s)^ *+" + " *+".join([_FIELD] * n) for n in (5, 6))
ERROR = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("field", T.StringType()), T.StructField("expected", T.StringType()), T.StructField("found", T.StringType())])
MONTHS = "January February March April May June July August September October November December".split()
WEEKDAYS = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()
SEARCH_DAYS = 4 * 366 + 1
#: Months that the days of a search can lie in.
SEARCH_MONTHS = SEARCH_DAYS // 28


@lru_cache(maxsize=1 << 16)
def first_fault(text: str) -> dict:
    """Where a rejected schedule goes wrong: position (bytes), field, expected, found."""

    def fault(at: int, field: str, expected: str, found: str | None) -> dict:
        return {"position": len(text[:at].encode()), "field": FIELD_NAMES[field], "expected": expected, "found": found}

    count = len([p for p in re.split(f"[{WHITE_SPACE}]+", text) if p])
    if count not in (5, 6):
        return {"position": 0, "field": "minutes", "expected": "5 or 6 whitespace-separated fields", "found": None}
    at = 0

    def number(field: str) -> tuple[int, dict | None]:
        nonlocal at
        digits = re.compile("[0-9]*").match(text, at).group()
        if not digits:
            return 0, fault(at, field, "digit", text[at : at + 1] or None)
        kept = digits.lstrip("0")
        if len(kept) > 3 or int(kept or 0) > 255:
            return 0, fault(at, field, "number 0-255", None)
        at += len(digits)
        return int(kept or 0), None

    for field in FIELDS[6 - count :]:
        at += len(re.compile(" *").match(text, at).group())
        more = True
        while more:
            begin, low = at, None
            if text[at : at + 1] == "*":
                at += 1
            else:
                low, bad = number(field)
                if bad:
                    return bad
                if text[at : at + 1] == "-":
                    at += 1
                    high, bad = number(field)
                    if bad:
                        return bad
                    if low > high:
                        return fault(begin, field, "ascending range (start <= end)", "-")
            if text[at : at + 1] == "/":
                at += 1
                begin = at
                step, bad = number(field)
                if bad:
                    return bad
                if step == 0:
                    return fault(begin, field, "non-zero step value", "0")
            more = text[at : at + 1] == ","
            at += more
    raise ValueError(f"no fault in {text!r}")


@F.pandas_udf(ERROR)
def _locate(rejected: pd.Series) -> pd.DataFrame:
    none = dict.fromkeys(("position", "field", "expected", "found"))
    return pd.DataFrame([none if x is None else first_fault(x) for x in rejected], columns=list(none)).astype({"position": "Int32"})


def cron_fields(schedule: Column | str) -> Column:
    """Struct of the six canonical fields (no leading zeros; seconds null with five fields), or null where the schedule is rejected."""
    mark = "\x01"

    def pick(text: Column, pattern: str, first: int) -> Column:
        """The fields in one pass: a text that fits is rewritten behind a mark, another stays as it is."""

        def cut(fields: Column) -> Column:
            whole = F.split(F.substring(fields, 2, 1 << 30), " ")
            return F.when(fields.startswith(mark), F.concat(F.array(null_of("string")), whole) if first else whole)

        return let(F.regexp_replace(text, pattern + ".*$", mark + " ".join(f"${i}" for i in range(1, 7 - first))), cut)

    def fields_of(x: Column) -> Column:
        return F.when((x["count"] == 5) & ~x["text"].startswith(mark), pick(x["text"], _FIVE, 1)).when((x["count"] == 6) & ~x["text"].startswith(mark), pick(x["text"], _SIX, 0))

    def counted(text: Column) -> Column:
        count = F.size(F.filter(F.split(text, f"[{WHITE_SPACE}]+"), lambda p: p != ""))
        return F.struct(text.alias("text"), count.alias("count"))

    raw = let(let(as_column(schedule), counted), fields_of)

    def checked(fields: Column) -> Column:
        joined = F.array_join(fields, " ")
        numbers = F.regexp_extract_all(joined, F.lit("[0-9]+"), F.lit(0))
        small = F.forall(numbers, lambda n: F.coalesce(F.try_to_number(F.substring(F.regexp_replace(n, "^0+(?=[0-9])", ""), 1, 4), F.lit("9999")) <= 255, F.lit(False)))
        ranges = F.regexp_extract_all(joined, F.lit("[0-9]+-[0-9]+"), F.lit(0))
        rising = F.forall(ranges, lambda r: F.split_part(r, F.lit("-"), F.lit(1)).try_cast("bigint") <= F.split_part(r, F.lit("-"), F.lit(2)).try_cast("bigint"))
        steps = ~joined.rlike("/0+(?![0-9])")
        plain = F.transform(fields, lambda f: F.regexp_replace(f, "(?<![0-9])0+(?=[0-9])", ""))
        return F.when(small & steps & rising, let(plain, lambda p: F.struct(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(FIELDS)])))

    return let(raw, lambda r: F.when(r.isNotNull(), checked(r)))


def cron_parse(schedule: Column | str) -> Column:
    """Struct (ok, seconds, minutes, hours, dom, month, dow, error)."""
    text = as_column(schedule)
    fields = cron_fields(text)
    located = _locate(F.when(fields.isNull(), text))

    def parsed(x: Column) -> Column:
        fields = x["fields"]
        return F.struct(fields.isNotNull().alias("ok"), *[fields[n].alias(n) for n in FIELDS], F.when(fields.isNull(), x["located"]).alias("error"))

    return F.when(text.isNotNull(), let(F.struct(fields.alias("fields"), located.alias("located")), parsed))


def quoted_char(c: Column) -> Column:
    """A character in single quotes: some by letter escapes, those that cannot be seen (controls, separators, marks) by their number."""
    named = {"\t": r"\t", "\n": r"\n", "\r": r"\r", "\0": r"\0", "'": r"\'", "\\": r"\\"}
    shown = F.when(c.rlike(r"^[\p{C}\p{Z}\p{Mn}\p{Me}\u200C&&[^ ]]$"), F.concat(F.lit(r"\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))).otherwise(c)
    for plain, escape in named.items():
        shown = F.when(c == plain, escape).otherwise(shown)
    return F.concat(F.lit("'"), shown, F.lit("'"))


def cron_error_text(error: Column) -> Column:
    def said(e: Column) -> Column:
        found = F.coalesce(F.concat(F.lit("found "), quoted_char(e["found"])), F.lit("found end of input"))
        return F.concat(F.lit("cron parse error in "), e["field"], F.lit(" field at position "), e["position"].cast("string"), F.lit(": expected "), e["expected"], F.lit(", "), found)

    return let(error, said)


def is_six_field(fields: Column) -> Column:
    return fields["seconds"].isNotNull()


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    ending = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def cron_describe(schedule: Column | str) -> Column:
    """English text of a schedule; seconds are not mentioned; null where it is rejected."""

    def text(f: Column) -> Column:
        minute, hour, dom, month, dow = (f[n] for n in FIELDS[1:])
        value = lambda c: c.rlike("^[0-9]+$")
        number = lambda c: c.try_cast("int")
        every = lambda *cs: F.forall(F.array(*cs), lambda c: c == "*")
        h, m = number(hour), number(minute)
        h12 = F.when(h == 0, 12).when(h <= 12, h).otherwise(h - 12)
        clock = F.concat(h12.cast("string"), F.lit(":"), F.when(m < 10, F.lpad(m.cast("string"), 2, "0")).otherwise(m.cast("string")), F.when(h < 12, " AM").otherwise(" PM"))
        timed = value(hour) & value(minute)
        name = lambda names, i: F.coalesce(F.get(F.array(*map(F.lit, names)), i), F.lit("unknown"))
        weekday = F.when(number(dow) == 7, "Sunday").otherwise(name(WEEKDAYS, number(dow)))
        say = lambda *cs: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in cs])
        return (
            F.when(every(minute, hour, dom, month, dow), "Every minute")
            .when(minute.rlike(r"^\*/[0-9]+$") & every(hour, dom, month, dow), say("Every ", F.substring_index(minute, "/", -1), " minutes"))
            .when((minute == "0") & every(hour, dom, month, dow), "Every hour")
            .when(timed & every(dom, month) & value(dow), say("Every ", weekday, " at ", clock))
            .when(timed & every(dow, month) & value(dom), say("At ", clock, " on the ", ordinal(number(dom)), " of every month"))
            .when(timed & every(dow) & value(dom) & value(month), say("At ", clock, " on ", name(MONTHS, number(month) - 1), " ", ordinal(number(dom))))
            .when(timed & every(dom, month, dow), say("Every day at ", clock))
            .otherwise(say("At ", minute, " past ", hour, " on ", dom, " of ", month, " (", dow, ")"))
        )

    return let(cron_fields(schedule), lambda f: F.when(f.isNotNull(), text(f)))


def cron_expand(field: Column, low: int, high: int) -> Column:
    """Sorted distinct values of a canonical field.  A step counts from the item's first value to ``high``; the end of a stepped range is not used."""

    def values(item: Column) -> Column:
        base, step = F.substring_index(item, "/", 1), F.when(item.contains("/"), F.substring_index(item, "/", -1).try_cast("int"))
        first = F.when(base == "*", low).otherwise(F.substring_index(base, "-", 1).try_cast("int"))
        last = F.when(step.isNotNull() | (base == "*"), high).otherwise(F.substring_index(base, "-", -1).try_cast("int"))
        return F.when(first <= last, F.sequence(first, last, F.coalesce(step, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(field, ","), values))))


# ---- sets of values as bits of a 64-bit number


def _bit(i: Column | int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(i) if isinstance(i, int) else i)


def _up(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def _down(x: Column, n: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, n)


def lowest(mask: Column) -> Column:
    """Number of the lowest bit of a mask that is not 0."""
    return F.bit_count(mask.bitwiseAND(-mask) - 1)


def every(step: int) -> int:
    """Bits 0, step, 2 * step, ... below 63."""
    return sum(1 << i for i in range(0, 63, step))


def cron_mask(field: Column, low: int, high: int, week: bool = False) -> Column:
    """The values of a canonical field up to ``high`` (under 63) as bits; for days of the ``week``, those of all values, modulo 7."""
    strides = F.lit([every(k) for k in range(1, 64)])
    full = (2 << high) - (1 << low)

    def of_item(x: Column) -> Column:
        # from ``first`` on by steps, or from ``first`` to ``last``
        stepped = F.when(x["first"] > high, F.lit(0).cast("long")).otherwise(_up(F.get(strides, F.least(x["step"], F.lit(63)) - 1), x["first"]).bitwiseAND(F.lit(full)))
        last = F.least(x["last"], F.lit(high))
        run = F.when(x["first"] > last, F.lit(0).cast("long")).otherwise(_bit(last + 1) - _bit(x["first"]))
        if week:
            whole = _up(_bit(F.least(x["last"] - x["first"], F.lit(6)) + 1) - 1, x["first"] % 7)
            run = F.when(x["first"] <= x["last"], whole).otherwise(F.lit(0).cast("long"))
        return F.when(x["step"].isNotNull(), stepped).otherwise(run)

    def add(mask: Column, item: Column) -> Column:
        base, slash = F.substring_index(item, "/", 1), item.contains("/")
        first = F.when(base == "*", low).otherwise(F.substring_index(base, "-", 1).try_cast("int"))
        last = F.when(base == "*", high).otherwise(F.substring_index(base, "-", -1).try_cast("int"))
        step = F.when(slash, F.substring_index(item, "/", -1).try_cast("int"))
        return mask.bitwiseOR(let(F.struct(first.alias("first"), last.alias("last"), step.alias("step")), of_item))

    plain = F.when(field == "*", F.lit(full)).otherwise(F.aggregate(F.split(field, ","), F.lit(0).cast("long"), add))
    return let(plain, lambda m: m.bitwiseOR(_down(m, F.lit(7))).bitwiseAND(F.lit(127))) if week else plain


def cron_next_after(schedule: Column | str, after: Column | str) -> Column:
    """The first firing time in a minute after that of ``after`` (TIMESTAMP_NTZ, read as UTC), or null.

    At most 1465 days ahead.  With seconds, the smallest one of the schedule is
    taken; one over 59 has no such time, so the result is null.

    Minutes, hours, days, months and weekdays are bit masks.  A month's firing days are one mask: the days of the month, and the
    weekdays' bits repeated and shifted to the weekday of its first, cut to its length.  The next value is the lowest
    bit left when those before are shifted out, so no list of times or days is made.
    """
    time = as_column(after)

    def of_fields(f: Column) -> Column:
        sets = F.struct(
            cron_mask(f["minutes"], 0, 59).alias("minutes"),
            cron_mask(f["hours"], 0, 23).alias("hours"),
            # bit 0 is the first day, and the first month
            _down(cron_mask(f["dom"], 1, 31), F.lit(1)).alias("dom"),
            _down(cron_mask(f["month"], 1, 12), F.lit(1)).alias("months"),
            # six weeks of weekdays, so that any first weekday can be shifted to
            (cron_mask(f["dow"], 0, 7, week=True) * F.lit(sum(1 << 7 * k for k in range(6)))).alias("weeks"),
            (f["dom"] == "*").alias("any_dom"),
            (f["dow"] == "*").alias("any_dow"),
            F.when(f["seconds"].isNull(), F.lit(0)).otherwise(F.array_min(cron_expand(f["seconds"], 0, 59))).alias("second"),
            (F.date_trunc("minute", time) + F.expr("interval 1 minute")).alias("start"),
        )

        def search(s: Column) -> Column:
            start = s["start"]
            month0 = F.year(start) * 12 + F.month(start) - 1

            def days_of(month: Column) -> Column:
                """Firing days of a month, which is counted from year 0."""
                first = F.make_date(F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1))

                def mask(d: Column) -> Column:
                    by_dow = _down(s["weeks"], F.dayofweek(d) - 1)
                    rule = F.when(s["any_dom"] & s["any_dow"], F.lit(-1).cast("long")).when(s["any_dow"], s["dom"]).when(s["any_dom"], by_dow).otherwise(s["dom"].bitwiseOR(by_dow))
                    return rule.bitwiseAND(_bit(F.dayofmonth(F.last_day(d))) - 1)

                fires = _down(s["months"], (month % 12).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
                return F.when(fires, let(first, mask)).otherwise(F.lit(0).cast("long"))

            at = lambda month, day, hour, minute: F.make_timestamp_ntz(F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), day, hour, minute, F.lit(0).cast("decimal(16,6)"))
            hour0, minute0, today = F.hour(start), F.minute(start), F.dayofmonth(start) - 1

            def this_month(days: Column) -> Column:
                minutes_left = F.when(_down(s["hours"], hour0).bitwiseAND(F.lit(1).cast("long")) == 1, _down(s["minutes"], minute0)).otherwise(F.lit(0).cast("long"))
                hours_left = _down(s["hours"], hour0 + 1)
                now = _down(days, today).bitwiseAND(F.lit(1).cast("long")) == 1
                later_days = _down(days, today + 1)
                return (
                    F.when(now & (minutes_left != 0), at(month0, today + 1, hour0, minute0 + lowest(minutes_left)))
                    .when(now & (hours_left != 0), at(month0, today + 1, hour0 + 1 + lowest(hours_left), lowest(s["minutes"])))
                    .when(later_days != 0, at(month0, today + 2 + lowest(later_days), lowest(s["hours"]), lowest(s["minutes"])))
                )

            def in_month(i: Column) -> Column:
                return let(F.struct((month0 + i).alias("month"), days_of(month0 + i).alias("days")), lambda m: at(m["month"], lowest(m["days"]) + 1, lowest(s["hours"]), lowest(s["minutes"])))

            # the next month is tried first, for most schedules fire in it; those after it only where it does not
            next_month = F.when(days_of(month0 + 1) != 0, in_month(F.lit(1)))
            further = F.array_min(F.filter(F.sequence(F.lit(2), F.lit(SEARCH_MONTHS)), lambda i: days_of(month0 + i) != 0))
            found = F.coalesce(let(days_of(month0), this_month), next_month, let(further, lambda i: F.when(i.isNotNull(), in_month(i))))
            limit = F.timestamp_add("DAY", F.lit(SEARCH_DAYS), time)
            timed = (s["minutes"] != 0) & (s["hours"] != 0) & (s["second"] < 60)
            return F.when(timed, let(found, lambda t: F.when(t <= limit, F.timestamp_add("SECOND", s["second"], t))))

        return let(sets, search)

    return let(cron_fields(schedule), lambda f: F.when(f.isNotNull() & time.isNotNull(), of_fields(f)))
