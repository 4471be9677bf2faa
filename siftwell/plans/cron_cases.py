"""Schedules made from the events' numbers, with SQL of what they mean.

Shapes are written once; both engines read the SQL of the schedules, and the
counterparts derive texts and places from the same numbers by their own
functions.
"""

from __future__ import annotations

import re

#: Parts of a schedule, by event.
PARTS = {"m": "(event_id % 60)", "h": "(event_id % 216 // 9)", "d": "(event_id % 31 + 1)", "o": "(event_id % 13 + 1)", "w": "(event_id % 10)", "n": "(event_id % 29 + 2)"}
#: Shapes of schedules and what is said of them, one for each rule of the description; names in braces are parts, or texts made of them.
DESCRIBED = [
    ("* * * * *", "Every minute"),
    ("*/{n} * * * *", "Every {n} minutes"),
    ("0 * * * *", "Every hour"),
    ("{m} {h} * * {w}", "Every {weekday} at {time}"),
    ("0{m} {h} {d} * *", "At {time} on the {ordinal} of every month"),
    ("{m} 0{h} {d} {o} *", "At {time} on {month} {ordinal}"),
    ("{m} {h} * * *", "Every day at {time}"),
    ("{n} {m} {h} * * *", "Every day at {time}"),
    ("{m}-59/{n} {h},00{d} {d} {o} *", "At {m}-59/{n} past {h},{d} on {d} of {o} (*)"),
]


def _shape(shape: str, spark: bool) -> str:
    """SQL of a shape's text; names of days and months are the engine's own."""
    parts = {k: v.replace("//", "div") if spark else v for k, v in PARTS.items()}
    m, h, d = parts["m"], parts["h"], parts["d"]
    made = parts | {
        "time": f"(({h} + 11) % 12 + 1) || ':' || lpad('' || {m}, 2, '0') || CASE WHEN {h} < 12 THEN ' AM' ELSE ' PM' END",
        "ordinal": f"{d} || CASE WHEN {d} BETWEEN 11 AND 13 THEN 'th' WHEN {d} % 10 = 1 THEN 'st' WHEN {d} % 10 = 2 THEN 'nd' WHEN {d} % 10 = 3 THEN 'rd' ELSE 'th' END",
        "weekday": f"CASE WHEN {parts['w']} < 8 THEN dayname(DATE '2023-01-01' + {parts['w']}::INT) ELSE 'unknown' END",
        "month": f"CASE WHEN {parts['o']} < 13 THEN monthname(make_date(2024, {parts['o']}, 1)) ELSE 'unknown' END",
    }
    pieces = re.split(r"\{(\w+)\}", shape)
    return " || ".join(f"({made[x]})" if i % 2 else f"'{x}'" for i, x in enumerate(pieces))


def described_sql(place: int, spark: bool) -> str:
    return f"CASE event_id % {len(DESCRIBED)} " + " ".join(f"WHEN {i} THEN {_shape(x[place], spark)}" for i, x in enumerate(DESCRIBED)) + " END"


#: A schedule goes wrong in its field number ``AT``: what stands before that field and behind it.
AT, X = "(event_id % 5)", "(event_id % 60)"
BEFORE = f"CASE {AT} WHEN 0 THEN '' WHEN 1 THEN '' || {X} || ' ' WHEN 2 THEN {X} || ' */3 ' WHEN 3 THEN '*  ' || {X} || ' 2-9 ' ELSE '4,' || {X} || ' * 1-5/2 * ' END"
BEHIND = f"CASE {AT} WHEN 0 THEN ' * * * *' WHEN 1 THEN ' * * *' WHEN 2 THEN ' * *' WHEN 3 THEN ' *' ELSE '' END"
FIELD = f"CASE {AT} WHEN 0 THEN 'minutes' WHEN 1 THEN 'hours' WHEN 2 THEN 'day-of-month' WHEN 3 THEN 'month' ELSE 'day-of-week' END"
QUOTE, BACK = "chr(39)", "chr(92)"
#: (what the field holds, bytes of it before the fault, expected, what is found, how it is shown between quotes), each SQL; X is a number.
FAULTS = [
    ("'q' || X", "0", "digit", "'q'", "'q'"),
    ("(X + 1) || '-' || X", "0", "ascending range (start <= end)", "'-'", "'-'"),
    ("X || ',' || (X + 9) || '-' || X", "length('' || X) + 1", "ascending range (start <= end)", "'-'", "'-'"),
    ("X || '/00'", "length('' || X) + 1", "non-zero step value", "'0'", "'0'"),
    ("'*/' || (X + 256)", "2", "number 0-255", "NULL", "NULL"),
    ("X || '-' || repeat('9', 5000)", "length('' || X) + 1", "number 0-255", "NULL", "NULL"),
    ("'*,' || X || ',é'", "length('' || X) + 3", "digit", "'é'", "'é'"),
    ("'*,' || chr(769)", "2", "digit", "chr(769)", f"{BACK} || 'u{{301}}'"),
    ("chr(8203) || '9'", "0", "digit", "chr(8203)", f"{BACK} || 'u{{200b}}'"),
    (f"'7-' || {BACK}", "2", "digit", BACK, f"{BACK} || {BACK}"),
    (f"'7/' || {QUOTE}", "2", "digit", QUOTE, f"{BACK} || {QUOTE}"),
    # right in itself, but the control behind it is where the next field should begin; behind the last field nothing is looked at
    ("'1' || chr(7) || '1'", "NULL", None, "NULL", "NULL"),
]


def _case(place: int) -> str:
    of = lambda x: f"'{x}'" if place == 2 and x else (x or "NULL").replace("X", X)
    return f"(CASE event_id % {len(FAULTS)} " + " ".join(f"WHEN {i} THEN {of(x[place])}" for i, x in enumerate(FAULTS)) + " END)"


_NEXT = f"event_id % {len(FAULTS)} = {len(FAULTS) - 1}"
#: (event_id, bad, position, field, expected, found, shown) of every event's schedule.
FAULT_ROWS = f"""(SELECT event_id, NOT ({_NEXT} AND {AT} = 4) AS bad, CASE WHEN {_NEXT} THEN length({BEFORE}) + 1 ELSE length({BEFORE}) + {_case(1)} END AS position,
      CASE WHEN {_NEXT} THEN {FIELD.replace(AT, "(event_id % 5 + 1)")} ELSE {FIELD} END AS field, CASE WHEN {_NEXT} THEN 'digit' ELSE {_case(2)} END AS expected,
      CASE WHEN {_NEXT} THEN chr(7) ELSE {_case(3)} END AS found, {QUOTE} || CASE WHEN {_NEXT} THEN {BACK} || 'u{{7}}' ELSE {_case(4)} END || {QUOTE} AS shown FROM events)"""


def faulty_sql() -> str:
    """The schedules, as Spark reads them: its chr() is of one byte alone."""
    return re.sub(r"chr\((\d+)\)", lambda m: f"decode(unhex('{chr(int(m[1])).encode().hex()}'), 'utf-8')", f"{BEFORE} || {_case(0)} || {BEHIND}")
