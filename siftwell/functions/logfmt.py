"""logfmt lines as ordered pairs or as a map, with byte-accurate errors.

A line is a run of ``key``, ``key=bare`` or ``key="quoted"`` tokens separated by
blanks (U+0020 alone).  The tokens are possessive regular expressions, so a
line is read once from left to right without backtracking.  A null line gives
null; a malformed one gives ``ok = false`` and an error, never an exception.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column, let, null_of

_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
#: One token; groups: key, quoted value, bare value.
TOKEN = rf'(?s)([^= "]++)(?:=(?:{_QUOTED}|(?!")([^= "]*+))|(?!=))'
_PLAIN = r'[^= "]++(?:=(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|(?!")[^= "]*+)|(?!=))'
_GOOD = rf"(?s)^ *+(?:{_PLAIN} *+)*+"
_OPEN_ESCAPE = r'(?s)^[^= "]+="[^"\\]*+(?:\\.[^"\\]*+)*+\\$'

PAIRS = "array<struct<key:string,value:string>>"
ERROR = "struct<position:int,message:string>"


def unescape(value: Column) -> Column:
    r"""Resolve ``\"``, ``\\``, ``\n`` and ``\t``; other escapes stay as they are."""
    pieces = F.regexp_extract_all(value, F.lit(r"(?s)\\.|[^\\]+|\\"), F.lit(0))
    known = F.create_map(*[F.lit(x) for kv in (('\\"', '"'), ("\\\\", "\\"), ("\\n", "\n"), ("\\t", "\t")) for x in kv])
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")


def _parse(line: Column) -> Column:
    def with_prefix(good: Column) -> Column:
        rest = F.substr(line, F.length(good) + 1)
        keys = F.regexp_extract_all(good, F.lit(TOKEN), F.lit(1))
        quoted = F.regexp_extract_all(good, F.lit(TOKEN), F.lit(2))
        bare = F.regexp_extract_all(good, F.lit(TOKEN), F.lit(3))
        pairs = F.transform(F.arrays_zip(keys.alias("k"), quoted.alias("q"), bare.alias("b")), lambda t: F.struct(t["k"].alias("key"), F.concat(t["q"], t["b"]).alias("value")))

        def with_rest(r: Column) -> Column:
            end = F.octet_length(line)
            error = (
                F.when(r == "", null_of(ERROR))
                .when(r.rlike(r'^[="]'), F.struct(F.octet_length(good).alias("position"), F.lit("expected key").alias("message")))
                .when(r.rlike(_OPEN_ESCAPE), F.struct(end.alias("position"), F.lit("unterminated escape sequence").alias("message")))
                .otherwise(F.struct(end.alias("position"), F.lit("unterminated quoted string").alias("message")))
            )
            return F.struct((r == "").alias("ok"), pairs.alias("pairs"), error.alias("error"))

        return let(rest, with_rest)

    return let(F.regexp_extract(line, _GOOD, 0), with_prefix)


def logfmt_parse(line: Column | str) -> Column:
    """Struct (ok, pairs, error): the ordered pairs before the first error, duplicates kept, escapes raw."""
    c = as_column(line)
    return F.when(c.isNotNull(), _parse(c))


def logfmt_map(line: Column | str) -> Column:
    """Struct (ok, fields, error): a map with escapes resolved and the last of equal keys; null fields where the line is malformed."""
    c = as_column(line)

    def to_map(p: Column) -> Column:
        def last_wins(keys: Column) -> Column:
            # walk the pairs from the end: the first one met is the last one written
            back = F.reverse(p["pairs"])
            values = F.transform(keys, lambda k: unescape(F.element_at(F.filter(back, lambda e: e["key"] == k), 1)["value"]))
            return F.map_from_arrays(keys, values)

        fields = let(F.array_distinct(F.transform(p["pairs"], lambda e: e["key"])), last_wins)
        return F.struct(p["ok"].alias("ok"), F.when(p["ok"], fields).alias("fields"), p["error"].alias("error"))

    return F.when(c.isNotNull(), let(_parse(c), to_map))


def logfmt_error_text(error: Column) -> Column:
    return F.concat(F.lit("logfmt parse error at position "), error["position"].cast("string"), F.lit(": "), error["message"])
