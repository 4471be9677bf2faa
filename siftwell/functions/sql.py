"""The formats as functions of SQL text, for sessions that have no Python expressions.

``register(spark)`` makes temporary functions in the session:

* ``logfmt_pairs(line)``: table of (pos, key, value), for ``LATERAL``;
* ``logfmt_good(line)``, ``logfmt_list(good)``, ``logfmt_text(value)``: the well-formed start of a line, its tokens, a value without escapes;
* ``logfmt_value(line, key)``: the last value of a key, escapes resolved, null where the line is malformed;
* ``logfmt_columns(line, 'a,b')``: table of one row with a column for each name, whose schema follows from the names;
* ``mime_of_bytes(content)``, ``mime_of_extension(extension)``: names of types;
* ``json_fault(text)``: struct (text, line, column, reason) of the exact JSON scan.

All but the last and ``logfmt_columns`` are SQL functions, which the planner writes into the
query that calls them, so they cost what the expressions cost.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import mime
from .json_scan import scanned
from .logfmt import _GOOD, TOKEN

_ESCAPES = r"map(r'\"', '\"', r'\\', r'\', r'\n', '\n', r'\t', '\t')"


def _mime_of_bytes() -> str:
    """The signatures as one CASE; the families of one signature are told apart inside it."""
    head = f"substring(content, 1, {mime.HEAD_BYTES})"
    brand, text = f"decode(substring({head}, 9, 4), 'ISO-8859-1')", f"decode({head}, 'ISO-8859-1')"
    brands = " ".join(f"WHEN octet_length({head}) >= 12 AND {brand} IN ({', '.join(map(repr, names))}) THEN '{kind}'" for kind, names in mime.BRANDS)
    families = {"IsoMedia": f"CASE {brands} ELSE 'Mp4' END", "Matroska": f"CASE WHEN regexp_extract({text}, r'{mime._DOC_TYPE}', 1) = 'webm' THEN 'WebM' ELSE 'Mkv' END"}
    when = lambda parts: " AND ".join(f"substring({head}, {at + 1}, {len(raw) // 2}) = X'{raw}'" for at, raw in parts)
    return "CASE " + " ".join(f"WHEN {when(parts)} THEN {families.get(kind, repr(kind))}" for kind, parts in mime.SIGNATURES) + " END"


def _mime_of_extension() -> str:
    known = " ".join(f"WHEN '{x}' THEN '{kind}'" for kind, _, _, accepted in mime.TYPES for x in accepted.split())
    return f"CASE translate(extension, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') {known} END"


_GOOD_OF_LINE = f"regexp_extract(line, r'{_GOOD}', 0)"
#: Of each token the key, the quoted and the bare value, as `0`, `1` and `2`.
_LIST = "arrays_zip(" + ", ".join(f"regexp_extract_all({{}}, r'{TOKEN.replace('{', '{{').replace('}', '}}')}', {k})" for k in (1, 2, 3)) + ")"

#: In this order, as later ones call earlier ones; a generator's argument must call none, so it has its expression written out.
FUNCTIONS = {
    "logfmt_good(line STRING) RETURNS STRING": _GOOD_OF_LINE,
    "logfmt_list(good STRING) RETURNS ARRAY<STRUCT<`0`: STRING, `1`: STRING, `2`: STRING>>": _LIST.format(*["good"] * 3),
    "logfmt_text(value STRING) RETURNS STRING": rf"array_join(transform(regexp_extract_all(value, r'(?s)\\.|[^\\]+|\\', 0), p -> coalesce(try_element_at({_ESCAPES}, p), p)), '')",
    "logfmt_pairs(line STRING) RETURNS TABLE (pos INT, key STRING, value STRING)": f"SELECT pos, e.`0`, e.`1` || e.`2` FROM posexplode({_LIST.format(*[_GOOD_OF_LINE] * 3)}) AS x(pos, e)",
    "logfmt_value(line STRING, name STRING) RETURNS STRING": "CASE WHEN logfmt_good(line) = line THEN logfmt_text(try_element_at(transform(filter(logfmt_list(line), e -> e.`0` = name), e -> e.`1` || e.`2`), -1)) END",
    "mime_of_bytes(content BINARY) RETURNS STRING": _mime_of_bytes(),
    "mime_of_extension(extension STRING) RETURNS STRING": _mime_of_extension(),
}

_ESCAPE = re.compile(r"(?s)\\(.)")
_RESOLVED = {'"': '"', "\\": "\\", "n": "\n", "t": "\t"}


class LogfmtColumns:
    """One row for each line: the values of the named keys, all null where the line is malformed."""

    @staticmethod
    def analyze(line: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        if names.value is None:
            raise ValueError("logfmt_columns needs its names as a constant text")
        return AnalyzeResult(T.StructType([T.StructField(n.strip(), T.StringType()) for n in names.value.split(",")]))

    def __init__(self):
        # Python has no possessive groups in all versions; these tokens cannot overlap, so plain ones do
        self.token, self.good = (re.compile(p.replace("*+", "*").replace("++", "+")) for p in (TOKEN, _GOOD))

    def eval(self, line: str | None, names: str):
        wanted = [n.strip() for n in names.split(",")]
        found = self.good.match(line) if line is not None else None
        whole = found is not None and found.end() == len(line)
        last = {m[1]: (m[2] or "") + (m[3] or "") for m in self.token.finditer(line)} if whole else {}
        yield tuple(_ESCAPE.sub(lambda m: _RESOLVED.get(m[1], m[0]), last[n]) if n in last else None for n in wanted)


def register(spark: SparkSession) -> None:
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udf.register("json_fault", scanned)
    spark.udtf.register("logfmt_columns", udtf(LogfmtColumns))
