"""Strict JSON as VARIANT: one value, nothing after it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column, let


def _signed_zeros(text: Column) -> Column:
    """``-0`` and ``-0.0`` outside of strings with an exponent, by which Spark reads them as doubles; as decimals they lose their sign."""
    pieces = F.regexp_extract_all(text, F.lit(r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[-+.0-9eE]++|[^"0-9eE+.-]++|.'), F.lit(0))
    zero = F.transform(pieces, lambda p: F.when(p.rlike(r"^-0(?:\.0+)?$"), F.lit("-0e0")).otherwise(p))
    return F.when(text.rlike(r"(?:^|[\[,:\s])-0(?:\.0+)?(?:$|[\s,\]}])"), F.array_join(zero, "")).otherwise(text)


def strict_json(text: Column | str) -> Column:
    """The value as VARIANT, or null where ``text`` is not exactly one JSON value.

    Spark's parser stops after the first value, so the text is parsed inside an
    array and inside an object: only one whole value fits both.  A zero keeps its sign.
    """

    # no inner function uses a variable of an outer one, so the expression stays one that can be recognised
    def parsed(c: Column) -> Column:
        boxed, named = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
        return let(F.struct(boxed.alias("boxed"), named.alias("named")), one_value)

    def one_value(x: Column) -> Column:
        one = F.size(F.try_variant_get(x["boxed"], "$", "array<variant>")) == 1
        return F.when(x["named"].isNotNull() & one, F.variant_get(x["named"], "$.v", "variant"))

    return let(as_column(text), lambda t: let(_signed_zeros(t), parsed))


def known_json(text: Column | str) -> Column:
    """The value of a text that is known to be exactly one JSON value for ``strict_json``: it need not be parsed a second time."""
    return let(as_column(text), lambda t: F.try_parse_json(_signed_zeros(t)))


def json_type(value: Column) -> Column:
    """Type of a VARIANT: null (missing), VOID, STRING, BOOLEAN, BIGINT, DOUBLE, DECIMAL(..), ARRAY<..> or OBJECT<..>."""
    return F.schema_of_variant(value)
