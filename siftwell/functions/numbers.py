"""Shortest decimal text of doubles, and JSON texts with all numbers written so.

Digits are the fewest that read back as the same double.  Numbers from 1e-5 up to
below 1e16 are written without an exponent and always with a point; others with
one, as ``1e16`` or ``2.5e-7``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column, let

#: A string, a number with an exponent, or what stands between these.
_PIECE = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9]+(?:\.[0-9]+)?[eE][-+]?[0-9]+|[-+.0-9]|[^"0-9+.-]++'
_SCIENTIFIC = r"^-?[0-9]+(?:\.[0-9]+)?[eE][-+]?[0-9]+$"


def _placed(digits: Column, point: Column) -> Column:
    """``digits`` with the point behind the first ``point`` of them, by exponent where that would need many zeros."""
    n, first, rest = F.length(digits), F.substring(digits, 1, 1), F.substring(digits, F.lit(2), F.lit(20))
    zeros = lambda k: F.repeat(F.lit("0"), k)
    exponent = F.concat(F.lit("e"), (point - 1).cast("string"))
    return (
        F.when((n <= point) & (point <= 16), F.concat(digits, zeros(point - n), F.lit(".0")))
        .when(point.between(1, 16), F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.lit(20))))
        .when(point.between(-4, 0), F.concat(F.lit("0."), zeros(-point), digits))
        .when(n == 1, F.concat(first, exponent))
        .otherwise(F.concat(first, F.lit("."), rest, exponent))
    )


def number_text(number: Column | str) -> Column:
    """Text of a finite double."""

    def fewer(v: Column) -> Column:
        """The fewest digits that read back as the same number.

        Java may give more than are needed.  Lengths are tried from one digit on, and for 16 also the neighbours, as Java's
        own last digit need not be the nearest.
        """
        same = lambda t: F.when(t.cast("double") == v["x"], t)
        formed = lambda n: F.format_string(f"%.{n - 1}e", v["x"])

        def moved(step: int) -> Column:
            digits = F.replace(F.substring_index(formed(16), "e", 1), F.lit("."), F.lit("")).cast("long") + step
            power = F.substring_index(formed(16), "e", -1).cast("int") - 15 + F.length(digits.cast("string")) - 1
            shown = digits.cast("string")
            return F.concat(F.substring(shown, 1, 1), F.lit("."), F.substring(shown, 2, 20), F.lit("e"), power.cast("string"))

        tried = [formed(n) for n in range(1, 17)] + [moved(1), moved(-1), formed(17)]
        return F.coalesce(*[same(x) for x in tried], v["text"])

    def rebuilt(text: Column) -> Column:
        mantissa, power = F.substring_index(text, "e", 1), F.substring_index(text, "e", -1).cast("int")
        return _placed(F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "0+$", ""), power + 1)

    def written(v: Column) -> Column:
        n = F.length(F.regexp_replace(F.substring_index(v["text"], "E", 1), r"^0\.0*|\.", ""))
        sized = F.struct(v["x"].alias("x"), v["text"].alias("text"), n.alias("n"))
        # what is plain already, and cannot be shorter, stays
        return let(sized, lambda s: F.when(~s["text"].contains("E") & (s["n"] < 16), s["text"]).otherwise(let(F.lower(fewer(s)), lambda t: F.when(t.contains("e"), rebuilt(t)).otherwise(t))))

    x = as_column(number).cast("double")
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    return F.concat(sign, let(F.struct(F.abs(x).alias("x"), F.abs(x).cast("string").alias("text")), written))


def plain_numbers(text: Column | str) -> Column:
    """A JSON text with every number that has an exponent written as ``number_text`` does; strings stay."""

    def rewritten(c: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0)), lambda p: F.when(p.rlike(_SCIENTIFIC), number_text(p)).otherwise(p))
        return F.when(c.rlike("[0-9][eE][-+]?[0-9]"), F.array_join(pieces, "")).otherwise(c)

    return let(as_column(text), rewritten)


def number_text_of(x: float) -> str:
    """``number_text`` of a Python number."""
    value = Decimal(repr(float(x)))
    sign, digits, power = value.as_tuple()
    digits = "".join(map(str, digits)).rstrip("0") or "0"
    point = 1 if not value else value.adjusted() + 1
    if len(digits) <= point <= 16:
        text = digits + "0" * (point - len(digits)) + ".0"
    elif 0 < point <= 16:
        text = f"{digits[:point]}.{digits[point:]}"
    elif -5 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        text = digits[:1] + ("." + digits[1:] if digits[1:] else "") + f"e{point - 1}"
    return "-" * sign + text
