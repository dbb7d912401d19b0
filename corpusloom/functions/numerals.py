"""List numerals and markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Col, col

# ── fixed values ────────────────────────────────────────────────────────────
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"),
         (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
# ────────────────────────────────────────────────────────────────────────────


def roman(n: Col) -> Column:
    """Roman numeral by quotient and remainder along the sign table."""
    table = F.array(*[F.struct(F.lit(value).alias("value"), F.lit(sign).alias("sign")) for value, sign in ROMAN])
    start = F.struct(col(n).cast("long").alias("left"), F.lit("").alias("out"))
    return F.aggregate(table, start, lambda acc, t: F.struct(
        (acc["left"] % t["value"]).alias("left"),
        F.concat(acc["out"], F.repeat(t["sign"], F.floor(acc["left"] / t["value"]).cast("int"))).alias("out")), lambda acc: acc["out"])


def letters(n: Col) -> Column:
    """a … z, aa, ab …: the bijective base-26 form of a positive number."""
    start = F.struct(col(n).cast("long").alias("v"), F.lit("").alias("out"))

    def digit(acc: Column, _: Column) -> Column:
        sign = F.char((F.lit(97) + (acc["v"] - 1) % 26).cast("int"))
        return F.when(acc["v"] > 0, F.struct(
            F.call_function("div", acc["v"] - 1, F.lit(26)).alias("v"), F.concat(sign, acc["out"]).alias("out"))).otherwise(acc)

    # fourteen digits cover any 64-bit counter
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, digit, lambda acc: acc["out"])


def counter(n: Col, style: str) -> Column:
    """A counter in one of the styles ``1 a A i I``; letters and numerals start at one."""
    at_least_one = F.greatest(F.lit(1), col(n).cast("long"))
    return {
        "a": letters(at_least_one), "A": F.upper(letters(at_least_one)),
        "i": F.lower(roman(at_least_one)), "I": roman(at_least_one),
    }.get(style, col(n).cast("string"))


def marker_text(template: Col, body: Col) -> Column:
    """Fill the ``%1`` style placeholder of a list template."""
    return F.regexp_replace(col(template), F.lit("%[0-9]"), col(body))


def affixed_marker(prefix: Col, n: Col, style: str, suffix: Col) -> Column:
    return F.concat(col(prefix), counter(n, style), col(suffix))
