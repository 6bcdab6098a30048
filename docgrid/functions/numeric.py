"""Numbers in cells: Chinese numerals, Arabic numbers with units.  Columns in, columns out."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let, let_all
from .vocabulary import CN_DIGITS, CN_UNITS, NO_NUMBER, NUMBER, UNICODE, UNIT

#: White space as Unicode has it, with the four separators of ASCII; the built-in trim strips blanks only.
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NUMERIC = "struct<value: double, unit: string, is_negative: boolean, is_percentage: boolean, confidence: double>"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


@cache
def other_digits() -> tuple[str, str]:
    """The decimal digits of all scripts but ASCII, and what they stand for."""
    chars = [c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) == "Nd"]
    return "".join(chars), "".join(str(unicodedata.decimal(c)) for c in chars)


def ascii_digits(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, *other_digits())).otherwise(text)


def _table(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])


def cn_numeral(text: Column) -> Column:
    """Value of a Chinese numeral; null if there is none, if it has ASCII digits or a point, or is 0.

    Read from the left: a digit waits; a unit below ten thousand adds the waiting digit (or 1) times itself; a
    unit from ten thousand on multiplies what there is - with no digit waiting and a smaller unit before it, that
    unit is added first; all else is skipped.
    """
    digits, units = _table(CN_DIGITS), _table(CN_UNITS)
    zero = F.lit(0.0)
    start = F.struct(zero.alias("total"), zero.alias("waiting"), F.lit(1.0).alias("last"))
    state = lambda total, waiting, last: F.struct(total.alias("total"), waiting.alias("waiting"), last.alias("last"))

    def step(s: Column, ch: Column) -> Column:
        def on(digit: Column, unit: Column) -> Column:
            large = (s["total"] + F.when((s["waiting"] == 0) & (s["last"] < unit), s["last"]).otherwise(s["waiting"])) * unit
            small = s["total"] + F.when(s["waiting"] == 0, F.lit(1.0)).otherwise(s["waiting"]) * unit
            return F.when(digit.isNotNull(), state(s["total"], digit, s["last"])).when(unit.isNotNull(), state(F.when(unit >= 10_000, large).otherwise(small), zero, unit)).otherwise(s)

        return let_all(on, digit=F.try_element_at(digits, ch), unit=F.try_element_at(units, ch))

    known = "[" + "".join([*CN_DIGITS, *CN_UNITS]) + "]"
    # most cells hold no numeral: the fold runs only where one is
    fold = let(F.aggregate(F.split(text, ""), start, step, lambda s: s["total"] + s["waiting"]), lambda v: F.when(v != 0, v))
    return F.when(~text.rlike("[0-9.]") & text.rlike(known), fold)


def extract_numeric(text: Column, mode: str = "as_coded") -> Column:
    """Struct of value, unit, is_negative, is_percentage and confidence of a cell.

    ``as_coded``: a leading minus is read twice, so such values turn positive, and a minus of the
    mathematical kind leaves no value.  ``documented``: both give the negative value.
    """
    inner = lambda t: F.when(t.startswith("("), F.regexp_extract(t, r"^\((.+)\)$", 1)).otherwise("")

    def of_text(t: Column) -> Column:
        return let_all(of_parts, t=t, inner=inner(t), chinese=cn_numeral(t), nothing=(t == "") | t.isin(*NO_NUMBER))

    def of_parts(t: Column, inner: Column, chinese: Column, nothing: Column) -> Column:
        is_cn = ~nothing & chinese.isNotNull()
        working = F.when(inner != "", inner).otherwise(t)
        first = F.translate(F.regexp_extract(working, UNICODE + NUMBER, 0), ", ", "")
        cleaned = F.translate(first, "−-", "") if mode == "documented" else first
        number = F.when(~nothing & ~is_cn, let(cleaned, lambda c: strip(ascii_digits(c)).try_cast("double")))
        negative = (inner != "") | t.startswith("-") | t.startswith("−")
        unit = F.when(nothing, "").otherwise(F.regexp_extract(F.when(is_cn, t).otherwise(working), UNIT, 1))
        return let_all(result, t=t, chinese=chinese, is_cn=is_cn, number=number, negative=negative, nothing=nothing, unit=unit)

    def result(t: Column, chinese: Column, is_cn: Column, number: Column, negative: Column, nothing: Column, unit: Column) -> Column:
        return F.struct(
            F.when(is_cn, chinese).when(negative, -number).otherwise(number).alias("value"),
            unit.alias("unit"),
            (negative & number.isNotNull()).alias("is_negative"),
            (~nothing & ~is_cn & (t.contains("%") | t.contains("％"))).alias("is_percentage"),
            F.when(nothing | is_cn | number.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.2)).alias("confidence"),
        )

    return let(strip(text), of_text)
