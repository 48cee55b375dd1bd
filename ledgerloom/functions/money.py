"""Money in canonical form: a string of two decimals, or null where the reading leaves a doubt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import CURRENCIES, let

#: What may stand before an amount, its number, and letters after it.
_PARTS = r"^([^0-9]*?)([.,]?[0-9][0-9.,]*)([a-z]*)$"


def bare_amount(s: Column) -> Column:
    """Sign and number alone, a bare fraction with a zero before it. Null for rates, and where anything else stands
    beside the number than a currency, signs and parentheses."""
    wide = F.lower(F.translate(F.trim(s), "０１２３４５６７８９．，￡￥＄（）％ ", "0123456789.,£¥$()% "))

    def read(t: Column) -> Column:
        before, number, after = (F.regexp_extract(t, _PARTS, k) for k in (1, 2, 3))
        name, signs = F.regexp_replace(before, "[^a-z]", ""), F.regexp_replace(before, "[a-z]", "")
        fraction = number.rlike("^[.,][0-9]{1,2}$")
        known = name.isin("", *CURRENCIES) & after.isin("", *CURRENCIES) & (F.translate(signs, "$€£¥.:+-", "") == "") & (F.length(F.translate(signs, "$€£¥.:", "")) <= 1)
        plain = F.when(fraction, F.concat(F.lit("0"), number)).when(name != "", F.ltrim(number, F.lit(".,"))).when(number.rlike("^[0-9]"), number)
        return F.when((number != "") & known, F.concat(F.when(signs.contains("-"), "-").otherwise(""), plain))

    return F.when(~wide.contains("%"), let(F.regexp_replace(wide, r"[\s()]", ""), read))


def _plain(t: Column, decimal: str) -> Column:
    """With a known decimal sign: the other sign must part groups of three."""
    other = "," if decimal == "." else "."
    d, o = ("\\" + decimal, "\\" + other)
    grouped = F.regexp_extract(t, rf"^([^{d}]*)", 1).rlike(rf"^[+-]?\d{{1,3}}(?:{o}\d{{3}})+$")
    number = F.replace(F.replace(t, F.lit(other), F.lit("")), F.lit(decimal), F.lit("."))
    return F.when(~t.contains(other) | grouped, number)


def money(s: Column, decimal_separator: str = "auto") -> Column:
    """1,234.56 and 1.234,56 are one amount; 1,234 is none, as either reading may be meant."""
    if decimal_separator not in ("auto", ".", ","):
        raise ValueError("decimal_separator is auto, a point or a comma")

    def number(t: Column) -> Column:
        if decimal_separator != "auto":
            return _plain(t, decimal_separator)
        both = t.contains(",") & t.contains(".")
        last = F.regexp_extract(t, r"([.,])[^.,]*$", 1)
        one = t.rlike(r"^[+-]?\d+[.,]\d{1,2}$")
        return F.when(both & (last == ","), _plain(t, ",")).when(both, _plain(t, ".")).when(one, F.replace(t, F.lit(","), F.lit("."))).when(t.rlike(r"^[+-]?\d+$"), t)

    value = F.bround(let(bare_amount(s), number).try_cast("decimal(30,8)"), 2)
    negative = F.trim(s).rlike(r"^[(（].*[)）]$")
    return F.when(negative, -value).otherwise(value).cast("decimal(28,2)").cast("string")
