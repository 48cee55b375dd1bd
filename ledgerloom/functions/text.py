"""Text keys, glyph repair, patterns and other scalar functions, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value worked out once, however often the body names it: keeps generated code small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _folding() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose to one ASCII letter, and those letters."""
    pairs = [(chr(c), d) for c in range(0xA0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _folding()


def text_key(s: Column) -> Column:
    """Accents folded, what is left outside ASCII dropped, lower case, single spaces. Exact for Latin letters; see
    text_key_exact for the rest."""
    ascii_only = F.when(F.octet_length(s) == F.char_length(s), s).otherwise(F.regexp_replace(F.translate(s, _FROM, _TO), r"[^\x00-\x7F]", ""))
    return F.trim(F.regexp_replace(F.lower(ascii_only), r"[\s\x1c-\x1f]+", " "))


@F.pandas_udf(StringType())
def text_key_exact(s: pd.Series) -> pd.Series:
    """Full compatibility decomposition, which no built-in function has."""
    folded = s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower(), na_action="ignore")
    return folded.str.replace(r"\s+", " ", regex=True).str.strip()


# What readers make of a currency sign before an amount, and currency names.
CURRENCY_NOISE = ("rm", "rn", "pm", "fm", "tm", "am", "em", "im", "om", "um", "hm", "nm", "mm", "rrm")
CURRENCIES = ("usd", "eur", "gbp", "rm", "idr", "rp", "rs", "sgd")
#: Signs that are read for the letters of "total", and those letters.
LOOKALIKES = ("01i!|)", "olllll")


def phrases(*words: str) -> str:
    """A pattern for any of some phrases, whole words, the longest first; their words may stand apart or together."""
    ordered = sorted(words, key=len, reverse=True)
    return r"\b(?:" + "|".join(r"[\s:-]*".join(w.split()) for w in ordered) + r")\b"


def _word(w: Column) -> Column:
    """One word put right: an amount with letters for digits or a currency stuck to it, or a garbled total."""
    shape = r"^(.*?)([0-9o&]+[.,][0-9o&]{2})([^a-z0-9&]*)$"
    front, number, tail = (F.regexp_extract(w, shape, k) for k in (1, 2, 3))
    letters = F.regexp_extract(front, "[a-z]*$", 0)
    amount = F.concat(F.regexp_replace(front, "[a-z]*$", ""), F.translate(number, "o&", "08"), tail)
    whole = F.regexp_extract(w, "^[a-z]+(?=[0-9])", 0)
    skeleton = F.regexp_replace(F.translate(w, *LOOKALIKES), "ll$", "l")
    return (
        F.when((number != "") & letters.isin("", *CURRENCY_NOISE, *CURRENCIES), amount)
        .when((whole != "") & whole.isin(*CURRENCIES), F.substr(w, F.length(whole) + 1))
        .when(skeleton.isin("total", "subtotal"), skeleton)
        .otherwise(w)
    )


def repair_glyphs(s: Column) -> Column:
    """Readings of amounts and of the word total put right, word by word; other words only lose their capitals."""
    words = F.transform(F.split(F.regexp_replace(F.lower(s), r"(?<=[0-9]) *([.,]) *(?=[0-9])", "$1"), " ", -1), _word)
    stroke = lambda w: F.translate(w, *LOOKALIKES).isin("l", "ll")

    def joined(line: Column, w: Column) -> Column:
        """A total that was read in two pieces is one word."""
        return F.when(line.rlike(r"\btota$") & stroke(w), F.concat(line, F.lit("l"))).when(line.rlike(r"\bsub$") & (w == "total"), F.concat(line, w)).otherwise(F.concat(line, F.lit(" "), w))

    return F.aggregate(F.slice(words, 2, F.greatest(F.lit(1), F.size(words))), F.element_at(words, 1), joined)


def pattern_class(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"[A-Za-z]", "A"), r"\d", "9")


def tfidf_text(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), r"\d", "0")


def near_strings(a: Column, b: Column) -> Column:
    """One edit apart, neither kept raw."""
    return (F.levenshtein(a, b, 1) == 1) & ~a.startswith("RAW:") & ~b.startswith("RAW:")


def bounding_box(coords: Column) -> Column:
    """Four or eight coordinates to x0, y0, x1, y1."""
    xs, ys = F.filter(coords, lambda _, i: i % 2 == 0), F.filter(coords, lambda _, i: i % 2 == 1)
    return F.when(F.size(coords) == 4, coords).when(F.size(coords) == 8, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def original_box(box: Column, scale_x: Column, scale_y: Column, border: Column, width: Column, height: Column) -> Column:
    """Back from a scaled, bordered image to the original, within its bounds."""
    at = lambda k, scale, top: F.greatest(F.lit(0.0), F.least(top, (F.element_at(box, k) - border) / scale))
    return F.array(at(1, scale_x, width), at(2, scale_y, height), at(3, scale_x, width), at(4, scale_y, height))


def page_percent(box: Column, width: Column, height: Column, margin: float = 6) -> Column:
    """A box as left, top, width, height in percent of the page, with a margin, within the page."""
    x0, y0 = F.greatest(F.lit(0.0), F.element_at(box, 1) - margin), F.greatest(F.lit(0.0), F.element_at(box, 2) - margin)
    x1, y1 = F.least(width, F.element_at(box, 3) + margin), F.least(height, F.element_at(box, 4) + margin)
    return F.array(100 * x0 / width, 100 * y0 / height, 100 * (x1 - x0) / width, 100 * (y1 - y0) / height)


def extraction_status(fields: Column) -> Column:
    """fields: map. By how many of the four main fields have a value."""
    n = sum((F.element_at(fields, k).isNotNull().cast("int") for k in ("date", "subtotal", "tax", "total")), F.lit(0))
    return F.when(n == 0, "sin_campos").when(n < 4, "lectura_parcial").otherwise("lectura_por_verificar")


def view_name(preprocess: Column, psm: Column, model: Column, rescue: Column) -> Column:
    return F.concat(F.concat_ws("·", preprocess, F.concat(F.lit("psm"), psm.cast("string")), model), F.when(rescue, "·rescate").otherwise(""))


def electronic_receipt(text: Column) -> Column:
    """A 49-digit key, or the words that go with one."""
    return F.regexp_replace(text, r"\s", "").rlike(r"(?<!\d)\d{49}(?!\d)") | text.rlike(r"(?i)clave\s+de\s+acceso|n[uú]mero\s+de\s+autorizaci[oó]n")
