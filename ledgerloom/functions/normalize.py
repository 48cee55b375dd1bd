"""One normal form for each field, and the checks on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.dates import normalize_date
from ledgerloom.functions.money import money
from ledgerloom.functions.text import text_key
from ledgerloom.schema import FIELDS, MONEY


def normalize(field: Column, value: Column, decimal_separator: str = "auto", date_order: str = "auto") -> Column:
    """Null for blanks; RAW:text for money and dates that can't be read; identifiers in capitals without spaces."""
    v = F.when(F.trim(value) != "", value)
    raw = F.concat(F.lit("RAW:"), text_key(v))
    amount = F.coalesce(money(v, decimal_separator), F.replace(raw, F.lit(" "), F.lit("")))
    return F.when(field.isin(*MONEY), amount).when(field == "date", F.coalesce(normalize_date(v, date_order), raw)).otherwise(F.upper(F.regexp_replace(v, r"\s+", "")))


def normalize_field(field: str, value: Column, **options: str) -> Column:
    if field not in FIELDS:
        raise ValueError(f"unknown field {field}")
    return normalize(F.lit(field), value, **options)


def validate(fields: dict[str, Column], *, tax_id_pattern: str | None = None, check_balance: bool = True, tolerance: str = "0.02", decimal_separator: str = "auto", date_order: str = "auto") -> dict[str, Column]:
    """State of each field and of the balance. A document number has a state only when it is missing."""
    out: dict[str, Column] = {}
    for f in MONEY:
        out[f] = F.when(fields[f].isNull(), "missing").when(money(fields[f], decimal_separator).isNotNull(), "valid_format").otherwise("ambiguous_or_invalid_format")
    day = normalize_date(fields["date"], date_order)
    out["date"] = F.when(fields["date"].isNull(), "missing").when(day.isNull(), "invalid_format").when(day.startswith("AMBIGUOUS:"), "ambiguous_date_order").otherwise("valid_format")
    out["document_number"] = F.when(fields["document_number"].isNull(), "missing")
    has_id = F.coalesce(fields["tax_id"], F.lit("")) != ""
    out["tax_id"] = F.when(~has_id, "missing").otherwise("not_configured") if tax_id_pattern is None else F.when(~has_id, "missing").when(fields["tax_id"].rlike(f"^(?:{tax_id_pattern})$"), "valid_structure").otherwise("invalid_structure")
    amounts = [money(fields[f], decimal_separator).cast("decimal(28,2)") for f in MONEY]
    some_missing = amounts[0].isNull() | amounts[1].isNull() | amounts[2].isNull()
    even = F.abs(amounts[0] + amounts[1] - amounts[2]) <= F.lit(tolerance).cast("decimal(28,2)")
    out["amount_balance"] = F.when(some_missing, "insufficient_data").when(even, "consistent").otherwise("inconsistent_review") if check_balance else F.lit("not_applicable")
    return out
