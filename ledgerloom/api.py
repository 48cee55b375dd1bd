"""The engine by what it does: read words, validate fields, evaluate predictions, search parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import normalize as N
from ledgerloom.lineage import cut
from ledgerloom.operators import candidates as K
from ledgerloom.operators import consensus as C
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import layout as L
from ledgerloom.operators import reading as R
from ledgerloom.schema import FIELDS, MONEY


@dataclass(frozen=True)
class Config:
    vote: C.VoteConfig = field(default_factory=C.VoteConfig)
    decimal_separator: str = "auto"
    date_order: str = "auto"
    tax_id_pattern: str | None = None
    check_balance: bool = True
    tolerance: str = "0.02"
    high: float = 0.6
    medium: float = 0.3


def candidates(words: DataFrame, config: Config = Config()) -> DataFrame:
    """Every value that a view proposes for a field. words: see schema.WORDS."""
    rows = cut(L.visual_rows(words))
    parts = [L.labelled_amounts(rows), L.arithmetic_rows(rows), L.cash_totals(rows), K.dates(rows, config.date_order), K.identifiers(rows), K.table_columns(rows), K.aligned_below(rows), K.deposit_and_balance(rows)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    cents = F.when(F.col("field").isin(*MONEY), F.regexp_replace("norm", r"\.", "").try_cast("long"))
    return found.select(F.col("doc_id").alias("doc"), "view", "row_no", "field", "raw", "norm", cents.alias("cents"), F.col("score").cast("int").alias("score"), "rule")


def extract(words: DataFrame, config: Config = Config()) -> DataFrame:
    """One row a document and field: value (null where it abstains), confidence, alert."""
    views = words.groupBy(F.col("doc_id").alias("doc")).agg(F.count_distinct("view").alias("n_all"))
    read = R.read_fields(words, candidates(words, config), config.vote).join(views, "doc")
    agreement = F.col("n_views") / F.col("n_all")
    high, medium = agreement >= config.high, agreement >= config.medium
    step = F.when(high, 2).when(medium, 1).otherwise(0) - F.col("alert").isNotNull().cast("int")  # an alert takes a level
    level = F.when(F.col("value").isNull(), "sin_valor").when(step >= 2, "alta").when(step == 1, "media").otherwise("baja")
    return read.select("doc", "field", "value", level.alias("confidence"), "alert")


def rescued(words: DataFrame, config: Config = Config()) -> DataFrame:
    """doc, field, value, rescued: what extract leaves empty, by a second vote that counts words by confidence."""
    found = cut(candidates(words, config))
    return R.rescue(R.read_fields(words, found, config.vote).select("doc", "field", "value"), words, found, config.vote)


def documents(fields: DataFrame) -> DataFrame:
    """Fields of a document side by side; a total from the subtotal where that is all there is."""
    return C.total_from_subtotal(fields.groupBy("doc").pivot("field", list(FIELDS)).agg(F.first("value")))


def validate(docs: DataFrame, config: Config = Config()) -> DataFrame:
    states = N.validate({f: F.col(f) for f in FIELDS}, tax_id_pattern=config.tax_id_pattern, check_balance=config.check_balance, tolerance=config.tolerance, decimal_separator=config.decimal_separator, date_order=config.date_order)
    return docs.withColumns({f"state_{k}": v for k, v in states.items()})


def evaluate(gold: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detail and metrics of predictions against gold."""
    detail = E.score_fields(gold, predictions)
    return detail, E.field_metrics(detail, FIELDS)


class Reader:
    """Words to documents with validation, under one configuration."""

    def __init__(self, config: Config = Config()) -> None:
        self.config = config

    def read(self, words: DataFrame) -> DataFrame:
        return validate(documents(extract(words, self.config)), self.config)

    def about(self) -> dict[str, object]:
        on = [k for k in ("fuzzy", "dominance", "balance", "printed", "paid", "semantic", "geometry", "consistency", "accounting") if getattr(self.config.vote, k)]
        return {"fields": list(FIELDS), "enabled": on, "date_order": self.config.date_order, "decimal_separator": self.config.decimal_separator}
