"""Prices as they can be traded: adjusted basis, halts, price limits, filters at signal and at fill time, splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.window import by_time, div, two_valued
from panelspark.operators.buckets import daily_quintile

#: Fields that are known only when an order is filled.
FILL_FIELDS = frozenset({"hfq_open", "up_limit", "open", "down_limit"})
PRICES = ("open", "high", "low", "close")


def normalised(rows: DataFrame, names: dict[str, str], date: str = "date") -> DataFrame:
    """Columns by their usual names (old to new, where they are there), the date as a date, is_suspended as boolean `suspended`."""
    renamed = rows.withColumnsRenamed({old: new for old, new in names.items() if old in rows.columns})
    digits = F.regexp_replace(F.col(date).cast("string"), "[^0-9]", "")
    out = renamed.withColumn(date, F.try_to_date(F.substring(digits, 1, 8), "yyyyMMdd"))
    if "is_suspended" in out.columns:
        flag = F.lower(F.trim(F.col("is_suspended").cast("string"))).isin("1", "1.0", "true", "t", "yes", "y")
        out = out.withColumn("suspended", F.coalesce(flag, F.lit(False))).drop("is_suspended")
    return out


def on_basis(panel: DataFrame, basis: str, fields: tuple[str, ...], prefix: str = "hfq_") -> DataFrame:
    """(instrument, date, fields): prices "raw", or "adjusted" from the columns with the prefix; other fields as they are.

    A field that the panel has not is an error, whatever the basis.
    """
    if basis not in ("raw", "adjusted"):
        raise ValueError(f"no price basis: {basis}")
    source = {f: f"{prefix}{f}" if basis == "adjusted" and f in PRICES else f for f in fields}
    unknown = sorted(set(source.values()) - set(panel.columns))
    if unknown:
        raise ValueError(f"no such fields: {', '.join(unknown)}")
    return panel.select("instrument", "date", *[F.col(old).alias(new) for new, old in source.items()])


def adjust_factor(adjusted: Column, raw: Column, stated: Column | None = None) -> Column:
    """Adjusted over raw close; where that is unknown, the stated factor; 1 if no factor is stated."""
    return F.coalesce(div(adjusted, raw), F.lit(1.0) if stated is None else stated)


def without_halts(panel: DataFrame, suspended: Column, fields: tuple[str, ...] = (*PRICES, "vol")) -> DataFrame:
    """NULL prices and volume on suspended days; an unknown flag counts as not suspended."""
    stopped = two_valued(suspended)
    return panel.withColumns({f: F.when(~stopped, F.col(f)) for f in fields})


def verifiable(panel: DataFrame, limits: bool = True, suspension: bool = False) -> DataFrame:
    """Rows whose limits (and suspension) can be told: close and both limit prices known; none if a column is missing."""
    if limits:
        needed = ("close", "up_limit", "down_limit")
        if not set(needed) <= set(panel.columns):
            return panel.limit(0)
        panel = panel.dropna(subset=list(needed))
    if suspension and not {"suspended", "is_suspended"} & set(panel.columns):
        return panel.limit(0)
    return panel


def open_inside_limits() -> Column:
    """The usual filter at the fill: opened below the upper and above the lower limit."""
    return (F.col("open") < F.col("up_limit")) & (F.col("open") > F.col("down_limit"))


def sample_filter(flagged: Column, suspended: Column | None = None, off_low: bool = True, inside: bool = True, most_cap: float | None = None, cap: str = "float_market_cap") -> Column:
    """Rows for training or testing: not flagged, not suspended, closed above the low and inside the limits, not above a cap."""
    rule = two_valued(flagged == 0)
    if suspended is not None:
        rule = rule & ~two_valued(suspended)
    if off_low:
        rule = rule & two_valued(F.col("close") > F.col("low"))
    if inside:
        rule = rule & two_valued((F.col("close") < F.col("up_limit")) & (F.col("close") > F.col("down_limit")))
    return rule if most_cap is None else rule & two_valued(F.col(cap) <= most_cap)


@dataclass(frozen=True)
class OpenFilter:
    """A predicate for opening a position, with the fields that it reads."""

    fields: frozenset[str]
    predicate: Column

    @property
    def at_fill(self) -> bool:
        return bool(self.fields) and self.fields <= FILL_FIELDS


def may_open(panel: DataFrame, filters: list[OpenFilter], out: str = "may_open") -> DataFrame:
    """Add whether a signal of the date may be filled at the next bar.

    Filters on fill fields alone are asked of the next bar, all others of the
    signal's own; without a next bar no fill filter passes.
    """
    signal, fill = F.lit(True), F.lit(True)
    for f in filters:
        if f.at_fill:
            fill = fill & two_valued(f.predicate)
        else:
            signal = signal & two_valued(f.predicate)
    asked = any(f.at_fill for f in filters)
    marked = panel.withColumn("fill_", fill)
    later = F.coalesce(F.lead("fill_").over(by_time()), F.lit(False)) if asked else F.lit(True)
    return marked.withColumn(out, signal & later).drop("fill_")


def three_way(panel: DataFrame, date_from: str, train_end: str, validation_end: str, date_to: str) -> DataFrame:
    """Add split (train, validation, test) by inclusive ends; rows outside go. Ends that overlap or are reversed are an error."""
    if not date_from <= train_end < validation_end <= date_to:
        raise ValueError("train, validation and test overlap or are reversed")
    day = lambda text: F.lit(text).cast("date")
    inside = panel.where(F.col("date").between(day(date_from), day(date_to)))
    return inside.withColumn("split", F.when(F.col("date") <= day(train_end), "train").when(F.col("date") <= day(validation_end), "validation").otherwise("test"))


def score_parts(panel: DataFrame, train_end: str, valid_end: str, score_after: str, score_end: str | None = None) -> DataFrame:
    """Add is_train (to train_end), is_valid (after it, to valid_end) and is_score (after score_after, to score_end if given)."""
    day = lambda text: F.lit(text).cast("date")
    score = F.col("date") > day(score_after)
    return panel.withColumns({
        "is_train": F.col("date") <= day(train_end),
        "is_valid": (F.col("date") > day(train_end)) & (F.col("date") <= day(valid_end)),
        "is_score": score if score_end is None else score & (F.col("date") <= day(score_end)),
    })


def in_segment(rows: DataFrame, panel: DataFrame, field: str, bucket: int) -> DataFrame:
    """Rows whose instrument is in one daily quintile (1 to 5) of a field of the panel."""
    if not 1 <= bucket <= 5:
        raise ValueError("a bucket is from 1 to 5")
    chosen = daily_quintile(panel, field).where(F.col("bucket") == bucket).select("instrument", "date")
    return rows.join(chosen, ["instrument", "date"], "left_semi")


def with_stored(panel: DataFrame, stored: DataFrame, name: str) -> DataFrame:
    """Add a factor computed elsewhere, by instrument and date: its column `name` or factor_value."""
    value = name if name in stored.columns else "factor_value"
    return panel.join(stored.select("instrument", "date", F.col(value).alias(name)), ["instrument", "date"], "left")
