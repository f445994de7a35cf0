"""Universes: listing, board and suspension filters, as-of membership, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import window as w


def apply_suspensions(panel: DataFrame, suspensions: DataFrame) -> DataFrame:
    """Set is_suspended, and clear eligible, on the suspended days; `suspension_counts` says how many that were."""
    off = suspensions.where(F.col("suspend_type") == "S").select("instrument", "date", F.lit(True).alias("off_")).distinct()
    joined = panel.join(off, ["instrument", "date"], "left")
    stopped = F.coalesce("off_", F.lit(False))
    return joined.withColumns({"is_suspended": stopped, "eligible": F.col("eligible") & ~stopped}).drop("off_")


def suspension_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(marked, cleared): suspended rows, and rows that were eligible before and no longer are."""
    keys = before.select("instrument", "date", F.col("eligible").alias("was_"))
    joined = after.join(keys, ["instrument", "date"])
    return joined.agg(F.count_if("is_suspended").alias("marked"), F.count_if(F.col("was_") & ~F.col("eligible")).alias("cleared"))


def on_exchanges(code: str, suffixes: tuple[str, ...]) -> Column:
    """Whether a code ends in one of the exchange suffixes; all do if none are given."""
    return F.col(code).rlike("(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$") if suffixes else F.lit(True)


#: First digits of codes of the main, small-company and growth boards.
MAIN_BOARDS = ("600", "601", "603", "605", "000", "001", "002", "003", "300", "301")


def on_main_boards(code: str) -> Column:
    """Main, small-company and growth boards by the first three digits; never the .BJ exchange."""
    return ~F.col(code).endswith(".BJ") & F.substring(code, 1, 3).isin(*MAIN_BOARDS)


def off_boards(code: str, kind: str = "both") -> Column:
    """Whether a code is dropped: of the 688 board ("star"), of the 300 and 301 board ("growth"), or of either ("both")."""
    symbol = F.split_part(F.col(code), F.lit("."), F.lit(1))
    star, growth = symbol.startswith("688"), symbol.startswith("300") | symbol.startswith("301")
    return {"star": star, "growth": growth, "both": star | growth}[kind]


def to_prefixed(code: str) -> Column:
    """600000.SH as SH600000."""
    return F.concat(F.upper(F.split_part(F.col(code), F.lit("."), F.lit(2))), F.split_part(F.col(code), F.lit("."), F.lit(1)))


def to_suffixed(code: str) -> Column:
    """SH600000 as 600000.SH."""
    return F.concat_ws(".", F.substring(code, 3, 100), F.upper(F.substring(code, 1, 2)))


def compact_date(text: str) -> Column:
    """YYYYMMDD of dates written with or without separators; NULL where eight digits are no date."""
    digits = F.regexp_replace(F.col(text).cast("string"), "[^0-9]", "")
    return F.date_format(F.try_to_date(F.substring(digits, 1, 8), "yyyyMMdd"), "yyyyMMdd")


def iso_date(text: str) -> Column:
    """YYYY-MM-DD of dates written with or without separators."""
    return F.date_format(F.try_to_date(compact_date(text), "yyyyMMdd"), "yyyy-MM-dd")


def truthy(flag: str) -> Column:
    """Mixed flags as boolean: 1, true, t, yes and y count as true."""
    return F.coalesce(F.lower(F.trim(F.col(flag).cast("string"))).isin("1", "1.0", "true", "t", "yes", "y"), F.lit(False))


def listed(day: Column, list_date: Column, delist_date: Column) -> Column:
    """Listed on or before the day or unknown, and delisted after it or never."""
    return F.coalesce(list_date <= day, F.lit(True)) & F.coalesce(day < delist_date, F.lit(True))


def last_snapshots(days: DataFrame, snapshots: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, snapshot): the last snapshot on or before each day.

    Days and snapshot dates are one row each, so the ordered union is small; with
    `by` it is ordered within each key. Days before the first snapshot go.
    """
    keys = [F.col(k) for k in by]
    marks = snapshots.select(*keys, F.col("snapshot").alias("date"), F.col("snapshot").alias("snap_")).distinct()
    codes = snapshots.select(*keys).distinct() if by else None
    every = days.select("date") if codes is None else days.select("date").crossJoin(F.broadcast(codes))  # one row a session and index
    line = Window.partitionBy(*keys).orderBy("date", F.col("snap_").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = every.withColumn("snap_", F.lit(None).cast("date")).unionByName(marks)
    found = both.withColumn("snapshot", F.last("snap_", ignorenulls=True).over(line)).where(F.col("snap_").isNull() & F.col("snapshot").isNotNull())
    return found.select(*keys, "date", "snapshot")


def members_pooled(panel: DataFrame, days: DataFrame, membership: DataFrame) -> DataFrame:
    """Rows of instruments that any index held on the last pooled snapshot on or before the day.

    Snapshot dates of all indexes are pooled: an index without a row on the
    newest date drops out until its next snapshot.
    """
    current = last_snapshots(days, membership).join(membership.select("snapshot", F.col("con_code").alias("instrument")).distinct(), "snapshot")
    return panel.join(current.select("date", "instrument"), ["date", "instrument"], "left_semi")


def members_by_index(days: DataFrame, membership: DataFrame) -> DataFrame:
    """(index_code, date, instrument, weight): members of each index by its own last snapshot on or before the day."""
    asof = last_snapshots(days, membership, ("index_code",))
    held = membership.select("index_code", "snapshot", F.col("con_code").alias("instrument"), "weight")
    return asof.join(held, ["index_code", "snapshot"]).select("index_code", "date", "instrument", "weight")


def members_before(days: DataFrame, membership: DataFrame, back: int = 1) -> DataFrame:
    """(index_code, date, instrument, weight): members by the snapshot `back` before the last one on or before the day.

    Snapshot dates of all indexes are pooled: an index without rows on that
    date has no members then.
    """
    order = Window.orderBy("snapshot")  # one row a snapshot date
    shifted = membership.select("snapshot").distinct().withColumn("use_", F.lag("snapshot", back).over(order))
    asof = last_snapshots(days, membership).join(shifted, "snapshot").select("date", F.col("use_").alias("snapshot"))
    held = membership.select("index_code", "snapshot", F.col("con_code").alias("instrument"), "weight")
    return asof.join(held, "snapshot").select("index_code", "date", "instrument", "weight")


def missing_indexes(asked: DataFrame, day: str, membership: DataFrame) -> DataFrame:
    """(index_code): asked-for indexes (index_code) that have no members as of a day."""
    seen = membership.where(F.col("snapshot") <= F.lit(day).cast("date")).select("index_code").distinct()
    return asked.select("index_code").distinct().join(seen, "index_code", "left_anti")


def priority_gate(panel: DataFrame, members: DataFrame, gates: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """Rows whose first matching index, in the given order, is open on the date. gates: (index_code, date, open)."""
    order = F.array_position(F.array(*map(F.lit, priority)), F.col("index_code"))
    first = members.where(F.col("index_code").isin(*priority)).groupBy("date", "instrument").agg(F.min_by("index_code", order).alias("index_code"))
    open_ = gates.where("open").select("index_code", "date")
    allowed = first.join(open_, ["index_code", "date"], "left_semi")
    return panel.join(allowed.select("date", "instrument"), ["date", "instrument"], "left_semi")


def moving_average_gate(index_daily: DataFrame, n: int) -> DataFrame:
    """(index_code, date, open): open where an index closes above its own n-mean."""
    named = index_daily.select(F.col("ts_code").alias("instrument"), "date", "close")
    above = w.two_valued(F.col("close") > w.rolling_mean(F.col("close"), n))
    return named.select(F.col("instrument").alias("index_code"), "date", above.alias("open"))


def open_dates(gates: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """Dates on which all the named gates are open."""
    opened = gates.where(F.col("open") & F.col("index_code").isin(*codes))
    return opened.groupBy("date").agg(F.countDistinct("index_code").alias("n")).where(F.col("n") == len(codes)).select("date")


def tenure(membership: DataFrame) -> DataFrame:
    """(index_code, snapshot, con_code, tenure): consecutive snapshots of its index that a name has stayed."""
    return _islands(membership).withColumn(
        "tenure", F.row_number().over(Window.partitionBy("index_code", "con_code", "island_").orderBy("snapshot"))
    ).select("index_code", "snapshot", "con_code", "tenure")


def spans(membership: DataFrame) -> DataFrame:
    """(index_code, con_code, start, end, snapshots): runs of consecutive snapshots."""
    found = _islands(membership).groupBy("index_code", "con_code", "island_")
    return found.agg(F.min("snapshot").alias("start"), F.max("snapshot").alias("end"), F.count("*").alias("snapshots")).drop("island_")


def _islands(membership: DataFrame) -> DataFrame:
    dates = membership.select("index_code", "snapshot").distinct()
    numbered = dates.withColumn("n_", F.row_number().over(Window.partitionBy("index_code").orderBy("snapshot")))
    own = Window.partitionBy("index_code", "con_code").orderBy("snapshot")
    return membership.join(numbered, ["index_code", "snapshot"]).withColumn("island_", F.col("n_") - F.row_number().over(own))


def asof_backward(left: DataFrame, right: DataFrame, value: str, by: str = "instrument") -> DataFrame:
    """Add to each left row the last right value on or before its date, by key: one shuffle of the union."""
    a = left.withColumns({"side_": F.lit(1), "v_": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(by, "date", F.col(value).alias("v_")).withColumn("side_", F.lit(0))
    line = Window.partitionBy(by).orderBy("date", "side_").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last("v_", ignorenulls=True).over(line)).where(F.col("side_") == 1).drop("side_", "v_")


def allowed_dates(panel: DataFrame, dates: DataFrame | None) -> DataFrame:
    """Rows whose date is among the allowed ones; all rows if there is no such table (None), none if it is empty."""
    return panel if dates is None else panel.join(dates.select("date").distinct(), "date", "left_semi")


def passing_dates(index_daily: DataFrame, benchmark: Column, mean: int = 200) -> DataFrame:
    """(date): sessions of one index (date, close) on which a predicate of its close and its own mean, sma_<n>, holds; unknown is false."""
    named = index_daily.withColumn("instrument", F.lit("index")).withColumn(f"sma_{mean}", w.rolling_mean(F.col("close"), mean))
    return named.where(w.two_valued(benchmark)).select("date").distinct()


def before_trading(panel: DataFrame, stock: Column | None = None, index_daily: DataFrame | None = None, benchmark: Column | None = None, mean: int = 200) -> DataFrame:
    """Rows that pass a predicate of their own, on dates on which the benchmark passes one of its own.

    A predicate that is not given lets all pass; one that is unknown for a row is
    false. With a benchmark predicate but no index no row passes.
    """
    kept = panel if stock is None else panel.where(w.two_valued(stock))
    if benchmark is None:
        return kept
    return kept.limit(0) if index_daily is None else allowed_dates(kept, passing_dates(index_daily, benchmark, mean))
