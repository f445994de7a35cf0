"""Labels' surroundings: calendars, splits, embargo, folds, filters in stages, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.window import two_valued
from panelspark.operators.quantiles import exact_quantiles


def period_ends(calendar: DataFrame, unit: str) -> DataFrame:
    """(unit, date): the last session of each week or month."""
    return calendar.groupBy(F.date_trunc(unit, "date").cast("date").alias(unit)).agg(F.max("date").alias("date"))


def shift_sessions(calendar: DataFrame, n: int) -> DataFrame:
    """(date, later): the session n after each, NULL past the end."""
    after = calendar.select((F.col("session") - n).alias("session"), F.col("date").alias("later"))
    return calendar.join(after, "session", "left").select("date", "later")


def last_session(calendar: DataFrame, now_utc: Column, zone: str = "Asia/Shanghai", ready_hour: int = 16) -> DataFrame:
    """(date): the last session that is complete: today's counts from ready_hour on, local time."""
    local = F.from_utc_timestamp(now_utc, zone)
    open_until = F.when(F.hour(local) >= ready_hour, local.cast("date")).otherwise(F.date_sub(local.cast("date"), 1))
    return calendar.where(F.col("date") <= open_until).agg(F.max("date").alias("date"))


def funnel(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows, and rows left after each further predicate, in one aggregation."""
    passed, counts = F.lit(True), [F.count("*").alias("rows")]
    for name, predicate in stages.items():
        passed = passed & two_valued(predicate)
        counts.append(F.count_if(passed).alias(name))
    return rows.agg(*counts)


def friday_week(date: str = "date") -> Column:
    """The Friday that ends a date's week."""
    return F.next_day(F.date_sub(F.col(date), 1), "FRI")


def by_section(rows: DataFrame, validation_from: str, train: Column, validation: Column) -> DataFrame:
    """Rows that pass the predicate of their section."""
    return rows.where(F.when(F.col("date") < F.lit(validation_from).cast("date"), two_valued(train)).otherwise(two_valued(validation)))


def unit_normalised(panel: DataFrame, column: str, bound: float, factor: int = 1000) -> DataFrame:
    """Multiply a column by `factor` if its median is below the bound."""
    middle = exact_quantiles(panel, {"x": F.col(column)}, (0.5,))["x"][0]
    return panel.withColumn(column, F.col(column) * (1 if middle is not None and middle >= bound else factor))


def holdout(panel: DataFrame, calendar: DataFrame, share: float = 0.2, least: int = 5) -> DataFrame:
    """Add split: the last share of the sessions is 'valid', if there are enough of them."""
    days = calendar.agg(F.max("session").alias("n_"))
    first = F.when(F.col("n_") >= least, F.col("n_") - F.ceil(F.col("n_") * share)).otherwise(F.col("n_"))
    marked = calendar.crossJoin(F.broadcast(days)).select("date", F.when(F.col("session") > first, "valid").otherwise("train").alias("split"))
    return panel.join(marked, "date")


def embargoed(panel: DataFrame, calendar: DataFrame, predict_from: str, hold: int) -> DataFrame:
    """Training rows whose label, hold + 1 sessions ahead, ends before the prediction begins."""
    cut = calendar.where(F.col("date") >= F.lit(predict_from).cast("date")).agg((F.min("session") - (hold + 1)).alias("cut_"))
    early = calendar.crossJoin(F.broadcast(cut)).where(F.col("session") <= F.col("cut_")).select("date")
    return panel.join(early, "date", "left_semi")


def walk_forward_folds(calendar: DataFrame, train_months: int, test_months: int, hold: int) -> DataFrame:
    """(fold, train_from, label_cutoff, test_from, test_to), test_to exclusive; a row for each fold."""
    ends = calendar.agg(F.date_trunc("month", F.min("date")).cast("date").alias("a"), F.date_trunc("month", F.max("date")).cast("date").alias("b"), F.max("date").alias("last_"))
    start = F.explode(F.expr(f"sequence(a, b, INTERVAL {test_months} MONTH)")).alias("train_from")
    folds = ends.select(start, "last_").withColumns({"test_from": F.add_months("train_from", train_months), "test_to": F.add_months("train_from", train_months + test_months)})
    folds = folds.where(F.col("test_to") <= F.col("last_")).drop("last_")
    first = folds.join(calendar, F.col("date") >= F.col("test_from")).groupBy("train_from").agg((F.min("session") - (hold + 1)).alias("session"))
    cut = first.join(calendar, "session").select("train_from", F.col("date").alias("label_cutoff"))
    fold = F.row_number().over(Window.orderBy("train_from"))
    return folds.join(cut, "train_from").select(fold.alias("fold"), "train_from", "label_cutoff", "test_from", "test_to")


def fold_rows(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Panel rows with fold and part ('train' up to the label cutoff, 'test' in the test window).

    Sessions are matched with folds first (both tables are small: a row a
    session, a row a fold); panel rows then meet their folds by an equi-join.
    """
    day = F.col("date")
    train = day.between(F.col("train_from"), F.col("label_cutoff"))
    test = (day >= F.col("test_from")) & (day < F.col("test_to"))
    days = panel.select("date").distinct().join(F.broadcast(folds), train | test)
    return panel.join(days.withColumn("part", F.when(train, "train").otherwise("test")), "date")
