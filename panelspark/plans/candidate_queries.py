"""Generated candidates: metrics by period, decisions, own books and batch scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import sqltext as q
from panelspark.functions.series import Stages
from panelspark.operators import candidates as c
from panelspark.operators import trading
from panelspark.plans.catalogue import REGISTRY
from panelspark.plans.common import r
from panelspark.plans.diagnostic_queries import SCORED_SQL, scored
from panelspark.sources.panel import BARS_SQL, table, with_sql

CHOSEN = c.formulas(["close", "turn", "pe_ttm"], ["identity", "cs_rank", "pct_change", "rolling_bias", "ts_zscore"], [5, 10], seed=3, most=8)
NAMES = [c.name_of(x) for x in CHOSEN]
DIGITS = 5
#: Of each operator the SQL text, written out apart from the operators' own code.
BY_HAND = {
    "identity": lambda x, n: x,
    "cs_rank": lambda x, n: q.cs_rank(x),
    "pct_change": lambda x, n: f"{x} / nullif(lag({x}, {n}) OVER ({q.BY_TIME}), 0) - 1",
    "rolling_bias": lambda x, n: f"CASE WHEN count({x}) OVER {q.last_n(n)} = {n} THEN {x} / nullif(avg({x}) OVER {q.last_n(n)}, 0) - 1 END",
    "ts_zscore": lambda x, n: f"CASE WHEN count({x}) OVER {q.last_n(n)} = {n} THEN ({x} - avg({x}) OVER {q.last_n(n)}) / nullif(stddev_samp({x}) OVER {q.last_n(n)}, 0) END",
}
WIDE_SQL = (
    "wide AS (SELECT instrument, date, label, CASE WHEN date <= DATE '1995-06-30' THEN 'train' WHEN date <= DATE '1996-12-31' THEN 'validation' ELSE 'test' END AS split, "
    + ", ".join(f"(round({BY_HAND[o](f, n)}, {DIGITS}) + 0.0) AS {c.name_of((f, o, n))}" for f, o, n in CHOSEN)
    + " FROM scored WHERE date <= DATE '1998-12-31')"
)
LONG_SQL = "long AS (" + " UNION ALL ".join(f"SELECT '{n}' AS candidate, split, date, instrument, label, {n} AS f FROM wide" for n in NAMES) + ")"
PERIOD_SQL = """
pairs AS (SELECT * FROM long WHERE f IS NOT NULL AND label IS NOT NULL),
ranked AS (
  SELECT candidate, split, date, rank() OVER (PARTITION BY candidate, date ORDER BY f) + (count(*) OVER (PARTITION BY candidate, date, f) - 1) / 2 AS fr,
    rank() OVER (PARTITION BY candidate, date ORDER BY label) + (count(*) OVER (PARTITION BY candidate, date, label) - 1) / 2 AS lr FROM pairs
),
ics AS (SELECT candidate, split, date, covar_pop(fr, lr) / nullif(stddev_pop(fr) * stddev_pop(lr), 0) AS ic FROM ranked GROUP BY 1, 2, 3 HAVING count(*) >= 2),
ic AS (SELECT candidate, split, avg(ic) AS rank_ic, count(ic) AS rank_ic_days FROM ics WHERE ic IS NOT NULL GROUP BY 1, 2),
ends AS (SELECT candidate, split, date, quantile_cont(f, 0.1) AS lo, quantile_cont(f, 0.9) AS hi FROM pairs GROUP BY 1, 2, 3 HAVING count(*) >= 2),
spreads AS (SELECT candidate, split, date, avg(label) FILTER (WHERE f >= hi) - avg(label) FILTER (WHERE f <= lo) AS s FROM pairs JOIN ends USING (candidate, split, date) GROUP BY 1, 2, 3),
spread AS (SELECT candidate, split, avg(s) AS group_spread, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS positive FROM spreads WHERE s IS NOT NULL GROUP BY 1, 2),
counted AS (SELECT candidate, split, count(*) AS rows, count(f) AS finite_rows FROM long GROUP BY 1, 2),
period AS (SELECT *, finite_rows / rows AS coverage FROM counted LEFT JOIN ic USING (candidate, split) LEFT JOIN spread USING (candidate, split))"""


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages()
    columns = c.columns(stages, CHOSEN)
    panel = scored(spark, sf_dir)
    values = stages.frame(panel, columns, ("instrument", "date", "label"), DIGITS)
    return trading.three_way(values, "1992-01-01", "1995-06-30", "1996-12-31", "1998-12-31")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.stacked(_wide(spark, sf_dir), NAMES, ("date", "instrument", "label", "split"))


@REGISTRY.query("candidate_periods", with_sql(BARS_SQL, SCORED_SQL, WIDE_SQL, LONG_SQL, PERIOD_SQL, select="SELECT candidate, split, rows, finite_rows, round(coverage, 6) AS coverage, round(rank_ic, 6) + 0.0 AS rank_ic, coalesce(rank_ic_days, 0) AS rank_ic_days, round(group_spread, 6) + 0.0 AS group_spread, round(positive, 6) AS positive_spread_ratio FROM period"))
def candidate_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, operators and windows, generated, put into one projection, then measured by candidate and split in one job."""
    told = c.period_metrics(_long(spark, sf_dir), "label")
    exact = ("candidate", "split", "rows", "finite_rows", "rank_ic_days")
    return told.select(*[F.col(x) if x in exact else r(F.col(x)).alias(x) for x in told.columns])


def _corr(a: str, b: str) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"abs(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0))"


#: A candidate is kept if none of the kept ones before it is among those that it correlates with.
DECIDED_SQL = "corr AS (" + " UNION ALL ".join(
    f"SELECT {i} AS a, {j} AS b, {_corr(NAMES[i], NAMES[j])} AS r FROM wide WHERE split = 'train'" for i in range(len(NAMES)) for j in range(i + 1, len(NAMES))
) + f"""),
close_to AS (SELECT k AS b, coalesce(list(a) FILTER (WHERE r >= 0.6), []) AS l FROM (SELECT unnest(range({len(NAMES)})) AS k) LEFT JOIN corr ON b = k GROUP BY 1),
kept(i, ids) AS (
  SELECT 0, [0]::BIGINT[]
  UNION ALL
  SELECT i + 1, CASE WHEN len(list_intersect(l, ids)) = 0 THEN list_append(ids, i + 1) ELSE ids END FROM kept JOIN close_to ON b = i + 1
),
alone AS (SELECT unnest(ids) AS k FROM kept WHERE i = {len(NAMES) - 1}),
named AS (SELECT unnest({NAMES!r}) AS candidate, unnest(range({len(NAMES)})) AS k),
told AS (
  SELECT candidate, k IN (SELECT k FROM alone) AS alone, coalesce(coverage >= 0.9 AND rank_ic >= 0.0, false) AS passes FROM named JOIN (SELECT * FROM period WHERE split = 'validation') USING (candidate)
)"""


@REGISTRY.query("candidate_decisions", with_sql(BARS_SQL, SCORED_SQL, WIDE_SQL, LONG_SQL, PERIOD_SQL, DECIDED_SQL, select="SELECT candidate, CASE WHEN alone AND passes THEN 'accepted' ELSE 'rejected' END AS decision, CASE WHEN NOT alone THEN 'correlated_with_existing_candidate' WHEN passes THEN 'validation_thresholds_passed' ELSE 'validation_thresholds_failed' END AS reason FROM told").replace("WITH ", "WITH RECURSIVE ", 1))
def candidate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.decisions(_wide(spark, sf_dir), NAMES, "label", coverage=0.9, rank_ic=0.0, limit=0.6)


BOOKS_SQL = """
held AS (SELECT * FROM long WHERE f IS NOT NULL AND label IS NOT NULL),
top AS (SELECT candidate, split, date, instrument, label, 0.095 AS weight FROM held QUALIFY row_number() OVER (PARTITION BY candidate, split, date ORDER BY f DESC, instrument) <= 10),
steps AS (SELECT candidate, split, date, lead(date) OVER (PARTITION BY candidate, split ORDER BY date) AS next_ FROM (SELECT DISTINCT candidate, split, date FROM top)),
gone AS (SELECT candidate, split, next_ AS date, instrument, weight AS before FROM top JOIN steps USING (candidate, split, date) WHERE next_ IS NOT NULL),
moves AS (SELECT candidate, split, date, coalesce(t.weight, 0) - coalesce(g.before, 0) AS change FROM top t FULL JOIN gone g USING (candidate, split, date, instrument)),
summed AS (SELECT candidate, split, date, sum(greatest(change, 0)) AS bought, sum(greatest(-change, 0)) AS sold FROM moves GROUP BY 1, 2, 3),
gross AS (SELECT candidate, split, date, sum(weight * label) AS gross FROM top GROUP BY 1, 2, 3),
bench AS (SELECT candidate, split, date, avg(label) AS bench FROM held GROUP BY 1, 2, 3),
book AS (SELECT candidate, split, date, gross - 0.0005 * bought - 0.0015 * sold AS ret, bench FROM gross JOIN summed USING (candidate, split, date) JOIN bench USING (candidate, split, date)),
own AS (
  SELECT candidate, split, count(*) AS days, sum(ln(1 + greatest(ret, -0.999999))) AS lw, sum(ln(1 + greatest(bench, -0.999999))) AS lb, avg(ret - bench) / nullif(stddev_samp(ret - bench), 0) * sqrt(52) AS ir FROM book GROUP BY 1, 2
),
judged AS (SELECT candidate, coalesce(exp(lw * 52 / days) > exp(lb * 52 / days) AND ir > 0, false) AS accepted FROM own WHERE split = 'validation')"""


@REGISTRY.query("batch_scores", with_sql(BARS_SQL, SCORED_SQL, WIDE_SQL, LONG_SQL, PERIOD_SQL, BOOKS_SQL, select="SELECT p.candidate, p.split, round(rank_ic, 6) + 0.0 AS rank_ic, days, round(lw, 4) + 0.0 AS log_wealth, round(lb, 4) + 0.0 AS bench_log_wealth, round(ir, 4) + 0.0 AS information_ratio, coalesce(accepted, false) AS accepted FROM period p LEFT JOIN own USING (candidate, split) LEFT JOIN judged USING (candidate)"))
def batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank IC and own book of every candidate in every split; accepted by the validation book alone."""
    told = c.batch_scores(_long(spark, sf_dir), "label", 10)
    digits = {"rank_ic": 6, "log_wealth": 4, "bench_log_wealth": 4, "information_ratio": 4}
    return told.select(*[r(F.col(x), digits[x]).alias(x) if x in digits else F.col(x) for x in told.columns])


PROPOSED_SQL = """
proposed AS (SELECT p_partkey, 'Factor ' || (p_partkey % 40) AS name, p_type || ' . mean( ' || p_size || ' )' AS formula FROM part WHERE p_partkey % 2 = 0),
known AS (SELECT 'factor ' || (p_partkey % 40) AS name, replace(p_type || '.mean(' || p_size || ')', ' ', '') AS formula FROM part WHERE p_partkey % 14 = 1)"""


@REGISTRY.query("unknown_formulas", with_sql(PROPOSED_SQL, select="SELECT p_partkey, name, formula FROM proposed WHERE replace(formula, ' ', '') NOT IN (SELECT formula FROM known) AND lower(name) NOT IN (SELECT name FROM known)"))
def unknown_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    size, kind, name = F.col("p_size").cast("string"), F.col("p_type"), (F.col("p_partkey") % 40).cast("string")
    proposed = parts.where(F.col("p_partkey") % 2 == 0).select("p_partkey", F.concat(F.lit("Factor "), name).alias("name"), F.concat(kind, F.lit(" . mean( "), size, F.lit(" )")).alias("formula"))
    known = parts.where(F.col("p_partkey") % 14 == 1).select(F.concat(F.lit("factor "), name).alias("name"), F.concat(kind, F.lit(".mean("), size, F.lit(")")).alias("formula"))
    return c.unknown_formulas(proposed, known)
