"""Linear models and walk-forward folds from sums of products, with the same elimination and descent written as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import diagnostics, gram, labels
from panelspark.plans.catalogue import REGISTRY
from panelspark.plans.common import r
from panelspark.plans.diagnostic_queries import SCORED_SQL, scored
from panelspark.sources.panel import BARS_SQL, CALENDAR_SQL, bars, calendar, with_sql

FEATURES = ("momentum_5", "turn", "pe_ttm", "dividend_yield_ratio")


def moments_sql(rows: str, features: tuple[str, ...], by: str) -> str:
    """moments: means m_i, my, and centred sums of products g_i_j, h_i of complete rows, by group."""
    x = list(enumerate(features))
    whole = " AND ".join(f"{c} IS NOT NULL" for c in (*features, "label"))
    means = ", ".join([*[f"avg({c}) OVER w AS m_{i}" for i, c in x], "avg(label) OVER w AS my"])
    sums = [f"sum(({a} - m_{i}) * ({b} - m_{j})) AS g_{i}_{j}" for i, a in x for j, b in x] + [f"sum(({a} - m_{i}) * (label - my)) AS h_{i}" for i, a in x]
    first = ", ".join([*[f"any_value(m_{i}) AS m_{i}" for i, _ in x], "any_value(my) AS my"])
    return (
        f"centred AS (SELECT *, {means} FROM {rows} WHERE {whole} WINDOW w AS (PARTITION BY {by})),\n"
        f"moments AS (SELECT {by}, count(*)::DOUBLE AS n, {first}, {', '.join(sums)} FROM centred GROUP BY {by} HAVING count(*) >= 30)"
    )


def eliminated_sql(k: int, by: str, ridge: float) -> str:
    """solved: coefficients b_i by Gauss-Jordan elimination of the centred sums, ridge added to the diagonal."""
    entry = lambda i, j: f"g_{i}_{j}" + (f" + {ridge!r}" if i == j and ridge else "")
    parts = [f"e0 AS (SELECT {by}, my, {', '.join(f'm_{i}' for i in range(k))}, " + ", ".join([*[f"{entry(i, j)} AS a_{i}_{j}" for i in range(k) for j in range(k)], *[f"h_{i} AS a_{i}_{k}" for i in range(k)]]) + " FROM moments)"]
    for p in range(k):
        cells = [f"a_{p}_{j} / a_{p}_{p} AS a_{p}_{j}" if i == p else f"a_{i}_{j} - a_{i}_{p} * a_{p}_{j} / a_{p}_{p} AS a_{i}_{j}" for i in range(k) for j in range(k + 1)]
        parts.append(f"e{p + 1} AS (SELECT {by}, my, {', '.join(f'm_{i}' for i in range(k))}, {', '.join(cells)} FROM e{p})")
    return ",\n".join(parts) + f",\nsolved AS (SELECT {by}, {', '.join(f'a_{i}_{k} AS b_{i}' for i in range(k))}, my - ({' + '.join(f'm_{i} * a_{i}_{k}' for i in range(k))}) AS b0 FROM e{k})"


def descended_sql(k: int, by: str, alpha: float, share: float, sweeps: int = 400) -> str:
    """solved: coefficients by cyclic descent, one coordinate a step, soft thresholds at alpha * share."""
    columns = ", ".join(f"b_{i}" for i in range(k))
    rest = lambda j: f"(h_{j} - ({' + '.join(f'g_{j}_{i} * b_{i}' for i in range(k) if i != j)})) / n"
    cases = [f"CASE WHEN step % {k} = {j} THEN sign({rest(j)}) * greatest(abs({rest(j)}) - {alpha * share!r}, 0) / (g_{j}_{j} / n + {alpha * (1 - share)!r}) ELSE b_{j} END" for j in range(k)]
    return f"""descent({by}, step, {columns}) AS (
      SELECT {by}, 0, {', '.join('0.0::DOUBLE' for _ in range(k))} FROM moments
      UNION ALL SELECT {by}, step + 1, {', '.join(cases)} FROM descent JOIN moments USING ({by}) WHERE step < {sweeps * k}
    ),
    solved AS (SELECT {by}, {columns}, my - ({' + '.join(f'm_{i} * b_{i}' for i in range(k))}) AS b0 FROM descent JOIN moments USING ({by}) WHERE step = {sweeps * k})"""


SCORE = "b0 + " + " + ".join(f"b_{i} * {c}" for i, c in enumerate(FEATURES))
KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
SPLIT_SQL = """
cutoff AS (SELECT min(session) - 3 AS cut FROM calendar WHERE date >= DATE '1997-01-01'),
early AS (SELECT 1 AS fold, s.* FROM scored s JOIN calendar USING (date), cutoff WHERE session <= cut)"""
FOLDS_SQL = """
ends AS (SELECT date_trunc('month', min(date))::DATE AS a, max(date) AS b FROM calendar),
starts AS (SELECT (a + INTERVAL (12 * k) MONTH)::DATE AS train_from, b FROM ends, generate_series(0, 40) s(k)),
spans AS (SELECT train_from, (train_from + INTERVAL 24 MONTH)::DATE AS test_from, (train_from + INTERVAL 36 MONTH)::DATE AS test_to FROM starts WHERE (train_from + INTERVAL 36 MONTH)::DATE <= b),
folds AS (
  SELECT row_number() OVER (ORDER BY train_from)::INTEGER AS fold, train_from, test_from, test_to,
    (SELECT date FROM calendar WHERE session = (SELECT min(session) - 3 FROM calendar c WHERE c.date >= test_from)) AS label_cutoff FROM spans
),
trained AS (SELECT fold, s.* FROM scored s JOIN folds ON s.date BETWEEN train_from AND label_cutoff)"""


def _recursive(*parts: str, select: str) -> str:
    return with_sql(*parts, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


def _linear(name: str, kind: str, solved: str) -> None:
    select = f"SELECT instrument, date, round({SCORE}, 7) + 0.0 AS score FROM scored, solved WHERE date >= DATE '1997-01-01' AND {KNOWN}"

    @REGISTRY.query(name, _recursive(BARS_SQL, SCORED_SQL, CALENDAR_SQL, SPLIT_SQL, moments_sql("early", FEATURES, "fold"), solved, select=select))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = scored(spark, sf_dir)
        train = labels.embargoed(panel, calendar(panel), "1997-01-01", hold=2)
        found = gram.fit_predict(train, panel.where(F.col("date") >= F.lit("1997-01-01").cast("date")), FEATURES, "label", kind)
        return found.select("instrument", "date", r(F.col("score"), 7).alias("score"))


_linear("ml_ols", "ols", eliminated_sql(4, "fold", 0.0))
_linear("ml_linear", "ridge", eliminated_sql(4, "fold", 1.0))
_linear("ml_lasso", "lasso", descended_sql(4, "fold", 0.001, 1.0))
_linear("ml_elastic_net", "elastic_net", descended_sql(4, "fold", 0.001, 0.5))


@REGISTRY.query(
    "walk_forward",
    with_sql(BARS_SQL, SCORED_SQL, CALENDAR_SQL, FOLDS_SQL, moments_sql("trained", FEATURES, "fold"), eliminated_sql(4, "fold", 1.0),
        select=f"SELECT fold, instrument, date, round({SCORE}, 7) + 0.0 AS score FROM scored JOIN folds ON date >= test_from AND date < test_to JOIN solved USING (fold) WHERE {KNOWN}"),
)
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = scored(spark, sf_dir)
    folds = labels.walk_forward_folds(calendar(bars(spark, sf_dir)), train_months=24, test_months=12, hold=2)
    found = gram.walk_forward(panel, folds, FEATURES, "label", "ridge")
    return found.select("fold", "instrument", "date", r(F.col("score"), 7).alias("score"))


@REGISTRY.query(
    "fold_coefficients",
    with_sql(BARS_SQL, SCORED_SQL, CALENDAR_SQL, FOLDS_SQL,
        "ready AS (SELECT fold, momentum_5 AS x, turn AS z, label AS y FROM trained WHERE momentum_5 IS NOT NULL AND turn IS NOT NULL AND label IS NOT NULL)",
        "c AS (SELECT fold, count(*) AS n, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM ready GROUP BY 1)",
        "b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b0, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b1 FROM c)",
        select="SELECT fold, n, round(b0, 7) + 0.0 AS momentum_5, round(b1, 7) + 0.0 AS turn, round(my - b0 * mx - b1 * mz, 7) + 0.0 AS intercept FROM b"),
)
def fold_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on two features in every fold, against their closed form."""
    panel = scored(spark, sf_dir)
    folds = labels.walk_forward_folds(calendar(bars(spark, sf_dir)), train_months=24, test_months=12, hold=2)
    windows = folds.select("fold", F.col("train_from").alias("from_"), F.col("label_cutoff").alias("to_"))
    found = gram.fold_models(panel, windows, ("momentum_5", "turn"), "label", "ols")
    return found.select("fold", "n", r(F.col("coefficients")[0], 7).alias("momentum_5"), r(F.col("coefficients")[1], 7).alias("turn"), r(F.col("intercept"), 7).alias("intercept"))


JUDGED_SQL = f"""
told AS (SELECT fold, instrument, date, label, {SCORE} AS score FROM scored JOIN folds ON date >= test_from AND date < test_to JOIN solved USING (fold) WHERE {KNOWN} AND label IS NOT NULL),
ranked AS (
  SELECT *, (rank() OVER (PARTITION BY date ORDER BY score) + rank() OVER (PARTITION BY date ORDER BY score DESC) * -1 + count(*) OVER (PARTITION BY date) + 1) / 2.0 AS rs,
    (rank() OVER (PARTITION BY date ORDER BY label) + rank() OVER (PARTITION BY date ORDER BY label DESC) * -1 + count(*) OVER (PARTITION BY date) + 1) / 2.0 AS rl FROM told
),
daily_ic AS (SELECT date, covar_pop(rs, rl) / nullif(stddev_pop(rs) * stddev_pop(rl), 0) AS ic FROM ranked GROUP BY 1 HAVING count(*) >= 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, instrument) AS own, row_number() OVER (PARTITION BY date ORDER BY rl DESC, instrument) AS ideal FROM ranked),
daily_ndcg AS (SELECT date, sum(rl / log2(own + 1)) FILTER (WHERE own <= 10) / nullif(sum(rl / log2(ideal + 1)) FILTER (WHERE ideal <= 10), 0) AS ndcg FROM placed GROUP BY 1)"""


@REGISTRY.query(
    "walk_forward_judged",
    with_sql(BARS_SQL, SCORED_SQL, CALENDAR_SQL, FOLDS_SQL, moments_sql("trained", FEATURES, "fold"), eliminated_sql(4, "fold", 1.0), JUDGED_SQL,
        select="SELECT date_trunc('month', date)::DATE AS month, round(avg(ic), 5) + 0.0 AS rank_ic, round(avg(ndcg), 5) + 0.0 AS ndcg FROM daily_ndcg LEFT JOIN daily_ic USING (date) GROUP BY 1"),
)
def walk_forward_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample scores of all folds, by month: rank correlation with the outcome, and how good the top ten are."""
    panel = scored(spark, sf_dir)
    folds = labels.walk_forward_folds(calendar(bars(spark, sf_dir)), train_months=24, test_months=12, hold=2)
    scores = gram.walk_forward(panel, folds, FEATURES, "label", "ridge").join(panel.select("instrument", "date", "label"), ["instrument", "date"])
    found = diagnostics.monthly_ranking(scores, "score", "label")
    return found.select("month", r(F.col("rank_ic"), 5).alias("rank_ic"), r(F.col("ndcg"), 5).alias("ndcg"))
