"""Linear models from sums of products: one pass over the panel fits every fold.

A session's rows are summed up by their count, sums and products of features and
label. The sums of sessions add up to those of a fold's window, and a model of k
features is solved on its k x k matrix. Features are shifted by one value each, the
panel's mean, before products are taken, so that large levels don't cost digits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.models import ALPHAS
from panelspark.sources.files import shared_folder


def _names(features: tuple[str, ...]) -> list[tuple[str, str]]:
    """Pairs of variables whose products are summed; the label goes by y_."""
    every = [*features, "y_"]
    return [(a, b) for i, a in enumerate(every) for b in every[i:]]


def session_sums(panel: DataFrame, features: tuple[str, ...], label: str, shift: dict[str, float], by: str = "date") -> DataFrame:
    """(by, n, sums array, products array): of the rows with all features and a label; a row a session, combined before the shuffle."""
    value = lambda c: F.col(c).cast("double") - F.lit(shift.get(c, 0.0))
    whole = panel.dropna(subset=[*features, label]).select(by, *[value(c).alias(c) for c in features], F.col(label).cast("double").alias("y_"))
    sums = F.array(*[F.sum(c) for c in (*features, "y_")])
    products = F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in _names(features)])
    return whole.groupBy(by).agg(F.count("*").alias("n"), sums.alias("sums"), products.alias("products"))


def window_sums(sessions: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """(fold, n, sums, products): sessions (date, ...) added up over windows (fold, from_, to_, both ends taken in).

    Both tables are small: a row a session, and a row a fold.
    """
    inside = F.col("date").between(F.col("from_"), F.col("to_"))
    met = sessions.join(F.broadcast(windows), inside)
    total = lambda name, size: F.array(*[F.sum(F.col(name)[i]) for i in range(size)]).alias(name)
    return met.groupBy("fold").agg(F.sum("n").alias("n"), total("sums", k + 1), total("products", (k + 1) * (k + 2) // 2))


def solve(n: int, sums: np.ndarray, products: np.ndarray, kind: str, alpha: float, l1_share: float = 0.5, sweeps: int = 10_000) -> tuple[np.ndarray, float]:
    """Coefficients and intercept (of shifted features). Ridge: alpha over the sum of squares; lasso and elastic net: over half their mean."""
    k = len(sums) - 1
    full = np.zeros((k + 1, k + 1))
    full[np.triu_indices(k + 1)] = products
    full = full + np.triu(full, 1).T
    mean = sums / n
    centred = full - n * np.outer(mean, mean)
    xx, xy = centred[:k, :k], centred[:k, k]
    if kind in ("ols", "ridge"):
        penalty = alpha * np.eye(k) if kind == "ridge" else np.zeros((k, k))
        beta = np.linalg.lstsq(xx + penalty, xy, rcond=None)[0]  # least of norm where features depend on one another
    else:
        share = 1.0 if kind == "lasso" else l1_share
        xx, xy, beta = xx / n, xy / n, np.zeros(k)
        for _ in range(sweeps):
            before = beta.copy()
            for j in range(k):
                if xx[j, j] > 0:
                    rest = xy[j] - xx[j] @ beta + xx[j, j] * beta[j]
                    beta[j] = np.sign(rest) * max(abs(rest) - alpha * share, 0.0) / (xx[j, j] + alpha * (1 - share))
            if np.abs(beta - before).max() <= 1e-13 * max(1.0, np.abs(beta).max()):
                break
    return beta, float(mean[k] - mean[:k] @ beta)


def fold_models(panel: DataFrame, windows: DataFrame, features: tuple[str, ...], label: str, kind: str, alpha: float | None = None, l1_share: float = 0.5, least: int = 30) -> DataFrame:
    """(fold, n, coefficients array<double>, intercept): a model for each window (fold, from_, to_) with `least` rows at least.

    kind: ols, ridge, lasso or elastic_net. The panel is read twice, for the
    features' means and for the sums, whatever the number of windows.
    """
    if kind not in ("ols", "ridge", "lasso", "elastic_net"):
        raise ValueError(f"{kind} is not solved from sums of products")
    alpha = ALPHAS.get(kind, 0.0) if alpha is None else alpha
    means = panel.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features]).first()  # one row
    shift = {c: float(means[c] or 0.0) for c in features}
    k = len(features)
    shared_folder(panel.sparkSession)
    sessions = session_sums(panel, features, label, shift).checkpoint(eager=True)
    summed = window_sums(sessions, windows, k)
    origin = np.array([shift[c] for c in features])

    def fit(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                beta, intercept = solve(r.n, np.array(r.sums), np.array(r.products), kind, alpha, l1_share)
                out.append((r.fold, r.n, beta.tolist(), intercept - float(beta @ origin)))
            yield pd.DataFrame(out, columns=["fold", "n", "coefficients", "intercept"])

    kind_of_fold = windows.schema["fold"].dataType.simpleString()
    return summed.where(F.col("n") >= least).mapInPandas(fit, f"fold {kind_of_fold}, n long, coefficients array<double>, intercept double")


def linear_score(features: tuple[str, ...]) -> Column:
    """Intercept and the sum of coefficients times features."""
    total = F.col("intercept")
    for i, c in enumerate(features):
        total = total + F.col("coefficients")[i] * F.col(c).cast("double")
    return total


def walk_forward(panel: DataFrame, folds: DataFrame, features: tuple[str, ...], label: str, kind: str, **settings) -> DataFrame:
    """(fold, instrument, date, score) of the test rows with all features, by the model of their fold.

    folds: (fold, train_from, label_cutoff, test_from, test_to), as labels.walk_forward_folds
    gives them. All folds are fitted in one job. Sessions are matched with folds
    first (a row a session and fold), so that panel rows meet their folds by an
    equi-join. Folds with fewer than 30 training rows have no scores.
    """
    windows = folds.select("fold", F.col("train_from").alias("from_"), F.col("label_cutoff").alias("to_"))
    models = fold_models(panel, windows, features, label, kind, **settings)
    days = panel.select("date").distinct()
    asked = days.join(F.broadcast(folds), (F.col("date") >= F.col("test_from")) & (F.col("date") < F.col("test_to"))).select("date", "fold")
    by_day = asked.join(F.broadcast(models), "fold")  # a row a session and fold
    rows = panel.dropna(subset=list(features)).join(F.broadcast(by_day), "date")
    return rows.select("fold", "instrument", "date", linear_score(features).alias("score"))


def fit_predict(train: DataFrame, test: DataFrame, features: tuple[str, ...], label: str, kind: str, **settings) -> DataFrame:
    """(instrument, date, score): as models.fit_predict, for the models that are solved from sums of products."""
    window = train.agg(F.lit(1).alias("fold"), F.min("date").alias("from_"), F.max("date").alias("to_"))
    model = fold_models(train, window, features, label, kind, **settings)
    return test.dropna(subset=list(features)).join(F.broadcast(model)).select("instrument", "date", linear_score(features).alias("score"))  # one row
