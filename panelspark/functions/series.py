"""Factor formulas over windows of windows.

Spark and SQL both ask for a projection between a window and a window over it.
A Series is an expression with the number of projections that must come before
it. Every window call becomes a named column of the first projection that can
hold it, so that calls of one level share their sorts and a call that several
formulas use is computed once. The same formula gives Columns for Spark and text
for the SQL check.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import window as w
from panelspark.functions import sqltext as q
from panelspark.operators.rolling import KINDS, Rolling, with_rolling
from panelspark.operators.sections import KINDS as SECTIONS, Section, with_sections

#: Before rounding, values move away from zero by this share: what lies half-way then rounds alike in both engines.
NUDGE = 1e-9

#: Window functions that go through the pass of operators.rolling: those over ordered windows, and others from LONG rows on.
ORDERED = ("ts_rank", "rolling_quantile", "rolling_rank_share", "bars_since_max", "bars_since_min", "ols_slope", "ols_rsquare", "ols_residual")
LONG = 100

#: Of each window function: the Column function and the SQL text function.
WINDOWS: dict[str, tuple[Callable, Callable]] = {
    "shift": (w.shift, q.shift),
    "diff": (w.diff, lambda x, n: f"({x} - {q.shift(x, n)})"),
    "pct_change": (w.pct_change, q.pct_change),
    "rolling_mean": (w.rolling_mean, q.mean),
    "rolling_std": (w.rolling_std, q.std),
    "rolling_max": (w.rolling_max, q.most),
    "rolling_min": (w.rolling_min, q.least),
    "rolling_sum": (w.rolling_sum, q.total),
    "ts_rank": (w.ts_rank, q.ts_rank),
    "ts_zscore": (w.ts_zscore, q.zscore),
    "rolling_bias": (w.rolling_bias, q.bias),
    "rolling_cov": (w.rolling_cov, q.cov),
    "rolling_corr": (w.rolling_corr, q.corr),
    "rolling_corr_zero": (w.rolling_corr_zero, q.corr_zero),
    "rolling_quantile": (w.rolling_quantile, q.quantile),
    "rolling_rank_share": (w.rolling_rank_share, q.rank_share),
    "bars_since_max": (w.bars_since_max, lambda x, n: q.since(x, n, "max")),
    "bars_since_min": (w.bars_since_min, lambda x, n: q.since(x, n, "min")),
    "ols_slope": (w.ols_slope, q.slope),
    "ols_rsquare": (w.ols_rsquare, q.rsquare),
    "ols_residual": (w.ols_residual, q.residual),
    "cs_rank": (w.cs_rank, q.cs_rank),
    "cs_quantile": (w.cs_quantile, lambda x, share: f"(quantile_cont({x}, {share}) OVER (PARTITION BY date))"),
}


def words(form: object) -> set[str]:
    """The words of a call or Column, the columns that it reads among them."""
    return set(re.findall(r"\w+", " ".join(map(str, (form.x, form.y) if isinstance(form, Rolling) else (form.x,) if isinstance(form, Section) else (form,)))))


class Stages:
    """The projections that a set of formulas needs; equal parts are computed once.

    corr_digits: rolling correlations are rounded to so many digits. A query
    sets it where its formulas rank correlations and two engines must see the
    same ties; by default nothing is rounded.
    long: windows of so many rows or more go through the pass of operators.rolling,
    which costs the same for any of them; a window function costs a step a row.
    """

    def __init__(self, sql: bool = False, corr_digits: int | None = None, long: int = LONG) -> None:
        self.sql, self.corr_digits, self.long = sql, corr_digits, long
        self.levels: list[dict[str, object]] = []
        self.names: dict[str, str] = {}

    def column(self, name: str) -> Series:
        return Series(self, name if self.sql else F.col(name), name, 0, False)

    def value(self, number: float) -> Series:
        return Series(self, repr(float(number)) if self.sql else F.lit(float(number)), repr(float(number)), 0, False)

    def settled(self, x: Series) -> Series:
        """x as a named column of an earlier projection, if it is windowed."""
        if not x.windowed:
            return x
        if x.key not in self.names:
            self.names[x.key] = f"s{len(self.names)}_"
            while len(self.levels) <= x.level:
                self.levels.append({})
            self.levels[x.level][self.names[x.key]] = x.form
        name = self.names[x.key]
        return Series(self, name if self.sql else F.col(name), x.key, x.level + 1, False)

    def frame(self, panel: DataFrame, factors: dict[str, Series], keys: tuple[str, ...] = ("instrument", "date"), digits: int | None = None) -> DataFrame:
        """The keys and factors of a panel; infinities are NULL.

        Window calls that none of the factors asks for are left out. Calls over
        histories, passes and calls over dates take turns, each with all that can
        be computed by then, as every turn shuffles the panel. What a turn hands on
        is what later ones need, and of finished factors themselves or their parts,
        whichever are fewer.
        """
        finite = {name: w.finite(x.form.cast("double")) for name, x in factors.items()}
        values = {name: v if digits is None else F.round(v + v * NUDGE, digits) + F.lit(0.0) for name, v in finite.items()}
        left = {name: form for level in self._asked([x.form for x in factors.values()]) for name, form in level.items()}
        uses, wants = {name: words(form) for name, form in left.items()}, {name: words(x.form) for name, x in factors.items()}
        places, made, turn = {name: f"f{i}_" for i, name in enumerate(factors)}, set(), ""
        while left:
            ready = {name: form for name, form in left.items() if not uses[name] & left.keys()}
            kinds = {name: "pass" if isinstance(form, Rolling) else "date" if isinstance(form, Section) else "time" for name, form in left.items()}
            before, turn = turn, min({kinds[name] for name in ready}, key=lambda kind: (kind != turn, ("time", "pass", "date").index(kind)))
            if turn != before:
                whole = [name for name in factors if name not in made and not wants[name] & left.keys()]
                later = {*keys, "instrument", "date"}.union(*(uses[name] for name in left), *(wants[name] for name in factors if name not in made and name not in whole))
                parts = set().union(*(wants[name] for name in whole)) & set(panel.columns) - later
                ended = whole if len(whole) < len(parts) else []
                chosen = [c for c in panel.columns if c in later or (c in parts and not ended)]
                panel = panel.select(*chosen, *[places[name] for name in factors if name in made], *[values[name].alias(places[name]) for name in ended])
                made.update(ended)
            own = {name: form for name, form in ready.items() if kinds[name] == turn}
            if turn == "date":  # ranks of ranks that are made in this turn
                own |= {name: form for name, form in left.items() if kinds[name] == turn and str(form.x) in {str(F.col(of)) for of in own}}
            panel = {"time": DataFrame.withColumns, "pass": with_rolling, "date": with_sections}[turn](panel, own)
            left = {name: form for name, form in left.items() if name not in own}
        return panel.select(*keys, *[(F.col(places[name]) if name in made else value).alias(name) for name, value in values.items()])

    def _asked(self, forms: list) -> list[dict[str, object]]:
        """The levels with the calls that the forms need, directly or through later calls."""
        named = lambda form: {word for word in words(form) if re.fullmatch(r"s\d+_", word)}
        needed, out = set().union(*map(named, forms)), []
        for level in reversed(self.levels):
            own = {name: form for name, form in level.items() if name in needed}
            needed = needed.union(*map(named, own.values()))
            out.append(own)
        return out[::-1]

    def text(self, source: str, factors: dict[str, Series], digits: int, keys: tuple[str, ...] = ("instrument", "date")) -> tuple[list[str], str]:
        """The projections as parts of a WITH list, and the final SELECT."""
        parts = []
        for i, level in enumerate(self.levels):
            parts.append(f"stage{i} AS (SELECT *, {', '.join(f'{form} AS {name}' for name, form in level.items())} FROM {source})")
            source = f"stage{i}"
        chosen = [*keys, *[f"(round({x.form} + {x.form} * {NUDGE}, {digits}) + 0.0) AS {name}" for name, x in factors.items()]]
        return parts, f"SELECT {', '.join(chosen)} FROM {source}"


class Series:
    def __init__(self, stages: Stages, form: object, key: str, level: int, windowed: bool) -> None:
        self.stages, self.form, self.key, self.level, self.windowed = stages, form, key, level, windowed

    def _with(self, other: Series | float, sign: str, columns: Callable, text: str, turned: bool = False) -> Series:
        other = other if isinstance(other, Series) else self.stages.value(other)
        a, b = (other, self) if turned else (self, other)
        form = text.format(a=a.form, b=b.form) if self.stages.sql else columns(a.form, b.form)
        return Series(self.stages, form, f"({a.key}{sign}{b.key})", max(a.level, b.level), a.windowed or b.windowed)

    def __add__(self, o):
        return self._with(o, "+", lambda a, b: a + b, "({a} + {b})")

    def __radd__(self, o):
        return self._with(o, "+", lambda a, b: a + b, "({a} + {b})", True)

    def __sub__(self, o):
        return self._with(o, "-", lambda a, b: a - b, "({a} - {b})")

    def __rsub__(self, o):
        return self._with(o, "-", lambda a, b: a - b, "({a} - {b})", True)

    def __mul__(self, o):
        return self._with(o, "*", lambda a, b: a * b, "({a} * {b})")

    def __rmul__(self, o):
        return self._with(o, "*", lambda a, b: a * b, "({a} * {b})", True)

    def __truediv__(self, o):
        return self._with(o, "/", w.div, "(({a}) / nullif({b}, 0.0))")

    def __rtruediv__(self, o):
        return self._with(o, "/", w.div, "(({a}) / nullif({b}, 0.0))", True)

    def __neg__(self):
        return self * -1.0

    def __lt__(self, o):
        return self._with(o, "<", lambda a, b: F.coalesce((a < b).cast("double"), F.lit(0.0)), "coalesce(({a} < {b})::DOUBLE, 0.0)")

    def __gt__(self, o):
        return self._with(o, ">", lambda a, b: F.coalesce((a > b).cast("double"), F.lit(0.0)), "coalesce(({a} > {b})::DOUBLE, 0.0)")

    def max(self, o):
        return self._with(o, "max", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)), "(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END)")

    def min(self, o):
        return self._with(o, "min", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), "(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN least({a}, {b}) END)")

    def given(self, o):
        """The value where the other is known, else NULL."""
        return self._with(o, "given", lambda a, b: F.when(b.isNotNull(), a), "(CASE WHEN {b} IS NOT NULL THEN {a} END)")

    def where(self, o):
        """The value where the other is above zero, else NULL."""
        return self._with(o, "where", lambda a, b: F.when(b > 0, a), "(CASE WHEN {b} > 0 THEN {a} END)")

    def _one(self, name: str, column: Callable, text: str) -> Series:
        form = text.format(a=self.form) if self.stages.sql else column(self.form)
        return Series(self.stages, form, f"{name}({self.key})", self.level, self.windowed)

    def abs(self):
        return self._one("abs", F.abs, "abs({a})")

    def both(self, o):
        """1 where both are above zero, else 0; NULL counts as not. With `not_` and `either` the logic of comparisons."""
        return self._with(o, "&", lambda a, b: F.when((a > 0) & (b > 0), 1.0).otherwise(0.0), "(CASE WHEN {a} > 0 AND {b} > 0 THEN 1.0 ELSE 0.0 END)")

    def either(self, o):
        return self._with(o, "|", lambda a, b: F.when((a > 0) | (b > 0), 1.0).otherwise(0.0), "(CASE WHEN {a} > 0 OR {b} > 0 THEN 1.0 ELSE 0.0 END)")

    def not_(self):
        return self._one("not", lambda a: F.when(a > 0, 0.0).otherwise(1.0), "(CASE WHEN {a} > 0 THEN 0.0 ELSE 1.0 END)")

    def __le__(self, o):
        return self._with(o, "<=", lambda a, b: F.coalesce((a <= b).cast("double"), F.lit(0.0)), "coalesce(({a} <= {b})::DOUBLE, 0.0)")

    def __ge__(self, o):
        return self._with(o, ">=", lambda a, b: F.coalesce((a >= b).cast("double"), F.lit(0.0)), "coalesce(({a} >= {b})::DOUBLE, 0.0)")

    def equals(self, o):
        return self._with(o, "==", lambda a, b: F.coalesce((a == b).cast("double"), F.lit(0.0)), "coalesce(({a} = {b})::DOUBLE, 0.0)")

    def between(self, low, high):
        """A chained comparison, both ends taken in."""
        return (self >= low).both(self <= high)

    def pow(self, exponent: float):
        return self._one(f"pow{exponent!r}", lambda a: F.pow(F.when((a > 0) | F.lit(float(exponent).is_integer()), a), F.lit(float(exponent))), f"pow(CASE WHEN {{a}} > 0 OR {float(exponent).is_integer()} THEN {{a}} END, {float(exponent)!r})")

    def sqrt(self):
        return self._one("sqrt", lambda a: F.sqrt(F.when(a >= 0, a)), "sqrt(CASE WHEN {a} >= 0 THEN {a} END)")

    def log2(self):
        return self._one("log2", lambda a: F.log2(F.when(a > 0, a)), "log2(CASE WHEN {a} > 0 THEN {a} END)")

    def clip(self, low: float, high: float):
        return self.max(low).min(high)

    def log(self):
        return self._one("log", lambda a: F.ln(F.when(a > 0, a)), "(CASE WHEN {a} > 0 THEN ln({a}) END)")

    def __getattr__(self, name: str) -> Callable:
        if name not in WINDOWS:
            raise AttributeError(name)

        def call(*args) -> Series:
            base = self.stages.settled(self)
            others = [self.stages.settled(a) if isinstance(a, Series) else a for a in args]
            function = WINDOWS[name][self.stages.sql]
            plain = [a.form if isinstance(a, Series) else a for a in others]
            n = next((a for a in reversed(plain) if isinstance(a, int)), 0)
            digits = self.stages.corr_digits if name in ("rolling_corr", "rolling_corr_zero") else None
            if not self.stages.sql and (name in ORDERED or (name in KINDS and n >= self.stages.long)):
                form = Rolling(name, base.form, n, next((a.form for a in others if isinstance(a, Series)), None), next((a for a in plain if isinstance(a, float)), None), digits)
            elif not self.stages.sql and name in SECTIONS:
                form = Section(name, base.form, *plain)
            else:
                form = function(base.form, *plain)
                if digits is not None:
                    form = f"round({form}, {digits})" if self.stages.sql else F.round(form, digits)
            key = f"{base.key}.{name}({', '.join(a.key if isinstance(a, Series) else repr(a) for a in others)})"
            level = max([base.level, *(a.level for a in others if isinstance(a, Series))])
            return self.stages.settled(Series(self.stages, form, key, level, True))

        return call
