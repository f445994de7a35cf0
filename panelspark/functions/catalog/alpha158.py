"""The 158 price and volume features: 9 of the candle, 4 of prices, 29 families over five windows."""

from __future__ import annotations

from panelspark.functions.series import Series, Stages

WINDOWS = (5, 10, 20, 30, 60)
TINY = 1e-12


def candle(s: Stages) -> dict[str, Series]:
    o, h, lo, c = (s.column(x) for x in ("open", "high", "low", "close"))
    span = h - lo + TINY
    top, bottom = o.max(c), o.min(c)
    vwap = (h + lo + c) / 3
    return {
        "KMID": (c - o) / o, "KLEN": (h - lo) / o, "KMID2": (c - o) / span, "KUP": (h - top) / o, "KUP2": (h - top) / span,
        "KLOW": (bottom - lo) / o, "KLOW2": (bottom - lo) / span, "KSFT": (2 * c - h - lo) / o, "KSFT2": (2 * c - h - lo) / span,
        "OPEN0": o / c, "HIGH0": h / c, "LOW0": lo / c, "VWAP0": vwap / c,
    }


def trend(s: Stages, n: int) -> dict[str, Series]:
    """Needs a column t, the observation number."""
    h, lo, c = (s.column(x) for x in ("high", "low", "close"))
    return {
        f"ROC{n}": c.shift(n) / c, f"MA{n}": c.rolling_mean(n) / c, f"STD{n}": c.rolling_std(n) / c,
        f"BETA{n}": c.ols_slope(n) / c, f"RSQR{n}": c.ols_rsquare(n), f"RESI{n}": c.ols_residual(n) / c,
        f"MAX{n}": h.rolling_max(n) / c, f"MIN{n}": lo.rolling_min(n) / c, f"QTLU{n}": c.rolling_quantile(n, 0.8) / c, f"QTLD{n}": c.rolling_quantile(n, 0.2) / c,
        f"RANK{n}": c.rolling_rank_share(n), f"RSV{n}": (c - lo.rolling_min(n)) / (h.rolling_max(n) - lo.rolling_min(n) + TINY),
        f"IMAX{n}": h.bars_since_max(n) / n, f"IMIN{n}": lo.bars_since_min(n) / n, f"IMXD{n}": (h.bars_since_max(n) - lo.bars_since_min(n)) / n,
    }


def flow(s: Stages, n: int) -> dict[str, Series]:
    c, v = s.column("close"), s.column("vol")
    dc, dv = c - c.shift(1), v - v.shift(1)
    up, down = dc.max(0.0), (-dc).max(0.0)
    more, less = dv.max(0.0), (-dv).max(0.0)
    # A bar without a bar before neither rises nor falls: it is not known.
    rising, falling = (c > c.shift(1)).given(dc).rolling_mean(n), (c < c.shift(1)).given(dc).rolling_mean(n)
    moved, turned = dc.abs().rolling_sum(n) + TINY, dv.abs().rolling_sum(n) + TINY
    weighted = (c / c.shift(1) - 1).abs() * v
    return {
        f"CORR{n}": c.rolling_corr_zero((v + 1).log(), n), f"CORD{n}": (c / c.shift(1)).rolling_corr_zero((v / v.shift(1) + 1).log(), n),
        f"CNTP{n}": rising, f"CNTN{n}": falling, f"CNTD{n}": rising - falling,
        f"SUMP{n}": up.rolling_sum(n) / moved, f"SUMN{n}": down.rolling_sum(n) / moved, f"SUMD{n}": (up.rolling_sum(n) - down.rolling_sum(n)) / moved,
        f"VMA{n}": v.rolling_mean(n) / (v + TINY), f"VSTD{n}": v.rolling_std(n) / (v + TINY), f"WVMA{n}": weighted.rolling_std(n) / (weighted.rolling_mean(n) + TINY),
        f"VSUMP{n}": more.rolling_sum(n) / turned, f"VSUMN{n}": less.rolling_sum(n) / turned, f"VSUMD{n}": (more.rolling_sum(n) - less.rolling_sum(n)) / turned,
    }


def alpha158(s: Stages) -> dict[str, Series]:
    out = candle(s)
    for n in WINDOWS:
        out |= trend(s, n) | flow(s, n)
    return out
