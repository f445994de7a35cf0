"""The canonical pack of 50 factors, the built-in 7, and the money-flow 4."""

from __future__ import annotations

from panelspark.functions.series import Series, Stages


def builtin(s: Stages) -> dict[str, Series]:
    c = s.column("close")
    plain = {name: s.column(name) for name in ("pe_ttm", "total_market_cap", "float_market_cap", "dividend_yield_ratio", "turn")}
    return plain | {"momentum_5": c.pct_change(5), "volatility_5": c.pct_change(1).rolling_std(5)}


def canonical(s: Stages) -> dict[str, Series]:
    o, h, lo, c, vol, amount = (s.column(x) for x in ("open", "high", "low", "close", "vol", "amount"))
    ret = c.pct_change(1)
    out = {"momentum_1": ret, "reversal_5": -c.pct_change(5)}
    out |= {f"momentum_{n}": c.pct_change(n) for n in (10, 20, 60, 120)}
    out |= {f"close_bias_{n}": c.rolling_bias(n) for n in (5, 20, 60, 120, 200)}
    out |= {f"ma_ratio_{a}_{b}": c.rolling_mean(a) / c.rolling_mean(b) - 1 for a, b in ((20, 60), (60, 120), (20, 120))}
    out |= {f"close_zscore_{n}": c.ts_zscore(n) for n in (20, 60)}
    out |= {f"close_ts_rank_{n}": c.ts_rank(n) for n in (20, 60, 120, 252)}
    out |= {f"dist_high_{n}": c / h.rolling_max(n) - 1 for n in (60, 120)}
    out |= {"amount_zscore_20": amount.ts_zscore(20), "amount_ratio_5": amount / amount.rolling_mean(5), "vol_mean_20": vol.rolling_mean(20)}
    out |= {f"volatility_{n}": ret.rolling_std(n) for n in (10, 20, 60)}
    out["vol_ratio_20_60"] = ret.rolling_std(20) / ret.rolling_std(60) - 1
    ranked = {"amount": "amount", "turn": "turn", "pe_ttm": "pe_ttm", "float_mv": "float_market_cap", "total_mv": "total_market_cap", "div_yield": "dividend_yield_ratio"}
    out |= {f"{name}_cs_rank": s.column(column).cs_rank() for name, column in ranked.items()}
    out |= {"intraday_range": (h - lo) / c, "overnight_ret": o / c.shift(1) - 1}
    again = {
        "overnight_ret": out["overnight_ret"], "vol_mean_20": out["vol_mean_20"], "close_bias_20": out["close_bias_20"], "momentum_5": c.pct_change(5),
        "momentum_10": out["momentum_10"], "momentum_20": out["momentum_20"], "reversal_5": out["reversal_5"], "close_bias_5": out["close_bias_5"],
        "amount_ratio_5": out["amount_ratio_5"], "volatility_5": ret.rolling_std(5), "volatility_10": out["volatility_10"],
    }
    out |= {f"{name}_cs_rank": x.cs_rank() for name, x in again.items()}
    return out | {"close_location": (c - lo) / (h - lo), "trade_vwap": amount / vol}


def moneyflow(s: Stages) -> dict[str, Series]:
    """Net inflow against traded amount; net_mf_amount is in units of ten thousand."""
    net, ten_thousand = s.column("net_mf_amount"), s.column("amount") / 10000
    one = net / ten_thousand
    five = net.rolling_sum(5) / ten_thousand.rolling_sum(5)
    return {"mf_net_ratio": one, "mf_net_ratio_cs_rank": one.cs_rank(), "mf_net_ratio_5": five, "mf_net_ratio_5_cs_rank": five.cs_rank()}
