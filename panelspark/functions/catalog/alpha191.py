"""The 69 of the 191 published price-volume alphas that the window functions here can express, by their numbers.

RANK is the rank within the date, VWAP amount over volume, a return the one-bar
change of the close; windows take in the current bar.
"""

from __future__ import annotations

from panelspark.functions.series import Series, Stages


def price_alphas(s: Stages) -> dict[str, Series]:
    o, h, lo, c, v, a = (s.column(x) for x in ("open", "high", "low", "close", "vol", "amount"))
    vwap, ret = a / v, c.pct_change(1)
    place = ((c - lo) - (h - c)) / (h - lo)
    typical = (c + h + lo) / 3
    means = c.rolling_mean(3) + c.rolling_mean(6) + c.rolling_mean(12) + c.rolling_mean(24)
    busy = v / v.rolling_mean(20)
    drift = o.rolling_sum(5) * ret.rolling_sum(5)
    reach = (h - lo) / (c.rolling_sum(5) / 5)
    # The published formulas.
    found = {
        2: -place.diff(1),
        7: ((vwap - c).rolling_max(3).cs_rank() + (vwap - c).rolling_min(3).cs_rank()) * v.diff(3).cs_rank(),
        8: (((h + lo) / 2 * 0.2 + vwap * 0.8).diff(4) * -1).cs_rank(),
        11: (place * v).rolling_sum(6),
        14: c - c.shift(5),
        15: o / c.shift(1) - 1,
        18: c / c.shift(5),
        20: (c - c.shift(6)) / c.shift(6) * 100,
        29: (c - c.shift(6)) / c.shift(6) * v,
        31: (c - c.rolling_mean(12)) / c.rolling_mean(12) * 100,
        33: (-lo.rolling_min(5) + lo.rolling_min(5).shift(5)) * ((ret.rolling_sum(240) - ret.rolling_sum(20)) / 220).cs_rank() * v.ts_rank(5),
        34: c.rolling_mean(12) / c,
        37: -(drift - drift.shift(10)).cs_rank(),
        41: -vwap.diff(3).rolling_max(5).cs_rank(),
        46: means / (4 * c),
        60: (place * v).rolling_sum(20),
        65: c.rolling_mean(6) / c,
        66: (c - c.rolling_mean(6)) / c.rolling_mean(6) * 100,
        70: a.rolling_std(6),
        71: (c - c.rolling_mean(24)) / c.rolling_mean(24) * 100,
        80: (v - v.shift(5)) / v.shift(5) * 100,
        85: busy.ts_rank(20) * (-c.diff(7)).ts_rank(8),
        88: (c - c.shift(20)) / c.shift(20) * 100,
        95: a.rolling_std(20),
        97: v.rolling_std(10),
        100: v.rolling_std(20),
        106: c - c.shift(20),
        107: -(o - h.shift(1)).cs_rank() * (o - c.shift(1)).cs_rank() * (o - lo.shift(1)).cs_rank(),
        114: reach.shift(2).cs_rank() * v.cs_rank().cs_rank() / (reach / (vwap - c)),
        117: v.ts_rank(32) * (1 - (c + h - lo).ts_rank(16)) * (1 - ret.ts_rank(32)),
        118: (h - o).rolling_sum(20) / (o - lo).rolling_sum(20) * 100,
        120: (vwap - c).cs_rank() / (vwap + c).cs_rank(),
        126: typical,
        132: a.rolling_mean(20),
        134: (c - c.shift(12)) / c.shift(12) * v,
        142: -c.ts_rank(10).cs_rank() * c.diff(1).diff(1).cs_rank() * busy.ts_rank(5).cs_rank(),
        145: (v.rolling_mean(9) - v.rolling_mean(26)) / v.rolling_mean(12) * 100,
        150: typical * v,
        153: means / 4,
        163: (-ret * v.rolling_mean(20) * vwap * (h - c)).cs_rank(),
        168: -busy,
        170: (1 / c).cs_rank() * v / v.rolling_mean(20) * (h * (h - c).cs_rank() / (h.rolling_sum(5) / 5)) - (vwap - vwap.shift(5)).cs_rank(),
        178: (c - c.shift(1)) / c.shift(1) * v,
    }
    return {f"alpha191_{k:03d}": x for k, x in found.items()}


def correlation_alphas(s: Stages) -> dict[str, Series]:
    o, h, lo, c, v, a = (s.column(x) for x in ("open", "high", "low", "close", "vol", "amount"))
    vwap, ret = a / v, c.pct_change(1)
    vr = v.cs_rank()
    # The published formulas.
    found = {
        5: -v.ts_rank(5).rolling_corr(h.ts_rank(5), 5).rolling_max(3),
        16: -vr.rolling_corr(vwap.cs_rank(), 5).cs_rank().rolling_max(5),
        26: (c.rolling_sum(7) / 7 - c) + vwap.rolling_corr(c.shift(5), 230),
        32: -h.cs_rank().rolling_corr(vr, 3).cs_rank().rolling_sum(3),
        42: -h.rolling_std(10).cs_rank() * h.rolling_corr(v, 10),
        45: (c * 0.6 + o * 0.4).diff(1).cs_rank() * vwap.rolling_corr(v.rolling_mean(150), 15).cs_rank(),
        62: -h.rolling_corr(vr, 5),
        74: (lo * 0.35 + vwap * 0.65).rolling_sum(20).rolling_corr(v.rolling_mean(40).rolling_sum(20), 7).cs_rank() + vwap.cs_rank().rolling_corr(vr, 6).cs_rank(),
        83: -h.cs_rank().rolling_cov(vr, 5).cs_rank(),
        90: -vwap.cs_rank().rolling_corr(vr, 5).cs_rank(),
        91: -(c - c.rolling_max(5)).cs_rank() * v.rolling_mean(40).rolling_corr(lo, 5).cs_rank(),
        99: -c.cs_rank().rolling_cov(vr, 5).cs_rank(),
        101: (c.rolling_corr(v.rolling_mean(30).rolling_sum(37), 15).cs_rank() < (h * 0.1 + vwap * 0.9).cs_rank().rolling_corr(vr, 11).cs_rank()) * -1,
        104: -h.rolling_corr(v, 5).diff(5) * c.rolling_std(20).cs_rank(),
        105: -o.cs_rank().rolling_corr(vr, 10),
        113: -(c.shift(5).rolling_sum(20) / 20).cs_rank() * c.rolling_corr(v, 2) * c.rolling_sum(5).rolling_corr(c.rolling_sum(20), 2).cs_rank(),
        123: (((h + lo) / 2).rolling_sum(20).rolling_corr(v.rolling_mean(60).rolling_sum(20), 9).cs_rank() < lo.rolling_corr(v, 6).cs_rank()) * -1,
        136: -ret.diff(3).cs_rank() * o.rolling_corr(v, 10),
        139: -o.rolling_corr(v, 10),
        141: -h.cs_rank().rolling_corr(v.rolling_mean(15).cs_rank(), 9).cs_rank(),
        148: (o.rolling_corr(v.rolling_mean(60).rolling_sum(9), 6).cs_rank() < (o - o.rolling_min(14)).cs_rank()) * -1,
        154: (vwap - vwap.rolling_min(16)) < vwap.rolling_corr(v.rolling_mean(180), 18),
        176: ((c - lo.rolling_min(12)) / (h.rolling_max(12) - lo.rolling_min(12))).cs_rank().rolling_corr(vr, 6),
        179: vwap.rolling_corr(v, 4).cs_rank() * lo.cs_rank().rolling_corr(v.rolling_mean(50).cs_rank(), 12).cs_rank(),
        184: (o - c).shift(1).rolling_corr(c, 200).cs_rank() + (o - c).cs_rank(),
        191: v.rolling_mean(20).rolling_corr(lo, 5) + (h + lo) / 2 - c,
    }
    return {f"alpha191_{k:03d}": x for k, x in found.items()}
